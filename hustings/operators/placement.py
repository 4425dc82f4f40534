"""Placing units in seats by a hierarchy of keys: the first tier that knows a unit places it, possibly in several seats.

A placement is a long table (unit, seat, weight, method), so a unit may have any number of seats; the weights of each
placed unit add up to one. Lookups of all tiers are one table (kind, key, seat, weight), and units list their keys by
tier, so all tiers cost one join and one window over a unit's few rows. Lookups are far smaller than units; whether they are
broadcast is left to Spark, which knows their size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACED = ("unit", "seat", "weight", "method")


def shared(rows: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """rows with weight: the share of amount in its keys' sum; null if that is zero."""
    return rows.withColumn("weight", F.try_divide(F.col(amount).cast("double"), F.sum(amount).over(Window.partitionBy(*keys))))


def deepest_coverage(villages: DataFrame, coverage: DataFrame, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """(key, seat, weight) of census codes (villages: village, census and a column for each level's code).

    A village's own rows of coverage (level, code, seat, whole) beat those of what it lies in, and those the next level's;
    above the first level only rows that cover the whole count. A census code that stands for several villages of now is
    shared by their number. Villages without a census code are left out.
    """
    places = F.explode(F.array(*[F.struct(F.lit(depth).alias("depth"), F.lit(level).alias("level"), F.col(column).cast("string").alias("code")) for depth, (level, column) in enumerate(levels)]))
    each = villages.where("census is not null").select("village", "census", places.alias("at")).select("village", "census", "at.*")
    usable = coverage.where((F.col("level") == levels[0][0]) | F.col("whole")).select("level", F.col("code").cast("string").alias("code"), "seat").distinct()
    met = each.join(usable, ["level", "code"]).groupBy("census", "village", "seat").agg(F.min("depth").alias("depth"))
    own = met.withColumn("deepest", F.min("depth").over(Window.partitionBy("village"))).where("depth = deepest")
    counted = own.groupBy("census", "seat").agg(F.count(F.lit(1)).alias("villages"))
    return shared(counted, ["census"], "villages").select(F.col("census").cast("string").alias("key"), "seat", "weight")


def body_shares(wards: DataFrame, coverage: DataFrame) -> DataFrame:
    """(body, seat, weight): a town's wards (body, ward, seat) by seat; of towns without wards the seats that cover it
    whole (coverage: body, seat, whole), else all that cover it, in equal parts."""
    mapped = shared(wards.groupBy("body", "seat").agg(F.count_distinct("ward").alias("wards")), ["body"], "wards").select("body", "seat", "weight")
    other = coverage.select("body", "seat", "whole").join(mapped.select("body").distinct(), "body", "left_anti")
    any_whole = other.groupBy("body", "seat").agg(F.max("whole").alias("whole")).withColumn("any", F.max("whole").over(Window.partitionBy("body")))
    equal = any_whole.where(F.col("whole") | ~F.col("any")).withColumn("one", F.lit(1))
    return mapped.unionByName(shared(equal, ["body"], "one").select("body", "seat", "weight"))


def listed_bodies(lists: DataFrame, bodies: DataFrame) -> DataFrame:
    """(key, seat, weight) of towns that stand for lists of bodies such as '12;13' (lists: key, bodies), weights made whole."""
    each = lists.select("key", F.explode(F.split("bodies", ";")).alias("body")).withColumn("body", F.trim("body"))
    summed = each.join(bodies.withColumn("body", F.col("body").cast("string")), "body").groupBy("key", "seat").agg(F.sum("weight").alias("sum"))
    return shared(summed, ["key"], "sum").select("key", "seat", "weight")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the one that is first by order, whole."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), order).alias("first")).select("first.*")


def lookups(**tables: DataFrame) -> DataFrame:
    """One table (kind, key, seat, weight) of several (key, seat, weight)."""
    return reduce(DataFrame.unionByName, [t.where("key is not null").select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "seat", "weight") for kind, t in tables.items()])


def by_first_tier(units: DataFrame, known: DataFrame, tiers: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """PLACED rows of the first tier (method, kind, key) that is known for a unit; a tier whose key is null doesn't apply."""
    keys = F.array(*[F.struct(F.lit(nth).alias("tier"), F.lit(method).alias("method"), F.lit(kind).alias("kind"), key.cast("string").alias("key")) for nth, (method, kind, key) in enumerate(tiers)])
    asked = units.select("unit", F.explode(F.filter(keys, lambda x: x["key"].isNotNull())).alias("ask")).select("unit", "ask.*")
    met = asked.join(known, ["kind", "key"])
    return met.withColumn("first", F.min("tier").over(Window.partitionBy("unit"))).where("tier = first").select(*PLACED)


def guarded(placed: DataFrame, units: DataFrame, allowed: DataFrame) -> DataFrame:
    """Without seats whose list of districts (allowed: seat, district) lacks the unit's; what is left is made whole. Seats without a list take all."""
    rows = placed.join(units.select("unit", "district"), "unit")
    rows = rows.join(allowed.select("seat").distinct().withColumn("listed", F.lit(True)), "seat", "left")
    rows = rows.join(allowed.select("seat", "district").distinct().withColumn("in_list", F.lit(True)), ["seat", "district"], "left")
    return shared(rows.where("listed is null or in_list").withColumnRenamed("weight", "was"), ["unit"], "was").select(*PLACED)


def by_neighbours(units: DataFrame, placed: DataFrame, area: Sequence[str], most: float = 0.95, least: float = 0.02) -> DataFrame:
    """PLACED rows of unplaced units by where their area's placed people are: the seat with nearly all of them; else, but for
    towns, all seats with more than a trace, by people."""
    people = units.join(placed, "unit").groupBy(*area, "seat").agg(F.sum(F.col("pop") * F.col("weight")).alias("people"))
    shares = shared(people, area, "people").withColumnRenamed("weight", "share")
    w = Window.partitionBy(*area)
    ranked = shares.withColumn("top", F.max("share").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("share"), "seat")))
    usable = ranked.where(F.when(F.col("top") >= most, F.col("nth") == 1).otherwise(F.col("share") >= least))
    left = units.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in area])).join(placed.select("unit").distinct(), "unit", "left_anti").select("unit", "route", *area)
    rows = left.join(usable, list(area)).where((F.col("top") >= most) | (F.col("route") != "town"))
    method = F.when(F.col("top") >= most, "subdistrict").otherwise("subdistrict-split")
    return shared(rows, ["unit"], "share").select("unit", "seat", "weight", method.alias("method"))


def overridden(placed: DataFrame, over: DataFrame) -> DataFrame:
    """placed, where units that `over` places have its rows only."""
    return placed.join(over.select("unit").distinct(), "unit", "left_anti").unionByName(over)


def with_unplaced(units: DataFrame, placed: DataFrame) -> DataFrame:
    """placed, and a row with no seat and method 'none' for every unit that has none."""
    none = units.join(placed.select("unit").distinct(), "unit", "left_anti").select("unit", F.lit(None).cast("string").alias("seat"), F.lit(None).cast("double").alias("weight"), F.lit("none").alias("method"))
    return placed.unionByName(none)


def method_report(units: DataFrame, placed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units, people and their share by keys and method, whole units counted once."""
    one = with_unplaced(units, placed).select("unit", "method").distinct().join(units.select("unit", *keys, "pop"), "unit")
    sums = one.groupBy(*keys, "method").agg(F.count(F.lit(1)).alias("units"), F.sum("pop").alias("people"))
    return sums.withColumn("share", F.col("people").cast("double") * 100 / F.sum("people").over(Window.partitionBy(*keys)))


def by_electors(placed: DataFrame, units: DataFrame, electors: DataFrame, default: float = 0.65) -> DataFrame:
    """placed, where towns that lie in several seats are shared by the seats' electors in them (electors: seat, e; units: unit, state, route, town, pop).

    A state's electors a person are the median over seats that hold no part of such a town. What electors a seat has beyond
    its other people at that ratio is its part in towns, divided between its towns by the weights they had; a town's seats
    share by these parts, or by their weights where there are none. Each unit then keeps its own seats, made whole, as a
    town's units may lie in districts with different seats.
    """
    town_unit = F.when((F.col("route") == "town") & F.col("method").startswith("town"), F.col("town"))
    rows = placed.join(units.select("unit", "state", "route", "town", "pop"), "unit").withColumn("town", town_unit)
    parts = rows.groupBy("state", "town", "seat").agg(F.max("weight").alias("was"), F.sum(F.col("pop") * F.col("weight")).alias("people"))
    parts = parts.withColumn("split", F.col("town").isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy("town")) > 1))
    seats = parts.groupBy("state", "seat").agg(F.sum(F.when(~F.col("split"), F.col("people"))).alias("others"), F.max("split").alias("touched")).join(electors.select("seat", "e"), "seat", "left")
    ratio = seats.where("not touched and e > 0 and others > 0").groupBy("state").agg(F.percentile(F.col("e") / F.col("others"), 0.5).alias("ratio"))
    known = parts.where("split").join(seats, ["state", "seat"]).join(ratio, "state", "left")
    beyond = F.greatest(F.lit(0.0), F.coalesce("e", F.lit(0)) - F.coalesce("ratio", F.lit(default)) * F.coalesce("others", F.lit(0.0)))
    told = known.withColumn("part", F.try_divide(beyond * F.col("was"), F.sum("was").over(Window.partitionBy("seat"))))
    town = Window.partitionBy("town")
    shares = told.select("town", "seat", F.when(F.sum("part").over(town) > 0, F.col("part") / F.sum("part").over(town)).otherwise(F.col("was")).alias("share"))
    whole = rows.join(shares, ["town", "seat"], "left").withColumn("all", F.sum("share").over(Window.partitionBy("unit")))
    return whole.select("unit", "seat", F.when(F.col("share").isNull(), F.col("weight")).otherwise(F.coalesce(F.try_divide("share", "all"), F.lit(0.0))).alias("weight"), "method")
