"""Placing small units in seats, and what the seats' people are like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.canon import percent

COUNTS = ("pop", "hh", "lit", "kids")


def route(level: Column, town: Column) -> Column:
    """How a unit finds its seat: a ward of a town, an outgrowth, or a village."""
    return F.when((level == "WARD") & (town < 8), "town").when(level == "WARD", "og").otherwise("village")


def profiles(units: DataFrame, *keys: str) -> DataFrame:
    """Counts add up over units; percentages never: power is weighted by households, over those that have it."""
    w = F.when(F.col("power").isNotNull(), F.col("hh"))
    sums = [F.sum(c).alias(c) for c in COUNTS]
    return units.groupBy(*keys).agg(*sums, F.sum(F.when(F.col("urban"), F.col("pop")).otherwise(0)).alias("urban_pop"), (F.sum(F.col("power") * F.col("hh")) / F.sum(w)).alias("power"))


def rates(profile: DataFrame, *keys: str) -> DataFrame:
    """Literacy over age seven, share of children and of townspeople, people a household."""
    return profile.select(*keys, percent(F.col("lit"), F.col("pop") - F.col("kids")).alias("literacy"), percent(F.col("kids"), F.col("pop")).alias("children"), percent(F.col("urban_pop"), F.col("pop")).alias("urban"), (F.col("pop").cast("double") / F.col("hh")).alias("per_house"), "power")


def ranked_in_pool(rated: DataFrame, pool: list[str], rate: str, least: int = 4) -> DataFrame:
    """Rank from the top of a rate within its pool, if that is large enough: one plus those above."""
    w = Window.partitionBy(*pool)
    return rated.select("*", F.rank().over(w.orderBy(F.desc(rate))).alias("rank"), F.count(rate).over(w).alias("of")).where(F.col("of") >= least)


def bridge(units: DataFrame) -> DataFrame:
    """Seat to districts, by share of its people; shares below three per cent go, the others add up to one."""
    parts = units.groupBy("s", "n", "district").agg(F.sum("pop").alias("pop"))
    w = Window.partitionBy("s", "n")
    kept = parts.withColumn("share", F.col("pop").cast("double") / F.sum("pop").over(w)).where(F.col("share") >= 0.03)
    return kept.select("s", "n", "district", (F.col("share") / F.sum("share").over(w)).alias("share"))


def blended(bridged: DataFrame, district_rates: DataFrame, fields: list[str]) -> DataFrame:
    """Seats' rates as the weighted mean of their districts'; a missing rate takes its weight along."""
    rows = bridged.join(district_rates, ["s", "district"])
    w = F.col("share")
    return rows.groupBy("s", "n").agg(*[(F.sum(w * F.col(f)) / F.sum(F.when(F.col(f).isNotNull(), w))).alias(f) for f in fields])


def vetoed(bridged: DataFrame, allowed: Column) -> DataFrame:
    """Only allowed districts, with their shares made whole; a seat that would keep none keeps its largest."""
    w = Window.partitionBy("s", "n")
    rows = bridged.withColumn("ok", allowed).withColumn("any", F.max("ok").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("share"), "district")))
    kept = rows.where(F.col("ok") | (~F.col("any") & (F.col("nth") == 1)))
    return kept.select("s", "n", "district", (F.col("share") / F.sum("share").over(w)).alias("share"))


def owners(bridged: DataFrame, seats: DataFrame) -> DataFrame:
    """The seat that a district's weight is largest in, electors being the weight."""
    rows = bridged.join(seats, ["s", "n"]).groupBy("s", "district", "n").agg(F.sum(F.col("share") * F.col("e")).alias("w"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("s", "district").orderBy(F.desc("w"), "n"))).where("rn = 1").drop("rn")


def tiered(units: DataFrame, by_code: DataFrame, by_town: DataFrame, by_district: DataFrame) -> DataFrame:
    """Seat and method of every unit: by its code, else its town, else its district, else none."""
    rows = units.join(by_code.select("code", F.col("n").alias("n1")), "code", "left").join(by_town.select("s", "town", F.col("n").alias("n2")), ["s", "town"], "left").join(by_district.select("s", "district", F.col("n").alias("n3")), ["s", "district"], "left")
    method = F.when(F.col("n1").isNotNull(), "code").when(F.col("n2").isNotNull(), "town").when(F.col("n3").isNotNull(), "district").otherwise("none")
    return rows.select("s", "code", F.coalesce("n1", "n2", "n3").alias("seat"), method.alias("method"), "pop")


def placement_report(placed: DataFrame) -> DataFrame:
    """Units and people by state and method, and the share of the state's people."""
    sums = placed.groupBy("s", "method").agg(F.count(F.lit(1)).alias("units"), F.sum("pop").alias("pop"))
    return sums.withColumn("share", F.col("pop").cast("double") * 100 / F.sum("pop").over(Window.partitionBy("s")))


def reads(rated: DataFrame, state: DataFrame, most: int = 2) -> DataFrame:
    """What stands out of a seat against its state: rates 1.1 times as high or 0.9 times as low, the strongest first."""
    pairs = rated.join(state.select("s", *[F.col(c).alias(f"state_{c}") for c in ("literacy", "urban", "power")]), "s")
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), (F.col(c) / F.when(F.col(f"state_{c}") != 0, F.col(f"state_{c}"))).alias("times")) for c in ("literacy", "urban", "power")]))
    rows = pairs.select("s", "n", told.alias("x")).select("s", "n", "x.field", "x.times").where((F.col("times") >= 1.1) | (F.col("times") <= 0.9))
    w = Window.partitionBy("s", "n").orderBy(F.desc(F.round(F.abs(F.col("times") - 1), 9)), "field")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def overlaid(a: DataFrame, b: DataFrame, least: float = 0.1) -> DataFrame:
    """Areal overlay on cells: rectangles (id, x1, y1, x2, y2 in whole cells) of two layers by the share of a's area in b.

    Every rectangle is cut into unit cells, which are joined by equality. Shares below least go, but for the largest,
    and the others are made whole.
    """
    cells = lambda d, name: d.select(F.col("id").alias(name), F.explode(F.sequence("x1", F.col("x2") - 1)).alias("x"), "y1", "y2").select(name, "x", F.explode(F.sequence("y1", F.col("y2") - 1)).alias("y"))
    pairs = cells(a, "a").join(cells(b, "b"), ["x", "y"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("cells"))
    w = Window.partitionBy("a")
    rows = pairs.withColumn("share", F.col("cells").cast("double") / F.sum("cells").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("cells"), "b")))
    kept = rows.where((F.col("share") >= least) | (F.col("nth") == 1))
    return kept.select("a", "b", (F.col("share") / F.sum("share").over(w)).alias("share"))
