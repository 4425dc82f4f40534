"""Gates, precedence merges and apportionment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gated(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are in the allow-list."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_semi")


def skipped(rows: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """How many rows of each key the allow-list skips."""
    return rows.join(allowed.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("skipped"))


def base_wins(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows, and those overlay rows whose keys base lacks altogether."""
    return base.unionByName(overlay.join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns))


def preferred(rows: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The whole record of the lowest priority for each key; records are never mixed."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(priority))).where("rn = 1").drop("rn")


def agreeing_elections(overlay: DataFrame, seats: DataFrame, least: float = 0.98) -> DataFrame:
    """Elections of which the overlay's winner is the recorded one in at least such a share of its seats."""
    rows = overlay.select("arena", "s", "y", "n", F.col("p").alias("op")).join(seats.select("arena", "s", "y", "n", "p"), ["arena", "s", "y", "n"])
    return rows.groupBy("arena", "s", "y").agg(F.avg((F.col("op") == F.col("p")).cast("double")).alias("agree")).where(F.col("agree") >= least)


def complete_elections(cand: DataFrame, seats: DataFrame, share: float = 0.98, mean: float = 3.0) -> DataFrame:
    """Elections with candidates of nearly all seats, and so many a seat on average."""
    seen = cand.groupBy("arena", "s", "y").agg(F.count_distinct("n").alias("seen"), F.count(F.lit(1)).alias("rows"))
    due = seats.groupBy("arena", "s", "y").agg(F.count(F.lit(1)).alias("due"))
    return seen.join(due, ["arena", "s", "y"]).where((F.col("seen") >= share * F.col("due")) & (F.col("rows") >= mean * F.col("seen")))


def checked_electors(rows: DataFrame) -> DataFrame:
    """Elector rows with electors, and not more voters than those; the counts by gender only if they add up."""
    sound = rows.where((F.col("e") > 0) & (F.col("voters") <= 1.02 * F.col("e")))
    adds = F.abs(F.col("men") + F.col("women") - F.col("e")) <= F.greatest(F.lit(50.0), 0.005 * F.col("e"))
    return sound.select("arena", "s", "y", "n", "e", "voters", *[F.when(adds, F.col(c)).alias(c) for c in ("men", "women")])


def rounded_to_total(rows: DataFrame, group: str, key: str, value: str, total: str) -> DataFrame:
    """Largest-remainder rounding: integers that add up to each group's total."""
    w = Window.partitionBy(group)
    part = F.floor(value).cast("long")
    rest = rows.select("*", part.alias("whole"), (F.col(value) - part).alias("rest"))
    short = F.col(total) - F.sum("whole").over(w)
    rank = F.row_number().over(w.orderBy(F.desc("rest"), key))
    return rest.select("*", short.alias("short"), rank.alias("rank")).select(group, key, value, (F.col("whole") + (F.col("rank") <= F.col("short")).cast("long")).alias("rounded"))


def without_zeros(rows: DataFrame, group: str, key: str, rounded: str) -> DataFrame:
    """rows whose zeros are ones, taken one after the other from the group's largest at that time, of these the first by key; a group with
    less in all than members stays.

    Taking from the largest lowers the top of the group to one level. How far down the top reaches is told by running sums from
    the largest on: as many members as can be lowered to the next one's value for what is taken. Those that are lowered once more
    than the others are the first by key.
    """
    whole = Window.partitionBy(group)
    down = whole.orderBy(F.desc("x"), key)
    x = rows.withColumn("x", F.col(rounded).cast("long")).withColumns({"zeros": F.count_if(F.col("x") == 0).over(whole), "members": F.count(F.lit(1)).over(whole), "sum": F.sum("x").over(whole)})
    x = x.withColumn("taken", F.when(F.col("sum") >= F.col("members"), F.col("zeros")).otherwise(0))
    x = x.withColumns({"nth": F.row_number().over(down), "upto": F.sum("x").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    # The member is in the top if those above it can be lowered to its value for what is taken.
    x = x.withColumn("top", (F.col("taken") > 0) & (F.col("upto") - F.col("x") - (F.col("nth") - 1) * F.col("x") <= F.col("taken")))
    x = x.withColumns({"size": F.count_if("top").over(whole), "held": F.sum(F.when(F.col("top"), F.col("x"))).over(whole) - F.col("taken")})
    x = x.withColumn("place", F.row_number().over(Window.partitionBy(group, "top").orderBy(key)))
    level, more = F.floor(F.try_divide("held", "size")), F.col("held") % F.when(F.col("size") > 0, F.col("size"))
    lowered = level + F.when(F.col("place") > F.col("size") - more, 1).otherwise(0)
    value = F.when(F.col("top"), lowered).when((F.col("taken") > 0) & (F.col("x") == 0), 1).otherwise(F.col("x"))
    return x.select(*[F.col(c) for c in rows.columns if c != rounded], value.cast("long").alias(rounded))


def weighted_rates(units: DataFrame, keys: list[str], weight: str, rates: list[str]) -> DataFrame:
    """Weighted means that skip nulls: each rate's weights are those of the rows that have it."""
    w = F.col(weight)
    return units.groupBy(*keys).agg(*[(F.sum(w * F.col(r)) / F.sum(F.when(F.col(r).isNotNull(), w))).alias(r) for r in rates])


def apportioned(wards: DataFrame, electors: DataFrame, default: float = 0.65) -> DataFrame:
    """Shares of split towns' people by seat, from electors.

    A state's ratio of electors to people is the median over its seats that have no part in a split town. What a seat's
    electors leave beyond its people outside such towns at that ratio is its residual, which its split towns divide by its
    weights in them; a town's seats share by what they get of it, or by their weights where that is nothing.
    """
    outside = wards.groupBy("s", "n").agg(F.sum(F.when(~F.col("split"), F.col("pop"))).alias("pure"), F.max("split").alias("touched"))
    frame = electors.join(outside, ["s", "n"], "left").withColumn("pure", F.coalesce("pure", F.lit(0.0)))
    ratio = frame.where("pure > 0 and e > 0 and not touched").groupBy("s").agg(F.percentile(F.col("e") / F.col("pure"), 0.5).alias("ratio"))
    left = frame.join(ratio, "s", "left").select("s", "n", F.greatest(F.lit(0.0), F.coalesce("e", F.lit(0)) - F.coalesce("ratio", F.lit(default)) * F.col("pure")).alias("residual"))
    split = wards.where("split").select("s", "town", "n", "weight").join(left, ["s", "n"], "left")
    part = F.coalesce("residual", F.lit(0.0)) * F.try_divide(F.col("weight"), F.sum("weight").over(Window.partitionBy("s", "n")))
    w = Window.partitionBy("s", "town")
    parts = split.withColumn("x", part)
    return parts.select("s", "town", "n", F.when(F.sum("x").over(w) > 0, F.col("x") / F.sum("x").over(w)).otherwise(F.col("weight") / F.sum("weight").over(w)).alias("share"))


def plausible(profiles: DataFrame, low: float = 0.6, high: float = 1.6) -> DataFrame:
    """Seats with the ratio of electors to people, and why a seat is gated out: no people, no electors, or far from the state's median."""
    ratio = F.when((F.col("pop") > 0) & (F.col("e") > 0), F.col("e") / F.col("pop"))
    middle = profiles.groupBy("s").agg(F.percentile(ratio, 0.5).alias("middle"))
    rows = profiles.join(middle, "s").withColumn("ratio", ratio)
    why = F.when(F.coalesce("pop", F.lit(0)) <= 0, "no people").when(F.coalesce("e", F.lit(0)) <= 0, "no electors").when(~F.col("ratio").between(low * F.col("middle"), high * F.col("middle")), "implausible").otherwise("ok")
    return rows.select("s", "n", "ratio", why.alias("reason"))


def nearest_year(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (y, other_y): for each of left's years the nearest of right's, the earlier at a tie."""
    pairs = left.select(*keys, "y").distinct().join(right.select(*keys, F.col("y").alias("other_y")).distinct(), keys)
    w = Window.partitionBy(*keys, "y").orderBy(F.abs(F.col("y") - F.col("other_y")), "other_y")
    return pairs.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def split_tickets(ge: DataFrame, ae: DataFrame, pairs: DataFrame, most: int = 6, least: float = 5.0) -> DataFrame:
    """Parties' shares in both arenas of a seat at nearest elections, where one of them is so large; the first so many of a seat."""
    a = ae.select("s", F.col("y").alias("other_y"), "n", "p", F.col("share").alias("av"))
    g = ge.select("s", "y", "n", "p", F.col("share").alias("gv"))
    rows = g.join(pairs, ["s", "y"]).join(a, ["s", "other_y", "n", "p"]).where(F.greatest("gv", "av") >= least)
    w = Window.partitionBy("s", "y", "n").orderBy(F.desc("gv"), "p")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("s", "y", F.col("other_y").alias("ay"), "n", "p", "gv", "av", "rank")
