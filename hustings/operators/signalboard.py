"""The board of all seven signals of a house: what each says, how grave it is, whom it names, in order of its score.

A house is a state in state elections and the whole of them in national ones (columns arena, scope). seats: the active
election's seats (arena, scope, s, n, p, q, v, m, r); history: all elections' (with y); parties: arena, scope, y, p, v, wo.
Seats are summed by party or category before anything is ranked, so windows are over a house's few parties.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.canon import reservation_category

HOUSE = ["arena", "scope"]
#: What a signal scores by severity, lines shown of each.
CRITICAL, WATCH, NOTE, LINES = 100, 60, 30, 8
COLUMNS = ["arena", "scope", "signal", "theme", "severity", "party", "score", "lines"]


def nearest(x: Column) -> Column:
    """To the next integer, halves up."""
    return F.floor(x + 0.5)


def house() -> Window:
    return Window.partitionBy(*HOUSE)


def leading(rows: DataFrame, by: str, descending: bool = True) -> DataFrame:
    """Each house's party with the most (or least) of by; ties to the smaller name; lines: how many parties there are."""
    order = F.desc(by) if descending else F.asc(by)
    return rows.withColumn("lines", F.count(F.lit(1)).over(house())).withColumn("nth", F.row_number().over(house().orderBy(order, "p"))).where("nth = 1").drop("nth")


def signal(rows: DataFrame, name: str, theme: str, severity: Column | str, score: Column) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select(*HOUSE, F.lit(name).alias("signal"), F.lit(theme).alias("theme"), severity.alias("severity"), F.col("p").alias("party"), score.cast("double").alias("score"), F.col("lines").cast("long").alias("lines"))


def vote_efficiency(seats: DataFrame, parties: DataFrame, floor: float = 2.0, least: float = 8.0) -> DataFrame:
    """Whose share of seats falls shortest of its share of votes, where the widest gaps lie so far apart."""
    size = seats.groupBy(*HOUSE).agg(F.count(F.lit(1)).alias("size"))
    latest = parties.withColumn("last", F.max("y").over(house())).where((F.col("y") == F.col("last")) & (F.col("v") >= floor))
    gaps = latest.join(size, HOUSE).withColumn("gap", F.col("wo") * 100.0 / F.col("size") - F.col("v"))
    spread = gaps.withColumn("most", F.max("gap").over(house()))
    worst = leading(spread, "gap", descending=False).where((F.col("lines") >= 2) & (F.col("most") - F.col("gap") >= least))
    return signal(worst, "efficiency", "momentum", "watch", WATCH + F.least(F.lit(35.0), F.col("most") - F.col("gap")))


def thin_margins(seats: DataFrame, below: float = 5.0, wins: int = 5, lead: int = 10, share: float = 0.12, grave: int = 30) -> DataFrame:
    """Who holds most seats by thin margins, if it holds enough seats and enough of them so."""
    by = seats.groupBy(*HOUSE, "p").agg(F.count(F.lit(1)).alias("won"), F.count_if(F.col("m") < below).alias("thin")).where((F.col("won") >= wins) & (F.col("thin") > 0))
    part = F.col("thin").cast("double") / F.col("won")
    best = leading(by, "thin").where((F.col("won") >= lead) & (part >= share)).withColumn("pct", nearest(part * 100))
    severity = F.when(F.col("pct") >= grave, "critical").otherwise("watch")
    return signal(best, "thinbook", "soft", severity, F.when(F.col("pct") >= grave, CRITICAL).otherwise(WATCH) + F.col("pct"))


def split_fields(seats: DataFrame, below: float = 40.0, least: int = 30, floor: int = 4, share: float = 0.08) -> DataFrame:
    """Who has most wins with less than so much of the vote, where a house has enough of them."""
    decided = seats.where("v is not null").groupBy(*HOUSE).agg(F.count(F.lit(1)).alias("decided"), F.count_if(F.col("v") < below).alias("under")).where(F.col("decided") >= least)
    enough = decided.where(F.col("under") >= F.greatest(F.lit(float(floor)), share * F.col("decided")))
    by = seats.where(F.col("v") < below).groupBy(*HOUSE, "p").agg(F.count(F.lit(1)).alias("wins"))
    return signal(leading(by, "wins").join(enough, HOUSE), "divided", "soft", "watch", WATCH + nearest(F.col("under") * 100.0 / F.col("decided")))


def softening(history: DataFrame, drop: float = 5.0, least: int = 3) -> DataFrame:
    """Who has most seats that it won three times in a row, with a margin that has fallen since the last time."""
    w = Window.partitionBy(*HOUSE, "s", "n").orderBy("y")
    rows = history.select(*HOUSE, "s", "n", "y", "p", "m", F.lag("p", 1).over(w).alias("p1"), F.lag("p", 2).over(w).alias("p2"), F.lag("m", 1).over(w).alias("m1"))
    last = rows.withColumn("last", F.max("y").over(house())).where("y = last and p = p1 and p = p2").where(F.col("m") < F.col("m1") - drop)
    by = last.groupBy(*HOUSE, "p").agg(F.count(F.lit(1)).alias("seats"))
    lead = leading(by.withColumn("whole", F.sum("seats").over(house())), "seats").where((F.col("whole") >= least) & (F.col("seats") >= least))
    return signal(lead, "eroding", "soft", "watch", WATCH + 2 * F.col("seats"))


def margin_of_control(seats: DataFrame, least: int = 30) -> DataFrame:
    """The largest party, against the line of majority: critical on a small cushion, a note on a large one or none."""
    by = seats.groupBy(*HOUSE, "p").agg(F.count(F.lit(1)).alias("won")).withColumn("size", F.sum("won").over(house()))
    lead = leading(by, "won").where(F.col("size") >= least).withColumn("cushion", F.col("won") - F.floor(F.col("size") / 2) - 1)
    critical = (F.col("cushion") >= 0) & (F.col("cushion") <= F.greatest(F.lit(3.0), 0.03 * F.col("size")))
    score = F.when(critical, CRITICAL + 10).when(F.col("cushion") >= 0, NOTE + 10).otherwise(NOTE + 20)
    return signal(lead, "tipping", "control", F.when(critical, "critical").otherwise("note"), score)


def turning_seats(seats: DataFrame, least: int = 30, more: int = 4) -> DataFrame:
    """The seats that a house turns on, thinnest first: the leader's own up to its cushion and some, or what it must win to a majority and some."""
    by = seats.groupBy(*HOUSE, "p").agg(F.count(F.lit(1)).alias("won")).withColumn("size", F.sum("won").over(house()))
    lead = leading(by, "won").where(F.col("size") >= least).select(*HOUSE, F.col("p").alias("leader"), (F.col("won") - F.floor(F.col("size") / 2) - 1).alias("cushion"))
    rows = seats.where("m is not null").join(lead, HOUSE).where(F.when(F.col("cushion") >= 0, F.col("p") == F.col("leader")).otherwise(F.col("q") == F.col("leader")))
    ranked = rows.withColumn("nth", F.row_number().over(house().orderBy("m", "s", "n")))
    return ranked.where(F.col("nth") <= F.abs("cushion") + more).select(*HOUSE, "leader", "cushion", "nth", "s", "n", "p", "q", "m")


def momentum(parties: DataFrame, floor: float = 3.0, slope: float = 1.0, fit: float = 0.5) -> DataFrame:
    """Who gains most votes an election, on a line that fits, over three elections or more."""
    years = parties.select(*HOUSE, "y").distinct().withColumn("x", F.row_number().over(house().orderBy("y")).cast("double"))
    fits = parties.join(years, [*HOUSE, "y"]).groupBy(*HOUSE, "p").agg(F.regr_slope("v", "x").alias("slope"), F.regr_sxy("v", "x").alias("xy"), F.regr_sxx("v", "x").alias("xx"), F.regr_syy("v", "x").alias("yy"), F.count("v").alias("points"), F.max_by("v", F.when(F.col("v").isNotNull(), F.col("y"))).alias("now"))
    fits = fits.where((F.col("points") >= 3) & (F.col("now") >= floor)).withColumn("r2", F.when(F.col("yy") > 0, F.col("xy") * F.col("xy") / (F.col("xx") * F.col("yy"))).otherwise(0.0))
    riser = leading(fits, "slope").where((F.col("lines") >= 2) & (F.col("slope") >= slope) & (F.col("r2") >= fit))
    return signal(riser, "momentum", "momentum", "note", NOTE + F.least(F.lit(25.0), F.col("slope") * 5))


def social_coalition(seats: DataFrame, least: int = 8, spread: int = 25) -> DataFrame:
    """Whether the leader wins far more of one category of seats than of another."""
    lead = leading(seats.groupBy(*HOUSE, "p").agg(F.count(F.lit(1)).alias("won")), "won").select(*HOUSE, F.col("p").alias("leader"))
    by = seats.withColumn("category", reservation_category(F.coalesce("r", F.lit("")))).join(lead, HOUSE).groupBy(*HOUSE, "leader", "category").agg(F.count(F.lit(1)).alias("of"), F.count_if(F.col("p") == F.col("leader")).alias("won"))
    rates = by.where(F.col("of") >= least).withColumn("pct", nearest(F.col("won") * 100.0 / F.col("of")))
    ends = rates.groupBy(*HOUSE, F.col("leader").alias("p")).agg(F.count(F.lit(1)).alias("lines"), (F.max("pct") - F.min("pct")).alias("spread")).where((F.col("lines") >= 2) & (F.col("spread") >= spread))
    return signal(ends, "reservation", "coalition", "note", NOTE + F.col("spread") / 4)


def signal_board(seats: DataFrame, history: DataFrame, parties: DataFrame) -> DataFrame:
    """COLUMNS of all signals that a house gives, with their place by score (place), shown lines and how many more there are."""
    found = [vote_efficiency(seats, parties), thin_margins(seats), split_fields(seats), softening(history), margin_of_control(seats), momentum(parties), social_coalition(seats)]
    every = reduce(DataFrame.unionByName, found)
    placed = every.withColumn("place", F.row_number().over(house().orderBy(F.desc(F.round("score", 6)), "signal")))
    return placed.select(*COLUMNS, "place", F.greatest(F.lit(0).cast("long"), F.col("lines") - LINES).alias("more"))
