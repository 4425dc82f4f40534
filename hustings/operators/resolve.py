"""From candidates to contests: winners, margins, ranks, histories and what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.canon import comparable

CONTEST = ("arena", "s", "y", "n")


def ranked(cand: DataFrame) -> DataFrame:
    """Candidates with rank (votes, ties by party), share, the contest's total, and the gap to the next one."""
    order = Window.partitionBy(*CONTEST).orderBy(F.desc_nulls_last("votes"), "p")
    whole = Window.partitionBy(*CONTEST)
    rows = cand.select("*", F.row_number().over(order).alias("rank"), F.lead("p").over(order).alias("q"), F.lead("votes").over(order).alias("qv"), F.first("votes").over(order).alias("top"), F.sum("votes").over(whole).alias("total"))
    return rows.withColumn("share", F.when(F.col("total") > 0, F.col("votes").cast("double") * 100 / F.col("total")))


def contests(cand: DataFrame) -> DataFrame:
    """Winner p with share v and margin m over the runner-up q in per cent; an unopposed winner has neither q nor m."""
    m = F.when(F.col("total") > 0, (F.col("votes") - F.col("qv")).cast("double") * 100 / F.col("total"))
    return ranked(cand).where("rank = 1").select(*CONTEST, "p", F.col("share").alias("v"), "q", m.alias("m"), "total", F.col("votes").alias("wv"))


def top_candidates(cand: DataFrame, most: int = 5) -> DataFrame:
    return ranked(cand).where(F.col("rank") <= most).select(*CONTEST, "p", "votes", "rank", "share")


def candidate_gaps(cand: DataFrame) -> DataFrame:
    """Each candidate's votes behind the winner and ahead of the next, and the latter in per cent of all."""
    ahead = F.col("votes") - F.col("qv")
    return ranked(cand).select(*CONTEST, "p", "rank", (F.col("top") - F.col("votes")).alias("behind"), ahead.alias("ahead"), (ahead.cast("double") * 100 / F.col("total")).alias("ahead_pct"))


def active(seats: DataFrame, year: int) -> DataFrame:
    """All seats of each state's latest election up to the year."""
    w = Window.partitionBy("arena", "s")
    return seats.where(F.col("y") <= year).withColumn("last", F.max("y").over(w)).where("y = last").drop("last")


def with_previous(seats: DataFrame) -> DataFrame:
    """Seats with their previous election's year, winner and margin, and status: flipped, held, not-comparable or no-previous."""
    w = Window.partitionBy("arena", "s", "j").orderBy("y")
    rows = seats.select("*", F.lag("y").over(w).alias("prev_y"), F.lag("p").over(w).alias("prev_p"), F.lag("m").over(w).alias("prev_m"))
    same = comparable(F.col("arena"), F.col("s"), F.col("prev_y"), F.col("y"))
    status = F.when(F.col("prev_y").isNull(), "no-previous").when(~same, "not-comparable").when(F.col("prev_p") == F.col("p"), "held").otherwise("flipped")
    return rows.withColumn("status", status)


def changes(seats: DataFrame, year: int) -> DataFrame:
    """with_previous() of the seats that are active in the year."""
    w = Window.partitionBy("arena", "s")
    return with_previous(seats.where(F.col("y") <= year)).withColumn("last", F.max("y").over(w)).where("y = last").drop("last")


def streaks(seats: DataFrame, least: int = 3) -> DataFrame:
    """Fortresses: the run of wins of one party that ends at a seat's latest election and is not cut by a boundary break."""
    w = Window.partitionBy("arena", "s", "j").orderBy("y")
    whole = Window.partitionBy("arena", "s", "j")
    rows = with_previous(seats).withColumn("island", F.sum(F.when(F.col("status") == "held", 0).otherwise(1)).over(w))
    rows = rows.withColumn("last", F.max("island").over(whole)).where("island = last")
    return rows.groupBy("arena", "s", "j").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("wins"), F.min("y").alias("since")).where(F.col("wins") >= least)


def churn(seats: DataFrame, least: int = 2) -> DataFrame:
    """Seats with so many comparable pairs of elections and flips."""
    counts = with_previous(seats).groupBy("arena", "s", "j").agg(F.count_if(F.col("status").isin("held", "flipped")).alias("pairs"), F.count_if(F.col("status") == "flipped").alias("flips"))
    return counts.where((F.col("pairs") >= least) & (F.col("flips") >= least))


def stronghold_classes(seats: DataFrame) -> DataFrame:
    """safe (one party, at least two elections), lean (60 % of elections) or swing, over the elections comparable to the state's last."""
    state = Window.partitionBy("arena", "s")
    rows = seats.withColumn("last", F.max("y").over(state))
    rows = rows.where(comparable(F.col("arena"), F.col("s"), F.col("y"), F.col("last")))
    wins = rows.groupBy("arena", "s", "j", "p").agg(F.count(F.lit(1)).alias("wins"))
    seat = Window.partitionBy("arena", "s", "j")
    best = wins.select("*", F.sum("wins").over(seat).alias("total"), F.row_number().over(seat.orderBy(F.desc("wins"), "p")).alias("rn")).where("rn = 1")
    kind = F.when((F.col("total") >= 2) & (F.col("wins") == F.col("total")), "safe").when(F.col("wins") >= 0.6 * F.col("total"), "lean").otherwise("swing")
    return best.select("arena", "s", "j", F.when(kind != "swing", F.col("p")).alias("p"), "wins", "total", kind.alias("class"))


def eroding(seats: DataFrame, drop: float = 5.0) -> DataFrame:
    """Seats won three times in a row by one party, with the margin down by more than so much, at their latest election."""
    w = Window.partitionBy("arena", "s", "j").orderBy("y")
    rows = seats.select("arena", "s", "j", "y", "p", "m", F.lag("p", 1).over(w).alias("p1"), F.lag("p", 2).over(w).alias("p2"), F.lag("m", 1).over(w).alias("m1"), F.lead("y").over(w).alias("later"))
    return rows.where(F.col("later").isNull() & (F.col("p") == F.col("p1")) & (F.col("p") == F.col("p2")) & (F.col("m1") - F.col("m") > drop)).select("arena", "s", "j", "y", "p", (F.col("m1") - F.col("m")).alias("lost"))


def biographies(seats: DataFrame) -> DataFrame:
    """Elections, flips, holds, closest and safest margin, mean margin and turnout, and bipolarity of every seat."""
    rows = with_previous(seats)
    return rows.groupBy("arena", "s", "j").agg(
        F.count(F.lit(1)).alias("elections"), F.count_distinct("p").alias("winners"), F.count_if(F.col("status") == "flipped").alias("flips"), F.count_if(F.col("status") == "held").alias("holds"),
        F.min("m").alias("closest"), F.max("m").alias("safest"), F.avg("m").alias("mean_margin"), F.avg("t").alias("mean_turnout"), F.avg(F.col("v") + (F.col("v") - F.col("m"))).alias("bipolarity"),
    )
