"""Aggregates over seats, candidates and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.canon import alliance_base, pooling_group


def tally(seats: DataFrame, *keys: str) -> DataFrame:
    return seats.groupBy(*keys).agg(F.count(F.lit(1)).alias("seats"))


def presence(seats: DataFrame, runner_up: float = 0.4, most: int = 24) -> DataFrame:
    """Parties by wins and second places, the latter weighted; the first so many of each arena."""
    roles = F.explode(F.array(F.struct(F.col("p").alias("party"), F.lit(1.0).alias("w")), F.struct(F.col("q").alias("party"), F.lit(runner_up).alias("w"))))
    sums = seats.select("arena", roles.alias("x")).where("x.party is not null").groupBy("arena", F.col("x.party").alias("p")).agg(F.round(F.sum("x.w"), 6).alias("weight"))
    w = Window.partitionBy("arena").orderBy(F.desc("weight"), "p")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def party_summary(cand: DataFrame) -> DataFrame:
    """By arena, state, year and party: seats contested and won, votes, and share of the state's votes."""
    w = Window.partitionBy("arena", "s", "y", "n").orderBy(F.desc("votes"), "p")
    rows = cand.withColumn("first", F.row_number().over(w) == 1)
    sums = rows.groupBy("arena", "s", "y", "p").agg(F.count_distinct("n").alias("f"), F.count_if("first").alias("wo"), F.sum("votes").alias("votes"))
    return sums.withColumn("v", F.col("votes").cast("double") * 100 / F.sum("votes").over(Window.partitionBy("arena", "s", "y")))


def national_summary(summary: DataFrame) -> DataFrame:
    """party_summary() over all states."""
    sums = summary.groupBy("arena", "y", "p").agg(F.sum("f").alias("f"), F.sum("wo").alias("wo"), F.sum("votes").alias("votes"))
    return sums.withColumn("v", F.col("votes").cast("double") * 100 / F.sum("votes").over(Window.partitionBy("arena", "y")))


def alliance_summary(summary: DataFrame) -> DataFrame:
    """A national summary by alliance."""
    return summary.groupBy("arena", "y", alliance_base(F.col("a")).alias("a")).agg(F.sum("f").alias("f"), F.sum("wo").alias("wo"), F.round(F.sum("v"), 6).alias("v"))


def turnout_series(seats: DataFrame) -> DataFrame:
    """Mean turnout by arena and year, and its change."""
    means = seats.groupBy("arena", "y").agg(F.avg("t").alias("t"))
    return means.withColumn("delta", F.col("t") - F.lag("t").over(Window.partitionBy("arena").orderBy("y")))


def weighted_turnout(seats: DataFrame) -> DataFrame:
    """National turnout: states' means weighted by their seats."""
    states = seats.groupBy("arena", "y", "s").agg(F.avg("t").alias("t"), F.count(F.lit(1)).alias("w"))
    return states.groupBy("arena", "y").agg((F.sum(F.col("t") * F.col("w")) / F.sum("w")).alias("t"))


def retention(changed: DataFrame, top: int = 9) -> DataFrame:
    """Seats from party to party over comparable pairs; all but the largest previous holders are Other."""
    pairs = changed.where(F.col("status").isin("held", "flipped"))
    held = pairs.groupBy("arena", "prev_p").agg(F.count(F.lit(1)).alias("had"))
    order = Window.partitionBy("arena").orderBy(F.desc("had"), "prev_p")
    names = held.select("arena", "prev_p", F.when(F.row_number().over(order) <= top, F.col("prev_p")).otherwise("Other").alias("was"))
    named = pairs.select("arena", "prev_p", F.col("p").alias("now")).join(names, ["arena", "prev_p"])
    return named.groupBy("arena", "was", "now").agg(F.count(F.lit(1)).alias("seats"))


def net_change(changed: DataFrame, *keys: str) -> DataFrame:
    """Seats now, before and net of every party, by the keys."""
    sides = F.explode(F.array(F.struct(F.col("p").alias("party"), F.lit(1).alias("now"), F.lit(0).alias("before")), F.struct(F.col("prev_p").alias("party"), F.lit(0).alias("now"), F.lit(1).alias("before"))))
    rows = changed.where(F.col("status").isin("held", "flipped")).select(*keys, sides.alias("x"))
    return rows.groupBy(*keys, F.col("x.party").alias("p")).agg(F.sum("x.now").alias("now"), F.sum("x.before").alias("before"), F.sum(F.col("x.now") - F.col("x.before")).alias("net"))


def extremes(net: DataFrame, number: int = 7) -> DataFrame:
    """The parties with the largest and the smallest net change of each arena."""
    up, down = (Window.partitionBy("arena").orderBy(order, "p") for order in (F.desc("net"), F.asc("net")))
    return net.select("*", F.row_number().over(up).alias("up"), F.row_number().over(down).alias("down")).where((F.col("up") <= number) | (F.col("down") <= number)).drop("up", "down")


def flows(changed: DataFrame) -> DataFrame:
    return changed.where("status = 'flipped'").groupBy("arena", "s", F.col("prev_p").alias("was"), F.col("p").alias("now")).agg(F.count(F.lit(1)).alias("seats"))


def rivalries(seats: DataFrame, close: Column | None = None) -> DataFrame:
    """Unordered pairs of winner and runner-up with the wins of each; `close` picks the seats."""
    rows = (seats if close is None else seats.where(close)).where("q is not null")
    return rows.groupBy("arena", F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2")).agg(F.count(F.lit(1)).alias("met"), F.count_if(F.col("p") <= F.col("q")).alias("wins1"), F.count_if(F.col("p") > F.col("q")).alias("wins2"))


def by_reservation(seats: DataFrame) -> DataFrame:
    return seats.groupBy("arena", "y", "p").pivot("r", ["GEN", "SC", "ST"]).agg(F.count(F.lit(1))).na.fill(0)


def efficiency(national: DataFrame, least: float = 4.0) -> DataFrame:
    """Seat share minus vote share, of parties with so much of the vote; mean over at least two elections."""
    rows = national.withColumn("ss", F.col("wo").cast("double") * 100 / F.sum("wo").over(Window.partitionBy("arena", "y"))).where(F.col("v") >= least)
    return rows.groupBy("arena", "p").agg(F.avg(F.col("ss") - F.col("v")).alias("gap"), F.count(F.lit(1)).alias("elections")).where("elections >= 2")


def strike_rates(national: DataFrame, most: int = 6) -> DataFrame:
    """Wins per seat contested in per cent, of the parties with the highest peak share."""
    peak = national.groupBy("arena", "p").agg(F.max("v").alias("peak")).withColumn("rank", F.row_number().over(Window.partitionBy("arena").orderBy(F.desc("peak"), "p"))).where(F.col("rank") <= most)
    return national.join(peak.select("arena", "p"), ["arena", "p"]).select("arena", "y", "p", F.floor(F.col("wo").cast("double") * 100 / F.col("f") + 0.5).alias("strike"))


def glance(seats: DataFrame) -> DataFrame:
    """Every state of an arena: leader, runner-up, seats, close seats, turnout, majority, gap and parties."""
    counts = seats.groupBy("arena", "s", "p").agg(F.count(F.lit(1)).alias("won"))
    w = Window.partitionBy("arena", "s").orderBy(F.desc("won"), "p")
    order = counts.withColumn("rank", F.row_number().over(w))
    led = order.groupBy("arena", "s").agg(F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("leader"), F.max(F.when(F.col("rank") == 1, F.col("won"))).alias("won"), F.max(F.when(F.col("rank") == 2, F.col("p"))).alias("second"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("won"))), F.lit(0)).alias("second_won"), F.count(F.lit(1)).alias("parties"))
    of = seats.groupBy("arena", "s").agg(F.count(F.lit(1)).alias("seats"), F.count_if(F.col("m") < 5).alias("close"), F.avg("t").alias("t"))
    return led.join(of, ["arena", "s"]).select("*", (F.col("won") - F.col("second_won")).alias("gap"), (F.floor(F.col("seats") / 2) + 1).alias("majority"))


def states_led(seats: DataFrame) -> DataFrame:
    return glance(seats).groupBy("arena", F.col("leader").alias("p")).agg(F.count(F.lit(1)).alias("states"))


def pooled(cand: DataFrame) -> DataFrame:
    """Alliance pooling: seats won as they are and if each alliance's votes were one, and friendly fights."""
    keys = ["arena", "s", "y", "n"]
    rows = cand.withColumn("g", pooling_group(F.col("p"), F.col("a")))
    won = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "p"))).where("rn = 1").select(*keys, F.col("g").alias("actual"))
    sums = rows.groupBy(*keys, "g").agg(F.sum("votes").alias("votes"), F.count_distinct("p").alias("parties"))
    best = sums.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "g"))).where("rn = 1").select(*keys, F.col("g").alias("pooled"))
    ok = F.col("g").endswith("Alliance")
    fights = sums.where(ok & (F.col("parties") >= 2)).groupBy("arena", "s", "y", "g").agg(F.count(F.lit(1)).alias("ff"))
    both = won.join(best, keys)
    sides = F.explode(F.array(F.struct(F.col("actual").alias("g"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("pooled").alias("g"), F.lit(0).alias("a"), F.lit(1).alias("b"))))
    counts = both.select("arena", "s", "y", sides.alias("x")).groupBy("arena", "s", "y", F.col("x.g").alias("g")).agg(F.sum("x.a").alias("actual"), F.sum("x.b").alias("pooled"))
    joined = counts.where(ok).join(fights, ["arena", "s", "y", "g"], "full")
    out = joined.select("arena", "s", "y", "g", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("actual", "pooled", "ff")])
    return out.where("ff > 0 or actual != pooled")


def bypoll_ledger(by: DataFrame, least: int = 5) -> DataFrame:
    """Per party: by-elections defended, held and gained, and the rate of holding."""
    sides = F.explode(F.array(
        F.struct(F.col("prev").alias("party"), F.lit(1).alias("d"), (F.col("ret") == "Y").cast("int").alias("h"), F.lit(0).alias("g")),
        F.struct(F.col("p").alias("party"), F.lit(0).alias("d"), F.lit(0).alias("h"), (F.col("ret") == "N").cast("int").alias("g")),
    ))
    sums = by.where("ret is not null").select(sides.alias("x")).groupBy(F.col("x.party").alias("p")).agg(F.sum("x.d").alias("defended"), F.sum("x.h").alias("held"), F.sum("x.g").alias("gained"))
    return sums.where(F.col("defended") + F.col("gained") >= least).withColumn("rate", F.when(F.col("defended") > 0, F.col("held").cast("double") * 100 / F.col("defended")))


def composition(seats: DataFrame, parents: DataFrame) -> DataFrame:
    """Seats won inside each parent, its leader, and of how many."""
    won = seats.join(parents, "s").groupBy("arena", "pc", "y", "p").agg(F.count(F.lit(1)).alias("won"))
    w = Window.partitionBy("arena", "pc", "y")
    return won.select("*", F.sum("won").over(w).alias("of"), F.row_number().over(w.orderBy(F.desc("won"), "p")).alias("rn")).where("rn = 1").drop("rn")


def missing_shares(seats: DataFrame) -> DataFrame:
    """Per cent of seats of an election without margin or runner-up; whether all winners lack a margin."""
    return seats.groupBy("arena", "s", "y").agg((F.count_if(F.col("m").isNull()).cast("double") * 100 / F.count(F.lit(1))).alias("no_margin"), (F.count_if(F.col("q").isNull()).cast("double") * 100 / F.count(F.lit(1))).alias("no_second"), (F.count("m") == 0).alias("winners_only"))


def vote_and_seats(seats: DataFrame, summary: DataFrame, most: int = 4) -> DataFrame:
    """By state and year: seats and mean share over the state of the parties with the most seats at their peak."""
    won = seats.groupBy("arena", "s", "y", "p").agg(F.count(F.lit(1)).alias("seats"))
    both = summary.select("arena", "s", "y", "p", "v").join(won, ["arena", "s", "y", "p"], "left").withColumn("seats", F.coalesce("seats", F.lit(0)))
    peak = both.groupBy("arena", "s", "p").agg(F.max("seats").alias("peak"))
    top = peak.withColumn("rank", F.row_number().over(Window.partitionBy("arena", "s").orderBy(F.desc("peak"), "p"))).where(F.col("rank") <= most)
    return both.join(top.select("arena", "s", "p"), ["arena", "s", "p"])


def win_quality(seats: DataFrame, bucket: Column, least: int = 8) -> DataFrame:
    """Each party's wins by year and bucket, and their share of its wins of the year with a value; parties with so many wins."""
    rows = seats.withColumn("bucket", bucket).where("bucket is not null")
    counts = rows.groupBy("arena", "p", "y", "bucket").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("arena", "p")
    told = counts.select("*", F.sum("n").over(w).alias("all"), F.sum("n").over(Window.partitionBy("arena", "p", "y")).alias("of")).where(F.col("all") >= least)
    return told.select("arena", "p", "y", "bucket", "n", (F.col("n").cast("double") * 100 / F.col("of")).alias("pct"))


def winner_matrix(seats: DataFrame, years: list[int] | None = None) -> DataFrame:
    """A row for each seat, a column for each election, or for the years asked for: who won."""
    return seats.groupBy("arena", "s", "j").pivot("y", years).agg(F.max("p"))


def index(seats: DataFrame) -> DataFrame:
    """Each election's seats, leading party and its seats."""
    won = seats.groupBy("arena", "s", "y", "p").agg(F.count(F.lit(1)).alias("lead_seats"))
    w = Window.partitionBy("arena", "s", "y")
    return won.select("*", F.sum("lead_seats").over(w).alias("seats"), F.row_number().over(w.orderBy(F.desc("lead_seats"), "p")).alias("rn")).where("rn = 1").drop("rn")


def pooled_turnout(electors: DataFrame) -> DataFrame:
    """Turnout of each state and year: all voters over all electors, of seats whose electors are known."""
    return electors.where("e > 0").groupBy("arena", "s", "y").agg((F.sum("voters").cast("double") * 100 / F.sum("e")).alias("t"))
