"""Trends, swings and what-ifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions import canon
from hustings.functions.canon import alliance_base


def swing(summary: DataFrame, year: int, before: int, least: float = 1.0) -> DataFrame:
    """Change of each party's share between two elections of a state; both shares are needed, and one of them above least."""
    now = summary.where(F.col("y") == year).select("arena", "s", "p", F.col("v").alias("now"))
    then = summary.where(F.col("y") == before).select("arena", "s", "p", F.col("v").alias("then"))
    return now.join(then, ["arena", "s", "p"]).where((F.col("now") >= least) | (F.col("then") >= least)).withColumn("swing", F.col("now") - F.col("then"))


def pedersen(summary: DataFrame) -> DataFrame:
    """Volatility between adjacent listed elections: half the sum of absolute changes of share; a missing party has none."""
    years = summary.select("arena", "s", "y").distinct()
    pairs = years.withColumn("before", F.lag("y").over(Window.partitionBy("arena", "s").orderBy("y"))).where("before is not null")
    now = summary.join(pairs, ["arena", "s", "y"]).select("arena", "s", "y", "p", F.col("v").alias("d"))
    then = summary.withColumnRenamed("y", "before").join(pairs, ["arena", "s", "before"]).select("arena", "s", "y", "p", (-F.col("v")).alias("d"))
    moved = now.unionByName(then).groupBy("arena", "s", "y", "p").agg(F.sum("d").alias("d"))
    return moved.groupBy("arena", "s", "y").agg((F.sum(F.abs("d")) / 2).alias("volatility"))


def linear_trends(national: DataFrame) -> DataFrame:
    """Slope, intercept, r squared and projection of each party's share over the places of the listed years; three points at least."""
    years = national.select("arena", "y").distinct().withColumn("x", (F.row_number().over(Window.partitionBy("arena").orderBy("y")) - 1).cast("double"))
    last = years.groupBy("arena").agg((F.max("x") + 1).alias("next"))
    fit = national.join(years, ["arena", "y"]).groupBy("arena", "p").agg(
        F.regr_slope("v", "x").alias("slope"), F.regr_intercept("v", "x").alias("intercept"), F.count("v").alias("points"),
        F.regr_sxy("v", "x").alias("sxy"), F.regr_sxx("v", "x").alias("sxx"), F.regr_syy("v", "x").alias("syy"),
    ).where("points >= 3")
    r2 = F.when(F.col("syy") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("sxy") * F.col("sxy") / (F.col("sxx") * F.col("syy"))))
    ahead = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col("next")))
    return fit.join(last, "arena").select("arena", "p", "slope", "intercept", r2.alias("r2"), ahead.alias("projected"), "points")


def momentum(trends: DataFrame, least: float = 0.3) -> DataFrame:
    """The party that rises and the one that falls the most, if by so much an election."""
    up, down = (Window.partitionBy("arena").orderBy(o, "p") for o in (F.desc("slope"), F.asc("slope")))
    rows = trends.select("arena", "p", "slope", F.row_number().over(up).alias("u"), F.row_number().over(down).alias("d"))
    way = F.when((F.col("u") == 1) & (F.col("slope") > least), "rising").when((F.col("d") == 1) & (F.col("slope") < -least), "falling")
    return rows.select("arena", "p", "slope", way.alias("way")).where("way is not null")


def seats_at(pp: Column) -> Column:
    """Of rows with the roles of a party in a contest: its seats after a uniform swing of pp."""
    won, lost = F.col("role") == "won", F.col("role") == "second"
    gain = F.count_if(lost & (pp > 0) & (F.col("m") < 2 * pp))
    loss = F.count_if(won & (pp < 0) & (F.col("m") < -2 * pp))
    return F.count_if(won) + gain - loss


def roles(seats: DataFrame) -> DataFrame:
    """A row for the winner and one for the runner-up of each seat."""
    both = F.explode(F.array(F.struct(F.col("p").alias("party"), F.lit("won").alias("role")), F.struct(F.col("q").alias("party"), F.lit("second").alias("role"))))
    return seats.select("arena", "s", "j", "m", both.alias("x")).where("x.party is not null").select("arena", "s", "j", "m", F.col("x.party").alias("p"), "x.role")


def seat_curve(seats: DataFrame, most: float = 12.0, step: float = 0.5) -> DataFrame:
    """Each party's seats over uniform swings from -most to most."""
    steps = F.transform(F.sequence(F.lit(int(-most / step)), F.lit(int(most / step))), lambda i: i * F.lit(step))
    return roles(seats).select("arena", "p", "m", "role", F.explode(steps).alias("pp")).groupBy("arena", "p", "pp").agg(seats_at(F.col("pp")).alias("seats"))


def swing_to_majority(seats: DataFrame, most: float = 12.0) -> DataFrame:
    """The smallest swing that gives each party more than half of its arena's seats, in quarters; capped if none does."""
    house = seats.groupBy("arena").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("majority"))
    curve = seat_curve(seats, most, 0.25).join(house, "arena")
    return curve.groupBy("arena", "p").agg(F.coalesce(F.min(F.when(F.col("seats") >= F.col("majority"), F.col("pp"))), F.lit(most)).alias("pp"), (F.max("seats") < F.max("majority")).alias("capped"))


def swingometer(seats: DataFrame, pp: float) -> DataFrame:
    """For each winner and runner-up: the seats that a swing of pp between the two would flip."""
    return seats.where((F.col("m") < 2 * pp) & F.col("q").isNotNull()).groupBy("arena", "p", "q").agg(F.count(F.lit(1)).alias("flips"), F.min("m").alias("closest"))


def tipping_seats(seats: DataFrame) -> DataFrame:
    """For each party short of a majority: the loss that, with all closer ones, would give it."""
    house = seats.groupBy("arena").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("majority"))
    rows = roles(seats).join(house, "arena")
    base = rows.groupBy("arena", "p").agg(F.count_if(F.col("role") == "won").alias("base"), F.max("majority").alias("majority"))
    order = Window.partitionBy("arena", "p").orderBy("m", "s", "j")
    losses = rows.where("role = 'second' and m is not null").select("arena", "p", "s", "j", "m", F.row_number().over(order).alias("nth"))
    return losses.join(base, ["arena", "p"]).where(F.col("nth") == F.col("majority") - F.col("base")).select("arena", "p", "s", "j", "m", "nth")


def alliance_what_if(seats: DataFrame, bloc: list[str], shares: DataFrame, transfer: float = 1.0) -> DataFrame:
    """Seats of a bloc of parties now, friendly fights among them, and seats gained if the others' shares went to its runner-up."""
    inside = shares.where(F.col("p").isin(bloc)).groupBy("arena", "s").agg(F.sum("v").alias("bloc_share"))
    own = shares.select("arena", "s", F.col("p").alias("q"), F.col("v").alias("own"))
    rows = seats.join(inside, ["arena", "s"], "left").join(own, ["arena", "s", "q"], "left")
    won, second = F.col("p").isin(bloc), F.coalesce(F.col("q").isin(bloc), F.lit(False))
    reach = second & ~won & (F.lit(transfer) * (F.col("bloc_share") - F.col("own")) >= F.col("m"))
    return rows.groupBy("arena").agg(F.count_if(won).alias("now"), F.count_if(won & second).alias("friendly"), F.count_if(second & ~won).alias("contestable"), F.count_if(reach).alias("gains"), (F.count_if(won) + F.count_if(reach)).alias("projected"))


def majority_cushion(seats: DataFrame) -> DataFrame:
    """The largest alliance of each arena, its seats beyond the majority, and the margin of the seat that decides it."""
    rows = seats.withColumn("b", alliance_base(F.col("a")))
    house = rows.groupBy("arena").agg((F.floor(F.count(F.lit(1)) / 2) + 1).alias("half"))
    lead = rows.where("b != 'Unaligned'").groupBy("arena", "b").agg(F.count(F.lit(1)).alias("won")).withColumn("rn", F.row_number().over(Window.partitionBy("arena").orderBy(F.desc("won"), "b"))).where("rn = 1").drop("rn")
    order = Window.partitionBy("arena", "b").orderBy(F.asc_nulls_last("m"), "s", "j")
    placed = rows.join(lead, ["arena", "b"]).join(house, "arena").select("arena", "b", "won", "m", (F.col("won") - F.col("half")).alias("cushion"), F.row_number().over(order).alias("nth"))
    return placed.where(F.col("nth") == F.greatest(F.lit(1), F.least(F.col("won"), F.col("cushion") + 1))).select("arena", F.col("b").alias("alliance"), "won", "cushion", F.col("m").alias("pivot"))


def decisive_swing(seats: DataFrame) -> DataFrame:
    """In each state, the smallest swing from its leader to the next party that turns their order; none up to 12 is null."""
    counts = seats.groupBy("arena", "s", "p").agg(F.count(F.lit(1)).alias("won"))
    top = counts.withColumn("rn", F.row_number().over(Window.partitionBy("arena", "s").orderBy(F.desc("won"), "p"))).where("rn <= 2")
    two = top.groupBy("arena", "s").agg(F.max(F.when(F.col("rn") == 1, F.col("p"))).alias("leader"), F.max(F.when(F.col("rn") == 2, F.col("p"))).alias("next"), F.max("won").alias("ahead"), F.min("won").alias("behind")).where("next is not null")
    steps = F.explode(F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: i * F.lit(0.5)))
    tried = seats.join(two, ["arena", "s"]).select("*", steps.alias("pp"))
    flip = (F.col("p") == F.col("leader")) & (F.col("q") == F.col("next")) & (F.col("m") < 2 * F.col("pp"))
    at = tried.groupBy("arena", "s", "leader", "next", "pp", "ahead", "behind").agg(F.count_if(flip).alias("x"))
    return at.groupBy("arena", "s", "leader", "next").agg(F.min(F.when(F.col("behind") + F.col("x") > F.col("ahead") - F.col("x"), F.col("pp"))).alias("pp"))


def electorate_growth(electors: DataFrame) -> DataFrame:
    """Growth of electors since a seat's election before, null across a boundary break; women per thousand men."""
    w = Window.partitionBy("arena", "s", "j").orderBy("y")
    rows = electors.select("*", F.lag("e").over(w).alias("was"), F.lag("y").over(w).alias("before"))
    same = canon.comparable(F.col("arena"), F.col("s"), F.col("before"), F.col("y"))
    growth = F.when(same, canon.percent(F.col("e") - F.col("was"), F.col("was")))
    return rows.select("arena", "s", "j", "y", growth.alias("growth"), canon.percent(F.col("women") * 10, F.col("men")).alias("women_per_thousand"))
