"""Detectors, boards and scorecards over the active seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.functions.canon import reservation_category


def thin_book(seats: DataFrame, least: int = 5) -> DataFrame:
    """Parties with so many wins: those below five per cent of margin, and their share."""
    sums = seats.groupBy("arena", "p").agg(F.count(F.lit(1)).alias("wins"), F.count_if(F.col("m") < 5).alias("thin")).where(F.col("wins") >= least)
    return sums.withColumn("pct", F.col("thin").cast("double") * 100 / F.col("wins"))


def shallow_wins(seats: DataFrame, least: int = 10, share: float = 12.0, below: float = 3.0) -> DataFrame:
    sums = seats.groupBy("arena", "p").agg(F.count(F.lit(1)).alias("wins"), F.count_if(F.col("m") < below).alias("shallow"))
    return sums.withColumn("pct", F.col("shallow").cast("double") * 100 / F.col("wins")).where((F.col("wins") >= least) & (F.col("pct") >= share))


def minority_wins(seats: DataFrame, below: float = 40.0) -> DataFrame:
    """Wins with less than so much of the vote, by party, of all seats with a share."""
    valued = seats.where("v is not null").withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("arena")))
    return valued.where(F.col("v") < below).groupBy("arena", "p").agg(F.count(F.lit(1)).alias("wins"), F.max("of").alias("of"))


def flip_concentration(changed: DataFrame, most: int = 3) -> DataFrame:
    """The states with the most flips of each arena, and their share of all flips."""
    flips = changed.where("status = 'flipped'").groupBy("arena", "s").agg(F.count(F.lit(1)).alias("flips"))
    w = Window.partitionBy("arena")
    rows = flips.select("*", F.sum("flips").over(w).alias("all"), F.row_number().over(w.orderBy(F.desc("flips"), "s")).alias("rank")).where(F.col("rank") <= most)
    return rows.select("arena", "s", "flips", "rank", (F.col("flips").cast("double") * 100 / F.col("all")).alias("pct"))


def worst_defence(changed: DataFrame, least: int = 5) -> DataFrame:
    """Of parties that had so many seats, the one of each arena that kept the smallest share."""
    rows = changed.where(F.col("status").isin("held", "flipped")).groupBy("arena", F.col("prev_p").alias("p")).agg(F.count(F.lit(1)).alias("had"), F.count_if(F.col("status") == "held").alias("kept")).where(F.col("had") >= least)
    rows = rows.withColumn("pct", F.col("kept").cast("double") * 100 / F.col("had"))
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("arena").orderBy("pct", "p"))).where("rn = 1").drop("rn")


def efficiency_gap(national: DataFrame, year: int, least: float = 2.0) -> DataFrame:
    """Seat share minus vote share in a year, with a tone for four points either way."""
    rows = national.where((F.col("y") == year) & (F.col("v") >= least)).withColumn("ss", F.col("wo").cast("double") * 100 / F.sum("wo").over(Window.partitionBy("arena")))
    gap = F.col("ss") - F.col("v")
    return rows.select("arena", "p", "v", "ss", gap.alias("gap"), F.when(gap >= 4, "over").when(gap <= -4, "under").otherwise("fair").alias("tone"))


def reservation_skew(seats: DataFrame, least: int = 3) -> DataFrame:
    """Each arena's leader: its win rate by category of at least so many seats."""
    led = seats.groupBy("arena", "p").agg(F.count(F.lit(1)).alias("won")).withColumn("rn", F.row_number().over(Window.partitionBy("arena").orderBy(F.desc("won"), "p"))).where("rn = 1").select("arena", F.col("p").alias("leader"))
    rows = seats.join(led, "arena").withColumn("cat", reservation_category(F.col("r")))
    return rows.groupBy("arena", "leader", "cat").agg(F.count(F.lit(1)).alias("of"), F.count_if(F.col("p") == F.col("leader")).alias("won")).where(F.col("of") >= least).withColumn("rate", F.col("won").cast("double") * 100 / F.col("of"))


def scorecards(seats: DataFrame) -> DataFrame:
    """Per party: wins, second places, strike rate over both, mean margin, safe, thin and minority wins, close targets."""
    won = seats.groupBy("arena", "p").agg(F.count(F.lit(1)).alias("won"), F.avg("m").alias("mean_margin"), F.count_if(F.col("m") >= 10).alias("safe"), F.count_if(F.col("m") < 5).alias("thin"), F.count_if(F.col("v") < 40).alias("sub40"))
    lost = seats.where("q is not null").groupBy("arena", F.col("q").alias("p")).agg(F.count(F.lit(1)).alias("second"), F.count_if(F.col("m") < 10).alias("targets"), F.count_if(F.col("m") < 5).alias("close_targets"))
    both = won.join(lost, ["arena", "p"], "full")
    counts = ("won", "safe", "thin", "sub40", "second", "targets", "close_targets")
    filled = both.select("arena", "p", "mean_margin", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return filled.withColumn("strike", F.col("won").cast("double") * 100 / (F.col("won") + F.col("second")))


#: Limits of the strengths, weaknesses, opportunities and threats read from a scorecard.
RULES = (
    ("S", "high strike rate", "strike >= 50"), ("S", "many safe seats", "safe >= 0.5 * won and won > 0"), ("W", "thin book", "thin >= 0.3 * won and won > 0"),
    ("W", "minority wins", "sub40 >= 0.5 * won and won > 0"), ("O", "close targets", "close_targets >= 5"), ("O", "more targets than thin seats", "targets > thin"), ("T", "more thin seats than close targets", "thin > close_targets"),
)


def swot(cards: DataFrame, most: int = 4) -> DataFrame:
    """The rules that hold for each party, at most so many a kind."""
    marks = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("nth"), F.lit(text).alias("rule"), F.expr(rule).alias("holds")) for i, (kind, text, rule) in enumerate(RULES)])
    held = cards.select("arena", "p", F.explode(marks).alias("x")).where("x.holds").select("arena", "p", "x.kind", "x.nth", "x.rule")
    w = Window.partitionBy("arena", "p", "kind").orderBy("nth")
    return held.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("arena", "p", "kind", "rule", "rank")


def board(seats: DataFrame, history: DataFrame, bypolls: DataFrame, limit: float = 10.0) -> DataFrame:
    """Attack board: seats within the band, scored by closeness, falling margin and a lost by-election since."""
    last = bypolls.withColumn("rn", F.row_number().over(Window.partitionBy("arena", "s", "n").orderBy(F.desc("y")))).where("rn = 1").select("arena", "s", "n", F.col("y").alias("by_y"), F.col("p").alias("by_p"))
    falling = history.select("arena", "s", "j", "y", (F.col("m") < F.col("prev_m")).alias("falling"))
    rows = seats.where(F.col("m") < limit).join(falling, ["arena", "s", "j", "y"]).join(last, ["arena", "s", "n"], "left")
    near = F.floor((F.lit(limit) - F.col("m")) / limit * 50 + 0.5)
    lost = F.coalesce((F.col("by_y") >= F.col("y")) & (F.col("by_p") != F.col("p")), F.lit(False))
    score = near + F.when(F.col("falling"), 20).otherwise(0) + F.when(lost, 15).otherwise(0)
    return rows.select("arena", "s", "j", "y", "p", "q", "m", score.cast("long").alias("score"), (F.col("v") < 40).alias("sub40"))


def head_to_head(seats: DataFrame, one: str, other: str) -> DataFrame:
    """How often either of two parties beat the other, by state."""
    met = ((F.col("p") == one) & (F.col("q") == other)) | ((F.col("p") == other) & (F.col("q") == one))
    return seats.where(met).groupBy("arena", "s").agg(F.count_if(F.col("p") == one).alias("wins"), F.count_if(F.col("p") == other).alias("losses"))


def challengers(seats: DataFrame) -> DataFrame:
    """The most frequent runner-up to each state's leader."""
    counts = seats.groupBy("arena", "s", "p").agg(F.count(F.lit(1)).alias("won"))
    led = counts.withColumn("rn", F.row_number().over(Window.partitionBy("arena", "s").orderBy(F.desc("won"), "p"))).where("rn = 1").select("arena", "s", "p")
    met = seats.join(led, ["arena", "s", "p"]).where("q is not null").groupBy("arena", "s", "p", "q").agg(F.count(F.lit(1)).alias("met"))
    return met.withColumn("rn", F.row_number().over(Window.partitionBy("arena", "s").orderBy(F.desc("met"), "q"))).where("rn = 1").drop("rn")


def scoreboard(seats: DataFrame, party: Column) -> DataFrame:
    """Of each seat: whether a party won, came second or neither, and its share where known."""
    place = F.when(F.col("p") == party, "won").when(F.col("q") == party, "second").otherwise("out")
    share = F.when(F.col("p") == party, F.col("v")).when(F.col("q") == party, F.col("v") - F.col("m"))
    return seats.select("arena", "s", "j", place.alias("place"), share.alias("share"))


def seat_labels(bios: DataFrame) -> DataFrame:
    """What kind of seat it is: fortress, swing or leaning; bipolar, triangular or fragmented; how high its turnout."""
    n = F.col("elections")
    kind = F.when((n > 1) & (F.col("winners") == 1), "fortress").when((F.col("winners") == n) | (F.col("flips") >= F.ceil((n - 1) / 2)), "swing").otherwise("leans")
    field = F.when(F.col("bipolarity") >= 82, "bipolar").when(F.col("bipolarity") >= 68, "triangular").otherwise("fragmented")
    turnout = F.when(F.col("mean_turnout") >= 72, "high").when(F.col("mean_turnout") >= 62, "middling").otherwise("low")
    return bios.select("arena", "s", "j", kind.alias("kind"), field.alias("field"), turnout.alias("turnout"))


def losses_in_reach(seats: DataFrame, limit: float = 10.0, most: int = 5) -> DataFrame:
    """Each party's closest second places of every arena."""
    w = Window.partitionBy("arena", "q").orderBy("m", "s", "j")
    rows = seats.where(F.col("m") < limit).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return rows.select("arena", F.col("q").alias("p"), "s", "j", "m", "rank")


def verdicts(cards: DataFrame, seats: DataFrame) -> DataFrame:
    """Seat share of every party and the verdict on it: dominant at 45 per cent, strong at 25, present at 8, else fringe."""
    house = seats.groupBy("arena").agg(F.count(F.lit(1)).alias("of"))
    share = F.col("won").cast("double") * 100 / F.col("of")
    verdict = F.when(share >= 45, "dominant").when(share >= 25, "strong").when(share >= 8, "present").otherwise("fringe")
    return cards.join(house, "arena").select("arena", "p", share.alias("seat_share"), verdict.alias("verdict"))
