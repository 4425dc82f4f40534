"""From candidate rows to seats, parties and segments: first-seen numbers, repeated candidates, missing shares, parties by seats, segments of several sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen_numbers(rows: DataFrame, keys: Sequence[str], seat: str, order: str) -> DataFrame:
    """keys, seat, number: seats numbered from one in the order in which they are first seen; ties by name. Rows are summed by seat before any is ranked."""
    seen = rows.groupBy(*keys, seat).agg(F.min(order).alias("seen"))
    return seen.select(*keys, seat, F.row_number().over(Window.partitionBy(*keys).orderBy("seen", seat)).alias("number"))


def distinct_candidates(rows: DataFrame, keys: Sequence[str], name: str, party: str, votes: str, order: str, most: int = 5) -> DataFrame:
    """Of each seat (keys) the candidates with most votes, `most` of them; those of one name and party, whatever the case, and
    of the same votes are one, as first told by order. Ties go to the first told, then by name; unknown votes come last."""
    same = [F.upper(F.trim(name)).alias("upper_name"), F.upper(F.trim(party)).alias("upper_party")]
    once = rows.groupBy(*keys, *same, votes).agg(F.min_by(F.struct(name, party), order).alias("told"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(votes), "first", "upper_name", "upper_party")
    ranked = once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select(*keys, "rank", f"told.{name}", f"told.{party}", votes)


def with_known_votes(winners: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """winners (keys, votes, lead, share, margin) with missing shares and margins told by the seat's valid votes (known: keys,
    valid), to two places; zero votes, leads and totals tell nothing. Of a seat that is known twice the largest total counts."""
    valid = known.where("valid > 0").groupBy(*keys).agg(F.max("valid").alias("valid"))
    told = lambda part: F.when((F.col("valid") > 0) & (F.col(part) > 0), F.round(F.col(part) * 100.0 / F.col("valid"), 2))
    rows = winners.join(valid, list(keys), "left")
    return rows.withColumns({"share": F.coalesce("share", told("votes")), "margin": F.coalesce("margin", told("lead"))}).drop("valid")


def parties_by_seats(cand: DataFrame, seats: DataFrame, keys: Sequence[str], seat: str, group: str) -> DataFrame:
    """group, p, fought, won, votes, share of parties by the group that their seats belong to now (seats: keys, seat, group, p
    the winner); candidates of unknown seats are left out. share: of the votes of the group."""
    placed = cand.join(seats.select(*keys, seat, group).distinct(), [*keys, seat])
    sums = placed.groupBy(*keys, group, "p").agg(F.count(F.lit(1)).alias("fought"), F.sum("votes").alias("votes"))
    won = seats.groupBy(*keys, group, "p").agg(F.count(F.lit(1)).alias("won"))
    rows = sums.join(won, [*keys, group, "p"], "left").withColumn("won", F.coalesce("won", F.lit(0)))
    return rows.withColumn("share", F.try_divide(F.col("votes") * 100.0, F.sum("votes").over(Window.partitionBy(*keys, group))))


def segments(direct: DataFrame, cand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, y, p, tp, mg, sv of segments: as told for the years that `direct` has, for other years by the candidates' first and second (cand: keys, y, p, votes, position)."""
    other = cand.join(direct.select("y").distinct(), "y", "left_anti")
    at = lambda column, place: F.max(F.when(F.col("position") == place, F.col(column)))
    derived = other.groupBy(*keys, "y").agg(at("p", 1).alias("p"), at("p", 2).alias("tp"), (at("votes", 1) - at("votes", 2)).alias("mg"), F.sum("votes").alias("sv")).where("p is not null")
    columns = [*keys, "y", "p", "tp", "mg", "sv"]
    return direct.select(*columns).unionByName(derived.select(*columns))


def segment_leads(seats: DataFrame, segs: DataFrame, shift: Column, leave_out: Column) -> DataFrame:
    """seats (s, j) with segment_lead: who led there at the latest national election. shift: what turns a segment's number
    into the seats'; leave_out: states with new boundaries."""
    last = segs.agg(F.max("y").alias("y"))
    leads = segs.join(F.broadcast(last), "y").where(~leave_out).groupBy("s", (F.col("n") + shift).cast("int").alias("j")).agg(F.min("p").alias("segment_lead"))
    return seats.join(leads, ["s", "j"], "left")


def overlaid(base: DataFrame, overlay: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value of both; where both have a value the overlay's counts."""
    both = base.select(*keys, F.col(value).alias("was")).join(overlay.select(*keys, F.col(value).alias("now")), list(keys), "full")
    return both.select(*keys, F.coalesce("now", "was").alias(value))


def winners_only(parties: DataFrame, cand: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, parties, winners_only (no party has a share), with_candidates (there are candidate rows) of every election."""
    flags = parties.groupBy(*keys).agg(F.count(F.lit(1)).alias("parties"), (F.count("v") == 0).alias("winners_only"))
    return flags.join(cand.select(*keys).distinct().withColumn("there", F.lit(True)), list(keys), "left").select(*keys, "parties", "winners_only", F.coalesce("there", F.lit(False)).alias("with_candidates"))
