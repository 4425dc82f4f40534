"""Signals of a whole house: split field, softening strongholds, margin of control; and lookups with ordered fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_lines(rows: DataFrame, keys: list[str], by: str, lines: int) -> DataFrame:
    """The `lines` parties with most of `by` of each key, with their place and the number of parties."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("line", F.row_number().over(w.orderBy(F.desc(by), "p"))).withColumn("parties", F.count(F.lit(1)).over(w)).where(F.col("line") <= lines)


def split_field(seats: DataFrame, least: int = 30, below: float = 40.0, floor: int = 4, share: float = 0.08, watch: int = 60, lines: int = 8) -> DataFrame:
    """By arena and party, wins with less than `below` of the vote; only where an arena has `least` decided seats and enough such wins; the first `lines` parties, and how many there are."""
    arena = Window.partitionBy("arena")
    decided = seats.where("v is not null").withColumn("decided", F.count(F.lit(1)).over(arena))
    under = decided.where((F.col("v") < below) & (F.col("decided") >= least)).withColumn("under", F.count(F.lit(1)).over(arena))
    enough = under.where(F.col("under") >= F.greatest(F.lit(float(floor)), share * F.col("decided")))
    score = watch + F.round(F.col("under").cast("double") * 100 / F.col("decided")).cast("long")
    return first_lines(enough.groupBy("arena", "p", "decided", "under").agg(F.count(F.lit(1)).alias("wins")).withColumn("score", score), ["arena"], "wins", lines)


def softening(eroding: DataFrame, least: int = 3, watch: int = 60, lines: int = 8) -> DataFrame:
    """By arena and party, seats of eroding() and their mean loss; only where there are `least` in all and the leader has as many."""
    by = eroding.groupBy("arena", "p").agg(F.count(F.lit(1)).alias("seats"), F.avg("lost").alias("mean_lost"))
    arena = Window.partitionBy("arena")
    marked = by.withColumn("whole", F.sum("seats").over(arena)).withColumn("lead", F.max("seats").over(arena))
    rows = marked.where((F.col("whole") >= least) & (F.col("lead") >= least)).select("arena", "p", "seats", "mean_lost", (watch + 2 * F.col("lead")).alias("score"))
    return first_lines(rows, ["arena"], "seats", lines)


def margin_of_control(seats: DataFrame, house: list[str], least: int = 30) -> DataFrame:
    """For every house of `least` seats: its leader, the majority line, cushion (negative: seats short), pivot margin and severity.

    The pivot is the thinnest seat whose loss, with all thinner ones, takes the majority; it is null without a majority.
    """
    w = Window.partitionBy(*house)
    tally = seats.groupBy(*house, "p").agg(F.count(F.lit(1)).alias("won")).withColumn("n", F.sum("won").over(w))
    lead = tally.withColumn("rank", F.row_number().over(w.orderBy(F.desc("won"), "p"))).where((F.col("rank") == 1) & (F.col("n") >= least)).drop("rank")
    lead = lead.withColumn("majority", F.floor(F.col("n") / 2) + 1).withColumn("cushion", F.col("won") - F.col("majority"))
    thin = seats.where("m is not null").join(lead.select(*house, "p", "cushion"), [*house, "p"])
    own = Window.partitionBy(*house)
    thin = thin.withColumn("at", F.row_number().over(own.orderBy("m", "n")) - 1).withColumn("of", F.count(F.lit(1)).over(own))
    pivot = thin.where((F.col("cushion") >= 0) & (F.col("at") == F.least("cushion", F.col("of") - 1))).select(*house, F.col("m").alias("pivot"))
    critical = (F.col("cushion") >= 0) & (F.col("cushion") <= F.greatest(F.lit(3.0), 0.03 * F.col("n")))
    return lead.join(pivot, house, "left").select(*house, F.col("p").alias("leader"), "n", "won", "majority", "cushion", "pivot", F.when(critical, "critical").otherwise("note").alias("severity"))


def resolved_years(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """For each key and wanted year (y): that year if there, else the latest before it, else the earliest."""
    years = rows.select(*keys, F.col("y").alias("has")).distinct()
    found = years.join(wanted, keys)
    at_or_before = F.max(F.when(F.col("has") <= F.col("y"), F.col("has")))
    return found.groupBy(*keys, "y").agg(F.coalesce(at_or_before, F.min("has")).alias("resolved"))


def code_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, code, weight) of lists such as '358' or '358:0.6;346:0.4', weights made whole; a code without a weight has one. Entries without a number, or with a weight that is none, are left out."""
    each = rows.select(key, F.explode(F.split(text, ";")).alias("entry")).where("trim(entry) != ''")
    weight = F.expr("if(contains(entry, ':'), try_cast(trim(split_part(entry, ':', 2)) as double), 1.0d)")
    parts = each.select(key, F.expr("try_cast(trim(split_part(entry, ':', 1)) as long)").alias("code"), weight.alias("weight")).where("code is not null and weight > 0")
    return parts.select(key, "code", (F.col("weight") / F.sum("weight").over(Window.partitionBy(key))).alias("weight"))


def substrings(name: Column) -> Column:
    """All distinct substrings of a name; names are short."""
    n = F.char_length(name)
    starts = F.sequence(F.lit(1), n)
    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda size: F.substring(name, i, size))))))


def holding_pairs(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Distinct (keys, a, b) of equal keys whose names are equal or one holds the other, by joins on substrings: no pair is
    made that doesn't hold. An empty name holds none."""
    l, r = (d.select(*keys, c).where(f"{c} != ''").distinct() for d, c in ((left, a), (right, b)))  # noqa: E741
    in_left = l.withColumn("part", F.explode(substrings(F.col(a)))).join(r.withColumn("part", F.col(b)), [*keys, "part"]).drop("part")
    in_right = r.withColumn("part", F.explode(substrings(F.col(b)))).join(l.withColumn("part", F.col(a)), [*keys, "part"]).drop("part")
    return in_left.select(*keys, a, b).unionByName(in_right.select(*keys, a, b)).distinct()


def plain(name: str) -> Column:
    """Letters and digits of a name, upper case, without its reservation; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), r"\s*\((SC|ST|GEN)\)\s*$", ""), "[^A-Z0-9]", "")


def looked_up(seats: DataFrame, book: DataFrame, keys: list[str], number: str, name: str, value: str) -> DataFrame:
    """seats with the book's value, and by what it was found: the entry at the number if its name is the seat's or it has
    none (both), else the only entry of the book with the seat's name (name), else the entry at the number (number).

    Names are the same if one holds the other, without reservation, spaces and case. Of several entries at one number the
    one of the largest value counts, of these that of the last name. Only seats that the number doesn't settle are looked up by name.
    """
    entries = book.groupBy(*keys, number).agg(F.max(F.struct(value, name)).alias("entry")).select(*keys, number, F.col(f"entry.{value}").alias("v_number"), F.col(f"entry.{name}").alias("its_name"), F.lit(True).alias("there"))
    at = seats.join(entries, [*keys, number], "left").withColumn("seat_plain", plain(name)).withColumn("its_plain", plain("its_name"))
    same = (F.col("seat_plain") != "") & (F.col("its_plain") != "") & (F.contains("seat_plain", "its_plain") | F.contains("its_plain", "seat_plain"))
    settled = at.withColumn("settled", F.coalesce(F.col("there") & ((F.coalesce("its_name", F.lit("")) == "") | same), F.lit(False)))
    named = entries.select(*keys, number, "v_number", plain("its_name").alias("book_plain"))
    pairs = holding_pairs(settled.where("not settled"), named, keys, "seat_plain", "book_plain").join(named, [*keys, "book_plain"])
    only = pairs.groupBy(*keys, "seat_plain").agg(F.count(F.lit(1)).alias("entries"), F.max("v_number").alias("v_name"), F.lit(True).alias("named")).where("entries = 1")
    found = settled.join(only, [*keys, "seat_plain"], "left")
    by = F.when(F.col("settled"), "both").when(F.col("named"), "name").when(F.col("there"), "number")
    return found.select(*keys, number, name, F.when(F.col("settled"), F.col("v_number")).when(F.col("named"), F.col("v_name")).otherwise(F.col("v_number")).alias(value), by.alias("by"))


def two_step(rows: DataFrame, by_name: DataFrame, by_number: DataFrame, keys: list[str], number: str, name: str, value: str) -> DataFrame:
    """rows with the value found by name; by number only where the name has no row at all; else null. Of a book's repeated names or numbers the largest value counts."""
    first = rows.join(by_name.groupBy(*keys, name).agg(F.max(value).alias("v_name"), F.lit(True).alias("named")), [*keys, name], "left")
    both = first.join(by_number.groupBy(*keys, number).agg(F.max(value).alias("v_number")), [*keys, number], "left")
    return both.select(*keys, number, name, F.when(F.col("named"), F.col("v_name")).otherwise(F.col("v_number")).alias(value))


def most_common(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Each key's most common member and its share of the rows; ties to the smaller."""
    counts = rows.groupBy(*keys, member).agg(F.count(F.lit(1)).alias("members"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("share", F.col("members").cast("double") / F.sum("members").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("members"), member)))
    return ranked.where("rank = 1").select(*keys, member, "share")


def backfilled(share: Column, votes: Column, total: Column, winner_votes: Column, winner_share: Column) -> Column:
    """A share, zero counting as missing: as recorded, else from votes and their total, else by the total that the winner's share implies."""
    implied = F.when(winner_share > 0, winner_votes.cast("double") * 100 / winner_share)
    known = F.when(share > 0, share)
    return F.coalesce(known, F.when(total > 0, votes.cast("double") * 100 / total), F.when(implied > 0, votes.cast("double") * 100 / implied))


def complete_sums(parts: DataFrame, expected: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sums of the parts, only for keys of which all parts (expected: keys, parts) are there with every value."""
    whole = [F.when(F.count(v) == F.count(F.lit(1)), F.sum(v)).alias(v) for v in values]
    sums = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("there"), *whole)
    return sums.join(expected, keys).where("there = parts").drop("there", "parts")


def leader_retention(changed: DataFrame) -> DataFrame:
    """For each state the party that leads now, how many of the comparable seats it had before it holds still, and its net change.

    States whose leader had none are left out."""
    state = Window.partitionBy("arena", "s")
    led = changed.groupBy("arena", "s", "p").agg(F.count(F.lit(1)).alias("won")).withColumn("rank", F.row_number().over(state.orderBy(F.desc("won"), "p"))).where("rank = 1").select("arena", "s", F.col("p").alias("leader"), "won")
    compared = changed.where("status in ('held', 'flipped')").join(led, ["arena", "s"])
    had, gained = F.col("prev_p") == F.col("leader"), (F.col("p") == F.col("leader")) & (F.col("status") == "flipped")
    sums = compared.groupBy("arena", "s", "leader", "won").agg(F.count_if(had).alias("had"), F.count_if(had & (F.col("status") == "held")).alias("kept"), (F.count_if(gained) - F.count_if(had & (F.col("status") == "flipped"))).alias("net"))
    return sums.where("had > 0").withColumn("retention", F.col("kept").cast("double") * 100 / F.col("had"))
