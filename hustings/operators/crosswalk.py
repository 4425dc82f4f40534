"""Matching two lists of seats by tiers: official number, name, sound, then rounds of mutual best likeness.

left: block, code, name, parent, number; right: block, seat, names (of all years), parent, numbers. Pairs are told and
scored once. All names of a block are compared, a piece of each list at a time (pieces.py); only like pairs and those of one
number become rows, so no pair is missed, whatever the block's size.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from hustings.functions.sequences import block_ratio, like_pairs
from hustings.operators.pieces import all_met
from hustings.scratch import discard, written

# Words of directions and kinds, renamed places, and spellings of one sound, in the order they are replaced.
DIRECTIONS = {
    "NORTH": "N", "UTTAR": "N", "UTTARA": "N", "SOUTH": "S", "DAKSHIN": "S", "DAKSHINA": "S", "EAST": "E", "PURBA": "E", "PURVA": "E", "PURB": "E", "PURV": "E",
    "WEST": "W", "PASCHIM": "W", "PASCHIMI": "W", "PACHIM": "W", "CENTRAL": "C", "MADHYA": "C", "CANTONMENT": "CANTT", "CANT": "CANTT", "GRAMIN": "RURAL", "GRAMEEN": "RURAL",
    "AND": "", "I": "1", "II": "2", "III": "3", "IV": "4", "ST": "SAINT",
}
RENAMED = (
    ("KALABURAGI", "GULBARGA"), ("BELAGAVI", "BELGAUM"), ("BALLARI", "BELLARY"), ("MANGALURU", "MANGALORE"), ("SHIVAMOGGA", "SHIMOGA"), ("TUMAKURU", "TUMKUR"), ("VIJAYAPURA", "BIJAPUR"), ("BENGALURU", "BANGALORE"),
    ("MYSURU", "MYSORE"), ("HUBBALLI", "HUBLI"), ("CHIKKAMAGALURU", "CHIKMAGALUR"), ("BURDWAN", "BARDHAMAN"), ("GURUGRAM", "GURGAON"), ("PRAYAGRAJ", "ALLAHABAD"), ("NAGAON", "NOWGONG"), ("SIVASAGAR", "SIBSAGAR"),
)
SOUNDS = (
    ("KSH", "KS"), ("X", "KS"), ("TH", "T"), ("DH", "D"), ("BH", "B"), ("KH", "K"), ("GH", "G"), ("PH", "F"), ("SH", "S"), ("CH", "C"), ("JH", "J"), ("RH", "R"), ("W", "V"), ("Z", "J"), ("Q", "K"), ("Y", "I"),
    ("EE", "I"), ("OO", "U"), ("OU", "U"), ("AA", "A"), ("H", ""),
)

#: Likeness from which a number is believed: alone, with the parent's agreement, and where the number is used twice; from
#: which another seat's name overrules it, and by how much it must be likelier.
BY_NUMBER, BY_NUMBER_AND_PARENT, BY_SHARED_NUMBER, OVERRULED_FROM, OVERRULED_BY = 0.6, 0.45, 0.85, 0.85, 0.05
#: Likeness of parents that agree; of pairs that may be matched, alone and with evidence; what evidence adds.
PARENTS_AGREE, ALONE, WITH_EVIDENCE, FOR_PARENT, FOR_SKELETON = 0.8, 0.72, 0.55, 0.12, 0.08
ROUNDS, LOW_MARGIN = 5, 0.1
#: What names are compared by, and to how many places.
COMPARED, PLACES = ("flat", "sound", "sorted"), 3
MATCHED = ("block", "code", "seat", "method", "similarity", "note")


def words(name: Column) -> Column:
    """Words of a name in upper case, without reservation and kind, directions folded."""
    upper = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "&", " AND ")
    bare = F.regexp_replace(F.regexp_replace(upper, r"\(\s*(S\.?\s*C|S\.?\s*T|B\.?\s*L)\s*\.?\)", " "), r"(\s|-\s*)(SC|ST)\s*$", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, "(ASSEMBLY )?CONSTITUENCY", " "), "[^A-Z0-9]+", " ")
    known = F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair])
    return F.filter(F.transform(F.split(F.trim(bare), " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), lambda w: w != "")


def sound(flat: Column) -> Column:
    """What a name sounds like: renamed places by their old name, spellings of one sound alike, no doubled letters."""
    return F.regexp_replace(reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (*RENAMED, *SOUNDS), flat), r"(.)\1+", "$1")


def keyed(rows: DataFrame, name: str, prefix: str) -> DataFrame:
    """rows with the name's keys: flat, sound, sorted (words in order) and skeleton (no vowels after the first letter)."""
    c = lambda key: f"{prefix}{key}"
    told = rows.withColumn(c("words"), words(F.col(name))).withColumn(c("flat"), F.array_join(c("words"), ""))
    told = told.withColumn(c("sound"), sound(F.col(c("flat")))).withColumn(c("sorted"), F.array_join(F.array_sort(c("words")), ""))
    return told.withColumn(c("skeleton"), F.concat(F.left(c("sound"), F.lit(1)), F.regexp_replace(F.substring(c("sound"), 2, 10_000), "[AEIOU]", ""))).drop(c("words"))


def likeness(a: str, b: str) -> Column:
    """The largest block ratio of three keys of two keyed names (prefixes a and b), to three places; 0 if one is empty."""
    ratios = [block_ratio(F.col(f"{a}{key}"), F.col(f"{b}{key}")) for key in COMPARED]
    return F.when((F.col(f"{a}flat") == "") | (F.col(f"{b}flat") == ""), 0.0).otherwise(F.round(F.greatest(*ratios), PLACES))


def liker(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For all_met() on keyed names: block, code, seat and the largest block ratio of theirs, where it is `least` or more."""

    def likest(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j, ratio = like_pairs(*([side.column(f"{prefix}{key}").to_pylist() for key in COMPARED] for side, prefix in ((left, "l_"), (right, "r_"))), least)
        if len(i):
            numbered = lambda ids: ids.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            pair = numbered(left["code"])[i] * right.num_rows + numbered(right["seat"])[j]
            order = np.lexsort((-ratio, pair))
            order = order[np.diff(pair[order], prepend=-1) > 0]
            i, j, ratio = i[order], j[order], ratio[order]
        return pa.table({"block": left["block"].take(i), "code": left["code"].take(i), "seat": right["seat"].take(j), "similarity": ratio})

    return likest


def like_rows(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """block, code, seat, similarity of keyed names (block, code, l_ keys; block, seat, r_ keys) that are like by `least`: a row
    for each code and seat, by the likeliest of their names."""
    one = left.where("l_flat != '' and code is not null").select("block", "code", *(f"l_{key}" for key in COMPARED))
    other = right.where("r_flat != '' and seat is not null").select("block", "seat", *(f"r_{key}" for key in COMPARED))
    schema = StructType([left.schema["block"], left.schema["code"], right.schema["seat"], StructField("similarity", DoubleType())])
    rows = all_met(one, other, ["block"], ("code", "seat"), liker(least - 0.6 * 10**-PLACES), schema)
    return rows.withColumn("similarity", F.round("similarity", PLACES)).where(F.col("similarity") >= least)


def names_of(right: DataFrame) -> DataFrame:
    """block, seat and keys of every name of the right list."""
    return keyed(right.select("block", "seat", F.explode(F.array_distinct("names")).alias("r_name")), "r_name", "r_")


def like_seats(left: DataFrame, right: DataFrame) -> DataFrame:
    """block, code, seat, similarity of every code and seat that are like by WITH_EVIDENCE, by the likeliest of the seat's names."""
    return like_rows(keyed(left, "name", "l_"), names_of(right), WITH_EVIDENCE)


def scored_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """block, code, seat, similarity, flat, sound and skeleton (a name of the seat's is equal so), parents (agree), numbered
    (equal): a row for each code and seat, by the likeliest of the seat's names, that are like by WITH_EVIDENCE or share a number."""
    l, names = keyed(left, "name", "l_"), names_of(right)  # noqa: E741
    numbers = left.where("number is not null").select("block", "code", "number").join(right.select("block", "seat", F.explode(F.array_distinct("numbers")).alias("number")), ["block", "number"]).select("block", "code", "seat").distinct()
    by_number = numbers.join(l, ["block", "code"]).join(names, ["block", "seat"]).select("block", "code", "seat", likeness("l_", "r_").alias("similarity"), F.lit(True).alias("numbered"))
    pairs = like_rows(l, names, WITH_EVIDENCE).withColumn("numbered", F.lit(False)).unionByName(by_number).groupBy("block", "code", "seat").agg(F.max("similarity").alias("similarity"), F.max("numbered").alias("numbered"))
    parents = like_rows(
        keyed(left.where("parent is not null").select("block", F.col("parent").alias("code")).distinct(), "code", "l_"), keyed(right.where("parent is not null").select("block", F.col("parent").alias("seat")).distinct(), "seat", "r_"), PARENTS_AGREE
    ).select("block", F.col("code").alias("l_parent"), F.col("seat").alias("r_parent"), F.lit(True).alias("agree"))
    equal = ("flat", "sound", "skeleton")
    theirs = names.groupBy("block", "seat").agg(*[F.collect_set(f"r_{key}").alias(f"r_{key}") for key in equal]).join(right.select("block", "seat", F.col("parent").alias("r_parent")), ["block", "seat"])
    whole = pairs.join(l.withColumnRenamed("parent", "l_parent"), ["block", "code"]).join(theirs, ["block", "seat"]).join(parents, ["block", "l_parent", "r_parent"], "left")
    same = [((F.col(f"l_{key}") != "") & F.array_contains(f"r_{key}", F.col(f"l_{key}"))).alias(key) for key in equal]
    return whole.select("block", "code", "seat", "similarity", *same, F.coalesce("agree", F.lit(False)).alias("parents"), "numbered")


def firsts(rows: DataFrame, method: str, note: str | Column) -> DataFrame:
    """Of rows that claim a seat twice the likeliest, then the first code."""
    w = Window.partitionBy("block", "seat").orderBy(F.desc("similarity"), "code")
    note = F.lit(note) if isinstance(note, str) else note
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("block", "code", "seat", F.lit(method).alias("method"), "similarity", note.alias("note"))


def left_over(pairs: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs of which neither side is matched."""
    return pairs.join(matched.select("block", "code"), ["block", "code"], "left_anti").join(matched.select("block", "seat"), ["block", "seat"], "left_anti")


def by_number(pairs: DataFrame, left: DataFrame, matched: DataFrame) -> DataFrame:
    """Pairs of one number, if the names agree enough, and no other seat has clearly more of the name."""
    used = left.where("number is not null").groupBy("block", "number").agg(F.count(F.lit(1)).alias("users"))
    users = left.select("block", "code", "number").join(used, ["block", "number"]).select("block", "code", "users")
    code = Window.partitionBy("block", "code")
    best = F.max(F.struct("similarity", (-F.col("seat")).alias("minus"))).over(code)
    rows = left_over(pairs.withColumn("best", best).where("numbered"), matched).join(users, ["block", "code"])
    agree = (F.col("similarity") >= BY_NUMBER) | F.col("sound") | (F.col("parents") & (F.col("similarity") >= BY_NUMBER_AND_PARENT))
    overruled = (F.col("best.similarity") >= OVERRULED_FROM) & (-F.col("best.minus") != F.col("seat")) & (F.col("similarity") < F.col("best.similarity") - OVERRULED_BY)
    shared = (F.col("users") > 1) & (F.col("similarity") < BY_SHARED_NUMBER)
    kept = rows.where(agree & ~overruled & ~shared).withColumn("nth", F.row_number().over(code.orderBy(F.desc("similarity"), "seat"))).where("nth = 1")
    return firsts(kept, "eci_code", F.when(F.col("flat"), "").when(F.col("sound"), "sounds alike").otherwise("spelled differently"))


def unique_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs whose code and whose seat are in no other."""
    rows = pairs.withColumn("of_code", F.count(F.lit(1)).over(Window.partitionBy("block", "code"))).withColumn("of_seat", F.count(F.lit(1)).over(Window.partitionBy("block", "seat")))
    return rows.where("of_code = 1 and of_seat = 1").drop("of_code", "of_seat")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs that are each other's best by likeness and evidence, with how far the code's next best is."""
    evidence = F.when(F.col("parents"), FOR_PARENT).otherwise(0.0) + F.when(F.col("skeleton"), FOR_SKELETON).otherwise(0.0)
    usable = (F.col("similarity") >= ALONE) | ((F.col("similarity") >= WITH_EVIDENCE) & (F.col("parents") | F.col("skeleton")))
    rows = pairs.where(usable).withColumn("score", F.round(F.col("similarity") + evidence, 6))
    code, seat = (Window.partitionBy("block", side) for side in ("code", "seat"))
    rows = rows.withColumn("i", F.row_number().over(code.orderBy(F.desc("score"), "seat"))).withColumn("next", F.lead("score").over(code.orderBy(F.desc("score"), "seat"))).withColumn("j", F.row_number().over(seat.orderBy(F.desc("score"), "code")))
    margin = F.col("score") - F.coalesce("next", F.lit(0.0))
    note = F.concat(F.when(F.col("parents"), "parent agrees").otherwise("parent differs"), F.when(F.col("skeleton"), "; skeleton equal").otherwise(""), F.when(F.round(margin, 6) < LOW_MARGIN, "; low margin").otherwise(""))
    return rows.where("i = 1 and j = 1").select("block", "code", "seat", "similarity", note.alias("note"))


def crosswalk(left: DataFrame, right: DataFrame, by_hand: DataFrame | None = None) -> DataFrame:
    """MATCHED rows of every code that a seat is found for, each seat once at most. by_hand: block, code, seat.

    Pairs and what each tier adds are written tables, as all later tiers read them. Rounds of mutual best end with the first
    that matches nothing. Names that are empty match nothing; equal names tell codes apart by parents. Codes and seats are
    unique in a block; of a pair matched by hand that is not like at all the similarity is 0.
    """
    pairs = written(scored_pairs(left, right), "pairs")
    hand = by_hand if by_hand is not None else left.select("block", "code").limit(0).withColumn("seat", F.lit(0).cast("long"))
    hand = hand.join(left.select("block", "code"), ["block", "code"], "left_semi").join(pairs.select("block", "code", "seat", "similarity"), ["block", "code", "seat"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    matched = written(firsts(hand, "manual", "by hand"), "matched")

    def further(found: DataFrame) -> DataFrame:
        more = written(matched.unionByName(found.select(*MATCHED)), "matched")
        discard(matched)
        return more

    matched = further(by_number(pairs, left, matched))
    exact = left_over(pairs, matched).where("flat")
    matched = further(firsts(unique_pairs(exact).withColumn("similarity", F.lit(1.0)), "exact_name", ""))
    same = left_over(pairs, matched).where("flat and parents").withColumn("similarity", F.lit(1.0))
    one = same.withColumn("seats", F.count(F.lit(1)).over(Window.partitionBy("block", "code"))).where("seats = 1")
    matched = further(firsts(one, "exact_name", "name used twice; parent agrees"))
    matched = further(firsts(unique_pairs(left_over(pairs, matched).where("sound")), "fuzzy", F.concat(F.lit("sounds alike"), F.when(F.col("parents"), "").otherwise("; parent differs"))))
    for nth in range(1, ROUNDS + 1):
        found = written(mutual_best(left_over(pairs, matched)).withColumn("method", F.lit(f"fuzzy-{nth}")), "found")
        none = found.isEmpty()
        matched = matched if none else further(found)
        discard(found)
        if none:
            break
    discard(pairs)
    return matched


def closer_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """block, code, seat, same, best, verdict of every left row whose number's seat on the right has another name (left: block,
    code, name; right: block, seat, names).

    seat: the number on the right with the likeliest name, likeness WITH_EVIDENCE at least or the same number; same: the
    likeness at the same number. verdict: spelling, if no other number has a likelier name, else closer.
    """
    l, names = keyed(left.select("block", "code", "name"), "name", "l_"), names_of(right)  # noqa: E741
    at_own = l.join(names.withColumn("code", F.col("seat")), ["block", "code"]).withColumn("similarity", likeness("l_", "r_"))
    own = at_own.groupBy("block", "code").agg(F.max("seat").alias("seat"), F.max("similarity").alias("similarity"), F.max((F.col("l_flat") != "") & (F.col("l_flat") == F.col("r_flat"))).alias("flat")).where("not flat").drop("flat")
    like = like_rows(l.join(own.select("block", "code"), ["block", "code"], "left_semi"), names, WITH_EVIDENCE)
    best = F.max(F.struct("similarity", (F.col("seat") == F.col("code")).cast("int").alias("own"), (-F.col("seat")).alias("minus"))).alias("best")
    rows = like.unionByName(own).groupBy("block", "code").agg(best).join(own.select("block", "code", F.col("similarity").alias("same")), ["block", "code"])
    verdict = F.when(F.col("best.own") == 1, "spelling").otherwise("closer")
    return rows.select("block", "code", (-F.col("best.minus")).alias("seat"), "same", F.col("best.similarity").alias("best"), verdict.alias("verdict"))


def row_shifts(told: DataFrame, least: int = 3) -> DataFrame:
    """block, shift, rows, mismatches, shifted of blocks with closer names (told: of closer_names()): the commonest distance of
    numbers to the closer name, of these the smallest; shifted: so many rows have it, and half of all mismatches."""
    block = Window.partitionBy("block")
    all_of = told.groupBy("block").agg(F.count(F.lit(1)).alias("mismatches"))
    by = told.where("verdict = 'closer'").groupBy("block", (F.col("seat") - F.col("code")).alias("shift")).agg(F.count(F.lit(1)).alias("rows"))
    first = by.withColumn("nth", F.row_number().over(block.orderBy(F.desc("rows"), F.abs("shift"), "shift"))).where("nth = 1").drop("nth")
    return first.join(all_of, "block").withColumn("shifted", (F.col("rows") >= least) & (2 * F.col("rows") >= F.col("mismatches")))
