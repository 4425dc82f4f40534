"""Linking records by name, within blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from hustings.functions.sequences import edit_distances
from hustings.operators.pieces import all_met


def flat(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def phonetic(name: Column) -> Column:
    """Spelling variants folded, doubled letters made one, H dropped."""
    key = flat(name)
    #: Spellings that are one sound.
    for a, b in (("KSH", "X"), ("SH", "S"), ("CH", "C"), ("PH", "F"), ("W", "V"), ("EE", "I"), ("OO", "U"), ("Y", "I")):
        key = F.regexp_replace(key, a, b)
    return F.regexp_replace(F.regexp_replace(key, "H", ""), r"([A-Z])\1+", "$1")


def skeleton(name: Column) -> Column:
    """Consonants and digits only."""
    return F.regexp_replace(phonetic(name), "[AEIOU]", "")


def likeness(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - F.levenshtein(a, b).cast("double") / longer)


def nearest(block: list[str], least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For all_met() on names and their flat forms: of each name (of left, where so it says, else of right) the likeliest of the
    other piece, of several the first, if like enough; likeness as likeness() tells it."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("left_name"), right.sort_by("right_name")
        i = j = np.zeros(0, dtype=np.int64)
        score, from_left = np.zeros(0), np.zeros(0, dtype=bool)
        if left.num_rows and right.num_rows:
            flats = left["left_flat"].to_pylist(), right["right_flat"].to_pylist()
            longer = np.maximum(*np.ix_(*(list(map(len, x)) for x in flats))).astype(float)
            like = 1 - edit_distances(*flats) / np.where(longer > 0, longer, np.nan)
            like[np.isnan(like)] = -np.inf
            i = np.concatenate([np.arange(left.num_rows), like.argmax(axis=0)])
            j = np.concatenate([like.argmax(axis=1), np.arange(right.num_rows)])
            score, from_left = like[i, j], np.arange(len(i)) < left.num_rows
            enough = score >= least
            i, j, score, from_left = i[enough], j[enough], score[enough], from_left[enough]
        return pa.table({k: left[k].take(i) for k in block} | {"left_name": left["left_name"].take(i), "right_name": right["right_name"].take(j), "score": score, "from_left": from_left})

    return work


def mutual_best(left: DataFrame, right: DataFrame, block: list[str], least: float = 0.72) -> DataFrame:
    """Pairs (left_name, right_name) of one block that are each other's likeliest, and like enough.

    Only names whose skeletons begin alike are compared, all of a block's, a piece of each side at a time; of a piece each name
    keeps its likeliest only, so that pairs are no rows.
    """
    named = lambda rows, side: rows.select(*block, F.col("name").alias(f"{side}_name"), flat(F.col("name")).alias(f"{side}_flat"), F.left(skeleton(F.col("name")), F.lit(2)).alias("head")).where("head is not null").distinct()
    a, b = named(left, "left"), named(right, "right")
    schema = StructType([a.schema[k] for k in block]).add("left_name", StringType()).add("right_name", StringType()).add("score", DoubleType()).add("from_left", BooleanType())
    near = all_met(a, b, [*block, "head"], ("left_name", "right_name"), nearest(block, least), schema)
    own, other = (F.when(F.col("from_left"), F.col(x)).otherwise(F.col(y)) for x, y in (("left_name", "right_name"), ("right_name", "left_name")))
    best = near.groupBy(*block, "from_left", own.alias("own")).agg(F.min(F.struct((-F.col("score")).alias("minus"), other.alias("other"))).alias("best"))
    name = lambda side: F.when(F.col("from_left") == side, F.col("own")).otherwise(F.col("best.other"))
    chosen = best.select(*block, name(True).alias("left_name"), name(False).alias("right_name"), (-F.col("best.minus")).alias("score"))
    return chosen.groupBy(*block, "left_name", "right_name").agg(F.count(F.lit(1)).alias("sides"), F.max("score").alias("score")).where("sides = 2").drop("sides")


def unambiguous(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with one value only, and that value."""
    return rows.groupBy(*keys).agg(F.count_distinct(value).alias("values"), F.min(value).alias(value)).where(F.col("values") == 1).drop("values")
