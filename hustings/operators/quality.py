"""Checks as tables: what was checked, expected and got, and whether it holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check(name: str, rows: DataFrame, expected: Column, got: Column) -> DataFrame:
    return rows.agg(expected.cast("string").alias("expected"), got.cast("string").alias("got")).select(F.lit(name).alias("check"), "expected", "got", F.col("expected").eqNullSafe(F.col("got")).alias("ok"))


def report(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def additive(parts: DataFrame, whole: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys at which the parts' sums differ from the published whole, or that one side lacks."""
    sums = parts.groupBy(*keys).agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    both = sums.join(whole.select(*keys, *values), keys, "full")
    wrong = reduce(lambda a, b: a | b, [~F.col(f"sum_{v}").eqNullSafe(F.col(v)) for v in values])
    return both.where(wrong)


def unique_and_whole(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Whether a group's numbers are distinct and run from 1 without a gap."""
    n = F.col(number)
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(number).alias("distinct"), (F.count(F.lit(1)) == F.count_distinct(number)).alias("is_unique"), ((F.min(n) == 1) & (F.max(n) == F.count_distinct(number))).alias("is_whole"))


def only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one of two tables lacks, and which has them."""
    one, other = a.select(*keys).distinct(), b.select(*keys).distinct()
    return one.exceptAll(other).withColumn("only_in", F.lit("a")).unionByName(other.exceptAll(one).withColumn("only_in", F.lit("b")))


def coverage(rows: DataFrame, places: Column, weight: str, *keys: str) -> DataFrame:
    """People by how many places a unit is found in: none, one or several; in per cent of all."""
    kind = F.when(places == 0, "none").when(places == 1, "one").otherwise("several")
    sums = rows.groupBy(*keys, kind.alias("bucket")).agg(F.sum(weight).alias("weight"))
    return sums.withColumn("pct", F.col("weight").cast("double") * 100 / F.sum("weight").over(Window.partitionBy(*keys)))


def identity_failures(rows: DataFrame, keys: list[str], total: str, parts: list[str]) -> DataFrame:
    """By keys, rows with all numbers there, and those whose parts don't add up to the total."""
    whole = rows.where(" and ".join(f"{c} is not null" for c in (total, *parts)))
    return whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(total) != sum((F.col(p) for p in parts), F.lit(0))).alias("failed"))
