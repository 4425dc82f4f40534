"""Made-up maps: seats are corners of two boxes, one for each customer; districts boxes that overlap a little, one for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.sources.contests import table

#: Height of the scan rows, and the stretch of a row under which runs meet.
HEIGHT, STRETCH = 0.5, 28.0


def ring(key: str, x: str, y: str, corners: list[tuple[int, int]]) -> list:
    at = lambda dx, dy: F.struct(F.expr(f"cast({x} + {dx} as double)").alias("x"), F.expr(f"cast({y} + {dy} as double)").alias("y"))
    return [F.col(key).cast("long").alias("id"), F.array(*[at(*c) for c in corners]).alias("points")]


def seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(*ring("c_custkey", "c_custkey % 40 * 7 + c_custkey % 3", "c_custkey div 40 * 7", [(0, 0), (8, 0), (8, 3), (3, 3), (3, 9), (0, 9)]))


def districts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(*ring("s_suppkey", "s_suppkey % 10 * 28", "s_suppkey div 10 * 28", [(0, 0), (28, 0), (28, 30), (0, 30)]))
