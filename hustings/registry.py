"""Registers queries by name with the DuckDB SQL of their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.functions import canon


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that two engines' sums can be compared."""
    return df.select(*[canon.r6(F.col(c)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
        self.queries[name] = lambda spark, sf_dir: rounded(build(spark, sf_dir))
        if sql:
            self.oracle[name] = sql
