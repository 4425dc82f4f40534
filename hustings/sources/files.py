"""Reading exports by a header contract, and writing results by state and year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Text columns of one or many CSV files with a header, gzip included; a header that breaks the contract raises.

    A gzip file is read by one task, so its rows are dealt out again.
    """
    rows = spark.read.option("header", True).csv(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return rows.select(*columns).repartition(spark.sparkContext.defaultParallelism)


def candidates_csv(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Candidates of any layout: `names` gives for arena, s, y, n, p and votes the file's column or columns, which are added."""
    rows = csv(spark, path, sorted({c for v in names.values() for c in v.split("+")}))
    number = lambda spec: sum((F.coalesce(F.regexp_replace(F.col(c), ",", "").try_cast("long"), F.lit(0)) for c in spec.split("+")), F.lit(0))
    return rows.select(F.col(names["arena"]).alias("arena"), F.trim(names["s"]).alias("s"), F.col(names["y"]).try_cast("int").alias("y"), F.col(names["n"]).try_cast("int").alias("n"), F.trim(names["p"]).alias("p"), number(names["votes"]).cast("long").alias("votes"))


def write_by_state(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """One folder for each state and year, which later reads of one state prune to."""
    rows.repartition("s", "y").write.mode("overwrite").partitionBy("s", "y").format(kind).save(path)


def read_state(spark: SparkSession, path: str, state: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path).where(F.col("s") == state)


def manifest(rows: DataFrame) -> DataFrame:
    """What is there: elections and their rows."""
    return rows.groupBy("arena", "s", "y").agg(F.count(F.lit(1)).alias("rows"))
