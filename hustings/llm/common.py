"""What the operators of this subpackage share: table access, the shared scratch folder, Arrow helpers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session runs on one machine and names no shared folder, as in tests.
LOCAL_SCRATCH = "file:///tmp/checkpoints"
#: Rows of a few numbers each in one file, about, where their number is known.
FILE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read by Spark, wherever the folder is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    root = root or LOCAL_SCRATCH
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage is cut, and a lost executor loses nothing.

    rows: how many there are at most, if that is known and they are short. They go to so few files then, even where Spark
    leaves small partitions apart: on a local disk the JVM starts processes for each file, which share its memory at first.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(sizes_bounded(rows, FILE_ROWS))
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more: all that was made of them is written itself."""
    for table in tables:
        files = table.inputFiles()
        if files:
            spark = table.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text"):
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def text_groups(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of neighbouring texts with about `most` characters together (one text at least)."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few rows, so that Python objects of one batch stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def sizes_bounded(rows: int, per_part: int, most: int = 200_000) -> int:
    """How many parts hold `rows` rows at `per_part` each, from 1 to `most`."""
    return max(1, min(most, -(-rows // per_part)))
