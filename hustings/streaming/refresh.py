"""Additive refresh: new candidate files are merged into the kept seats as they arrive; elections already kept stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hustings.operators.merge import base_wins
from hustings.operators.resolve import contests

SCHEMA = "arena string, s string, y int, n int, p string, votes long"


def refresh(spark: SparkSession, source: str, kept: str, checkpoint: str) -> StreamingQuery:
    """Reads candidate Parquet files as they come; each batch's contests are added to `kept` where base lacks the election.

    A batch is written under its own number, so that one that is repeated after a failure replaces itself.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = contests(batch)
        others = [p for p in _parts(spark, kept) if not p.endswith(f"batch={number}")]
        if others:
            base = spark.read.parquet(*others).select(*new.columns)
            new = base_wins(base.limit(0), new, ["arena", "s", "y"]).join(base.select("arena", "s", "y").distinct(), ["arena", "s", "y"], "left_anti").select(*new.columns)
        new.write.mode("overwrite").parquet(f"{kept}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark: SparkSession, path: str) -> list[str]:
    """The batches' folders, by Hadoop's file system, wherever the path is."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(x.getPath()) for x in files.listStatus(root)] if files.exists(root) else []
