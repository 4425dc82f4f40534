"""Tables that are written to the shared folder and read again, where a plan would otherwise be carried on and on."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

#: Used only where the session runs on one machine and names no shared folder, as in tests.
LOCAL = "file:///tmp/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a table of their own in spark.checkpoint.dir: its plan is short, and a lost executor loses nothing."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    path = f"{(root or LOCAL).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing will read any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
