"""All rows of one table against all of another within blocks, a piece of each at a time.

For work on pairs that keeps few of them, or one for a row: pairs are never rows of a table. Both sides are cut into pieces by a
hash of their ids, and each piece of a block's left side meets each of its right side in one group. So a task holds two pieces,
however large a block is, and a pair of ids is met in one group only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a piece of the left and of the right side.
ROWS = (512, 2048)


def all_met(left: DataFrame, right: DataFrame, keys: Sequence[str], ids: tuple[str, str], work: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, rows: tuple[int, int] = ROWS) -> DataFrame:
    """What work() gives for each piece of left and each of right with equal keys; a piece may be empty. ids: columns of left and
    right whose equal values stay in one piece. Null keys meet nothing."""
    spark = left.sparkSession
    right = right.withColumns({k: F.col(k).try_cast(left.schema[k].dataType) for k in keys if right.schema[k].dataType != left.schema[k].dataType})
    pieces = lambda side, most, name: side.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    of = pieces(left, rows[0], "left_of").join(pieces(right, rows[1], "right_of"), [*keys])
    piece = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = [*keys, "left_piece", "right_piece"]
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    sides = (
        left.join(of, [*keys]).withColumn("left_piece", piece(ids[0], "left_of")).withColumn("right_piece", every("right_of")),
        right.join(of, [*keys]).withColumn("right_piece", piece(ids[1], "right_of")).withColumn("left_piece", every("left_of")),
    )
    one, other = (side.drop("left_of", "right_of").repartition(dealt, *at).groupBy(*at) for side in sides)
    return one.cogroup(other).applyInArrow(work, schema)
