"""Small places, derived from customers: a village or a town's ward each, with people, households and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.sources.contests import table


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, name, s, district, town, n (the seat it is placed in), level, pop, hh, lit, kids, urban, power (per cent, some null)."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    pop = 200 + (k * 37) % 900
    return rows.select(
        k.alias("code"), F.col("c_name").alias("name"), F.col("n_name").alias("s"), (k % 4).cast("int").alias("district"), (k % 24).cast("int").alias("town"),
        (1 + k % 6).cast("int").alias("n"), F.when(k % 3 == 0, "WARD").otherwise("VILLAGE").alias("level"), pop.alias("pop"), (pop / 5).cast("long").alias("hh"),
        (pop * (40 + k % 50) / 100).cast("long").alias("lit"), (pop / 8).cast("long").alias("kids"), (k % 3 == 0).alias("urban"), F.when(k % 11 != 0, (k % 101).cast("double")).alias("power"),
    )
