"""Contest tables derived from the star-schema tables: candidates, by-elections and the small rule tables.

Each order line is a bundle of votes. Its line status tells the arena (AE: state assembly, GE: national), the customer's
nation is the state, the customer's number gives the seat, the part's type is the party.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.functions.canon import alliance_of, continuity, reservation_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line: arena, s, y, n, p, urgent, quantity."""
    read = lambda name: table(spark, sf_dir, name)
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity")
    orders = read("orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    customers = read("customer").select("c_custkey", "c_nationkey")
    nations = read("nation").select("n_nationkey", "n_name")
    parts = read("part").select("p_partkey", "p_type")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.when(F.col("l_linestatus") == "F", "AE").otherwise("GE").alias("arena"), F.col("n_name").alias("s"), "y",
        (1 + F.col("c_custkey") % 6).cast("int").alias("n"), F.col("p_type").alias("p"), "urgent", F.col("l_quantity").alias("quantity"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arena, s, y, n, p, votes: general elections."""
    return votes(spark, sf_dir).groupBy("arena", "s", "y", "n", "p").agg(F.sum("quantity").cast("long").alias("votes"))


def bypoll_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arena, s, y, n, p, votes: contests of urgent orders alone count as by-elections, for seats 1 to 3."""
    return votes(spark, sf_dir).where("urgent and n <= 3").groupBy("arena", "s", "y", "n", "p").agg(F.sum("quantity").cast("long").alias("votes"))


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s and pc, the region that a state's seats report to."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.col("r_name").alias("pc"))


def labelled(seats: DataFrame) -> DataFrame:
    """Seats with continuity number j, name c, reservation r, alliance a and turnout t."""
    return seats.select(
        "*", continuity(F.col("arena"), F.col("s"), F.col("y"), F.col("n")).alias("j"), F.concat_ws("-", "s", "n").alias("c"),
        reservation_of(F.col("n")).alias("r"), alliance_of(F.col("p")).alias("a"), (50 + F.col("total") % 40).cast("double").alias("t"),
    )
