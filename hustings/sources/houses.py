"""Houses of many seats, of order lines: forty seats a state, an election every other year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.operators import resolve
from hustings.sources.contests import table

FIRST_YEAR, SEATS = 1995, 40


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """arena, s, y, n, p, votes."""
    read = lambda name: table(spark, sf_dir, name)
    orders = read("orders").select("o_orderkey", "o_custkey", (F.lit(FIRST_YEAR) + 2 * F.floor((F.year("o_orderdate") - FIRST_YEAR) / 2)).cast("int").alias("y"))
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    placed = lines.join(read("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(read("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).join(read("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    keys = [F.when(F.col("l_linestatus") == "F", "AE").otherwise("GE").alias("arena"), F.col("n_name").alias("s"), F.col("y"), (1 + F.col("l_orderkey") % SEATS).cast("int").alias("n"), F.col("p_type").alias("p")]
    return placed.groupBy(*keys).agg(F.sum("l_quantity").cast("long").alias("votes"))


def scoped(rows: DataFrame) -> DataFrame:
    """rows with scope: the state in state elections, all of them in national ones."""
    return rows.withColumn("scope", F.when(F.col("arena") == "AE", F.col("s")).otherwise("all"))


def history(cand: DataFrame) -> DataFrame:
    """arena, scope, s, y, n, p, q, v, m, r of every seat and election."""
    reserved = F.when(F.col("n") % 5 == 0, "SC").when(F.col("n") % 5 == 1, "(ST)")
    return scoped(resolve.contests(cand)).select("arena", "scope", "s", "y", "n", "p", "q", "v", "m", reserved.alias("r"))


def active(rows: DataFrame) -> DataFrame:
    """The last election of each arena."""
    return rows.join(rows.groupBy("arena").agg(F.max("y").alias("y")), ["arena", "y"]).drop("y")


def parties(cand: DataFrame, seats: DataFrame) -> DataFrame:
    """arena, scope, y, p, v (share of votes), wo (seats)."""
    votes = scoped(cand).groupBy("arena", "scope", "y", "p").agg(F.sum("votes").alias("votes"))
    whole = votes.groupBy("arena", "scope", "y").agg(F.sum("votes").alias("all"))
    won = seats.groupBy("arena", "scope", "y", "p").agg(F.count(F.lit(1)).alias("wo"))
    rows = votes.join(whole, ["arena", "scope", "y"]).join(won, ["arena", "scope", "y", "p"], "left")
    return rows.select("arena", "scope", "y", "p", (F.col("votes") * 100.0 / F.col("all")).alias("v"), F.coalesce("wo", F.lit(0)).alias("wo"))
