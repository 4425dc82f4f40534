"""Two lists of seats that name the same seats differently: one of customers, one of suppliers, with spellings, renamed
directions, slips and wrong numbers by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hustings.sources.contests import table

HEX, LETTERS = "0123456789abcdef", "kanirutosemaludi"


def made_up(seed: str) -> Column:
    """A name that can be read out."""
    return F.initcap(F.translate(F.substring(F.md5(F.expr(seed).cast("binary")), 1, 9), HEX, LETTERS))


def directions(k: str, north: str, cantonment: str) -> Column:
    return F.expr(f"case {k} % 7 when 0 then '{north}' when 3 then '{cantonment}' else '' end")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, seat, names, parent, numbers of every customer; a third have an older name as well."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    name = F.concat(made_up("concat('seat', k)"), directions("k", " North", " Cantonment"), F.expr("if(k % 9 = 4, ' (SC)', '')"))
    names = F.when(F.col("k") % 3 == 0, F.array(name, F.concat(F.lit("Old "), made_up("concat('old', k)")))).otherwise(F.array(name))
    return k.select(F.expr("k % 25").alias("block"), F.col("k").alias("seat"), names.alias("names"), made_up("concat('parent', k % 10)").alias("parent"), F.array("k").alias("numbers"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, code, name, parent, number of every supplier, who stands for the customer of the same number."""
    k = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    base = made_up("concat('seat', k)")
    swapped = F.concat(F.substring(base, 1, 2), F.substring(base, 4, 1), F.substring(base, 3, 1), F.substring(base, 5, 9))
    spelled = F.regexp_replace(F.regexp_replace(base, "a", "aa"), "t", "th")
    name = F.expr("k % 6")
    varied = F.when(name == 1, spelled).when(name == 2, F.left(base, F.lit(8))).when(name == 3, swapped).when(name == 4, made_up("concat('other', k)")).when(name == 5, F.concat(F.substring(base, 1, 3), F.substring(base, 6, 9))).otherwise(F.upper(base))
    number = F.expr("case k % 8 when 0 then k when 2 then k when 4 then k + 25 end")
    return k.select(F.expr("k % 25").alias("block"), F.col("k").alias("code"), F.concat(varied, directions("k", " Uttar", " Cantt")).alias("name"), F.concat(made_up("concat('parent', k % 10)"), F.expr("if(k % 4 = 1, 'x', '')")).alias("parent"), number.alias("number"))


def sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, n, side (TG, AP or unknown): the seats of a state that was parted, some numbers missing."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).where("k % 11 != 5")
    digit = F.left(F.md5(F.expr("concat('side', k div 3)").cast("binary")), F.lit(1))
    return k.select(F.expr("k % 25").alias("block"), F.expr("k div 25").alias("n"), F.when(digit.isin(*"0123"), "TG").when(digit.isin(*"45"), "AP").alias("side"))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, n, name, nth: a source that gives several seats one number, and some seats two rows."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    rows = k.select(F.expr("k % 25").alias("block"), F.expr("1 + (k div 25) % 35").alias("n"), F.concat(F.lit("Seat no "), F.expr("if(k % 13 = 0, 25 * ((k div 25) % 35) + k % 25, k)")).alias("name"), F.col("k").alias("nth"))
    return rows.unionByName(rows.where("nth % 4 = 0").withColumn("name", F.concat(F.upper("name"), F.lit(" (SC)"))).withColumn("nth", F.col("nth") + 1_000_000_000))


def official_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """block, n, name: for a third of the seats, some with two numbers."""
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")).where("k % 3 = 0")
    rows = k.select(F.expr("k % 25").alias("block"), F.expr("1 + (k div 25) + 2 * (k % 2)").alias("n"), F.concat(F.lit("SEAT NO-"), "k").alias("name"))
    return rows.unionByName(rows.where("n % 7 = 0").withColumn("n", F.col("n") + 1))
