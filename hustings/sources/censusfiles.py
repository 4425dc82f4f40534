"""A folder of district files: digests against a manifest, rows of all files with codes repaired, and control totals.

Files are CSV exports, one for each district, whose name tells the codes of state and district. Each is read whole by no
task but the one that digests it; rows are read by Spark's CSV source, which splits and spreads them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Widths of the codes of a unit, and levels that are units.
WIDTHS = {"State": 2, "District": 3, "Subdistt": 5, "Town/Village": 6, "Ward": 4}
UNIT_LEVELS = ("VILLAGE", "WARD")
#: State and district in a file's name.
NAMED = r"-(\d{2})(\d{3})[-.]"


def digests(spark: SparkSession, folder: str, pattern: str = "*.csv*") -> DataFrame:
    """file, sha256, bytes of every file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def against_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """file and state of every file of either (manifest: file, sha256): ok, changed, missing or unlisted; upper and lower case of digests are one."""
    told = manifest.select("file", F.lower("sha256").alias("due")).distinct()
    both = found.select("file", "sha256").join(told, "file", "full")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("due").isNull(), "unlisted").when(F.col("sha256") == F.col("due"), "ok").otherwise("changed")
    return both.select("file", state.alias("state"))


def code(x: Column, width: int) -> Column:
    """A code without a decimal part, filled up with zeros; longer ones stay whole."""
    bare = F.substring_index(F.trim(F.coalesce(x, F.lit(""))), ".", 1)
    return F.when(F.char_length(bare) >= width, bare).otherwise(F.lpad(bare, width, "0"))


def read(spark: SparkSession, folder: str, counts: Sequence[str], pattern: str = "*.csv*") -> DataFrame:
    """Rows of all files: codes at their widths, Level, TRU, Name, counts (unreadable ones 0), file, and how many counts were no numbers (odd).

    A state or district that is no number is repaired from the file's name (repaired); a number that differs stays (differs).
    A file that lacks a column raises; columns may stand in any order and have spaces around their names.
    """
    names = [f for f, in digests(spark, folder, pattern).select("file").collect()]  # a folder's listing
    headers = {n: tuple(spark.read.option("header", True).csv(f"{folder}/{n}").columns) for n in names}
    frames = []
    for header in sorted(set(headers.values())):  # files of one header are read together
        same = [f"{folder}/{n}" for n in names if headers[n] == header]
        rows = spark.read.schema(", ".join(f"c{i} string" for i in range(len(header)))).option("header", True).option("enforceSchema", True).csv(same)
        rows = rows.toDF(*[c.strip() for c in header])
        missing = [c for c in (*WIDTHS, "Level", "TRU", "Name", *counts) if c not in rows.columns]
        if missing:
            raise ValueError(f"{same[0]}: no column {', '.join(missing)}")
        frames.append(rows.select(*[F.col(f"`{c}`") for c in (*WIDTHS, "Level", "TRU", "Name", *counts)], F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")))
    if not frames:
        raise ValueError(f"{folder}: no files like {pattern}")
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    number = lambda c: F.regexp_replace(F.trim(f"`{c}`"), ",", "").try_cast("double")
    odd = sum((F.coalesce((F.trim(f"`{c}`") != "") & number(c).isNull(), F.lit(False)).cast("int") for c in counts), F.lit(0))
    told = rows.select(*[code(F.col(f"`{c}`"), w).alias(c) for c, w in WIDTHS.items()], F.upper(F.trim("Level")).alias("Level"), F.initcap(F.trim("TRU")).alias("TRU"), "Name", *[F.coalesce(number(c), F.lit(0)).cast("long").alias(c) for c in counts], "file", odd.alias("odd"))
    state, district = (F.regexp_extract("file", NAMED, i) for i in (1, 2))
    sound = F.col("State").rlike(r"^\d{2}$") & F.col("District").rlike(r"^\d{3}$")
    known = state != ""
    told = told.withColumns({"repaired": known & ~sound, "differs": known & sound & ((F.col("State") != state) | (F.col("District") != district))})
    return told.withColumns({"State": F.when(F.col("repaired"), state).otherwise(F.col("State")), "District": F.when(F.col("repaired"), district).otherwise(F.col("District"))})


def units(rows: DataFrame) -> DataFrame:
    """Villages and wards."""
    return rows.where(F.col("Level").isin(*UNIT_LEVELS))


def control_gaps(rows: DataFrame, counts: Sequence[str]) -> DataFrame:
    """file, field, total, parts, gap: by how much a district's own total (level DISTRICT, Total) differs from its units' sum; a file without either has null."""
    level = F.when((F.col("Level") == "DISTRICT") & (F.col("TRU") == "Total"), "total").when(F.col("Level").isin(*UNIT_LEVELS), "parts")
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in counts]))
    each = rows.select("file", level.alias("level"), fields.alias("x")).select("file", "level", "x.*")
    sums = each.groupBy("file", "field").agg(*[F.sum(F.when(F.col("level") == kind, F.col("n"))).alias(kind) for kind in ("total", "parts")])
    return sums.withColumn("gap", F.col("total") - F.col("parts"))
