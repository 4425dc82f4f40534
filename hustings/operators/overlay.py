"""Areal overlay of polygons by scan lines.

A polygon is a set of edges (id, x1, y1, x2, y2): rings of any number, holes included, inside being what an odd number of
edges surrounds. Lines at the middle of rows of equal height cut it into runs, whose ends are exact. Runs of two layers
overlap where they share a row; they meet under the row and a stretch of it, so no polygon meets all others. A row's part of
an area is its runs' length times its height, which is exact but for rows in which an edge begins or ends: the error of an
area is a row's height times the width that the polygon gains or loses there, so it falls with the height.

Joins are told to merge: Spark takes a polygon's rows and stretches for one row each, and would send whole layers to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def runs(edges: DataFrame, height: float) -> DataFrame:
    """id, row, low, high: the runs of every polygon in rows of such a height. Edges with a null are left out; a level edge cuts nothing."""
    cut = lambda y: F.ceil(y / height - 0.5)
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null and y1 != y2")
    crossed = rows.withColumn("first", cut(low)).withColumn("last", cut(high) - 1).where("first <= last").withColumn("row", F.explode(F.sequence("first", "last")))
    at = F.col("x1") + (F.col("x2") - F.col("x1")) * ((F.col("row") + 0.5) * height - F.col("y1")) / (F.col("y2") - F.col("y1"))
    ends = crossed.select("id", "row", at.alias("x")).groupBy("id", "row").agg(F.array_sort(F.collect_list("x")).alias("ends"))
    pairs = F.filter(F.transform("ends", lambda x, i: F.struct(x.alias("low"), F.get("ends", i + 1).alias("high"), i.alias("i"))), lambda p: (p["i"] % 2 == 0) & p["high"].isNotNull() & (p["high"] > p["low"]))
    return ends.select("id", "row", F.explode(pairs).alias("run")).select("id", "row", "run.low", "run.high")


def areas(cut: DataFrame, height: float) -> DataFrame:
    """id, area of runs."""
    return cut.groupBy("id").agg((F.sum(F.col("high") - F.col("low")) * height).alias("area"))


def overlaps(a: DataFrame, b: DataFrame, height: float, stretch: float) -> DataFrame:
    """a, b, overlap: the area that polygons of two layers of runs share; pairs that share none are not there.

    stretch: about the width of a small polygon; a run is listed under each stretch that it touches, cut at its ends."""

    def listed(cut: DataFrame, name: str) -> DataFrame:
        at = cut.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("low") / stretch), F.floor(F.col("high") / stretch))))
        return at.select(F.col("id").alias(name), "row", "stretch", F.greatest("low", F.col("stretch") * stretch).alias(f"{name}_low"), F.least("high", (F.col("stretch") + 1) * stretch).alias(f"{name}_high"))

    met = listed(a, "a").join(listed(b, "b").hint("merge"), ["row", "stretch"])
    shared = F.least("a_high", "b_high") - F.greatest("a_low", "b_low")
    return met.withColumn("shared", shared).where("shared > 0").groupBy("a", "b").agg((F.sum("shared") * height).alias("overlap"))


def overlay(a: DataFrame, b: DataFrame, height: float, stretch: float, least: float = 0.1) -> DataFrame:
    """a, b, overlap, share, iou: by what share each polygon of a lies in those of b, and how alike the two are.

    Shares of what lies in b at all; those below `least` go, but for the largest, and the others are made whole. iou: the
    shared area over that of both together."""
    cut_a, cut_b = runs(a, height), runs(b, height)
    area = lambda cut, id_: areas(cut, height).withColumnsRenamed({"id": id_, "area": f"{id_}_area"}).hint("merge")
    sizes = overlaps(cut_a, cut_b, height, stretch).join(area(cut_a, "a"), "a").join(area(cut_b, "b"), "b")
    w = Window.partitionBy("a")
    part = sizes.withColumn("part", F.col("overlap") / F.sum("overlap").over(w)).withColumn("nth", F.row_number().over(w.orderBy(F.desc("overlap"), "b")))
    kept = part.where((F.col("part") >= least) | (F.col("nth") == 1))
    return kept.select("a", "b", "overlap", (F.col("part") / F.sum("part").over(w)).alias("share"), (F.col("overlap") / (F.col("a_area") + F.col("b_area") - F.col("overlap"))).alias("iou"))


def as_edges(rings: DataFrame) -> DataFrame:
    """id, x1, y1, x2, y2 of rings (id, points: arrays of x and y, the last point joined to the first)."""
    following = F.transform("points", lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get("points", (i + 1) % F.size("points"))["x"].alias("x2"), F.get("points", (i + 1) % F.size("points"))["y"].alias("y2")))
    return rings.where("size(points) > 2").select("id", F.explode(following).alias("e")).select("id", "e.*")
