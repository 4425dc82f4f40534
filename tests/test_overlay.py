"""Overlay of polygons against exact areas of clipped ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from hustings.operators import overlay

RINGS = "id long, points array<struct<x: double, y: double>>"


def area(points):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True))) / 2


def clipped(subject, clip):
    """What of a polygon lies in a convex one that runs counter-clockwise."""
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p, ax=ax, ay=ay, bx=bx, by=by: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)
        out = []
        for p, q in zip(subject, subject[1:] + subject[:1], strict=True):
            s, t = side(p), side(q)
            if s >= 0:
                out.append(p)
            if s * t < 0:
                out.append((p[0] + (q[0] - p[0]) * s / (s - t), p[1] + (q[1] - p[1]) * s / (s - t)))
        subject = out
        if not subject:
            return []
    return subject


def triangle(rnd):
    points = [(rnd.uniform(0, 100), rnd.uniform(0, 100)) for _ in range(3)]
    (ax, ay), (bx, by), (cx, cy) = points
    return points if (bx - ax) * (cy - ay) > (by - ay) * (cx - ax) else points[::-1]


def test_overlaps_of_triangles_are_near_the_exact_ones(spark):
    rnd = random.Random(4)
    a, b = [triangle(rnd) for _ in range(25)], [triangle(rnd) for _ in range(25)]
    frames = [overlay.as_edges(spark.createDataFrame([(i, list(t)) for i, t in enumerate(layer)], RINGS)) for layer in (a, b)]
    height = 0.1
    cut = [overlay.runs(f, height) for f in frames]
    sizes = {r.id: r.area for r in overlay.areas(cut[0], height).collect()}
    assert all(abs(sizes[i] - area(t)) <= 3 * height for i, t in enumerate(a))
    got = {(r.a, r.b): r.overlap for r in overlay.overlaps(cut[0], cut[1], height, 10.0).collect()}
    want = {(i, j): area(c) for i, s in enumerate(a) for j, t in enumerate(b) if len(c := clipped(s, t)) > 2}
    # A shared polygon has six corners at most; each bends two edges within one row.
    assert all(abs(got.get(k, 0) - v) <= 12 * height for k, v in want.items()) and all(v <= 12 * height for k, v in got.items() if k not in want)
    assert sum(abs(got.get(k, 0) - v) for k, v in want.items()) / sum(want.values()) < 0.001


def test_holes_shares_and_likeness(spark):
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    a = [(1, box(0.0, 0.0, 10.0, 10.0)), (1, box(2.0, 2.0, 4.0, 4.0)), (2, box(-5.0, -5.0, 2.0, 2.0)), (3, box(50.0, 50.0, 1.0, 1.0)), (4, [(0.0, 0.0), (1.0, 1.0)])]
    b = [(1, box(0.0, 0.0, 6.0, 10.0)), (2, box(6.0, 0.0, 4.0, 10.0)), (3, box(0.0, 9.0, 5.0, 1.0)), (4, box(-5.0, -5.0, 2.0, 2.0))]
    got = {(r.a, r.b): (r.overlap, r.share, r.iou) for r in overlay.overlay(*[overlay.as_edges(spark.createDataFrame(x, RINGS)) for x in (a, b)], 0.5, 3.0).collect()}
    # Of the box with a hole 44 lie in the first, 40 in the second; the third has 5 of 89, which is too little to count.
    assert got == {(1, 1): (44.0, pytest.approx(44 / 84), 44 / (84 + 60 - 44)), (1, 2): (40.0, pytest.approx(40 / 84), 40 / 84), (2, 4): (4.0, 1.0, 1.0)}


def test_no_polygons(spark):
    none = overlay.as_edges(spark.createDataFrame([], RINGS))
    assert overlay.overlay(none, none, 1.0, 1.0).count() == 0
    nulls = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    assert overlay.runs(nulls, 1.0).where(F.col("low").isNotNull()).count() == 0


def test_no_layer_is_sent_to_the_driver(spark, tmp_path):
    box = F.array(*[F.struct((F.col("id") + x).cast("double").alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3000), (0, 3000))])
    spark.range(5).select("id", box.alias("points")).write.parquet(str(tmp_path / "boxes"))
    edges = overlay.as_edges(spark.read.parquet(str(tmp_path / "boxes")))
    told = overlay.overlay(edges, edges, 0.5, 1.0)
    got = {(r.a, r.b): r.share for r in told.collect()}
    # Few polygons with many rows and stretches: their number says nothing of that of their runs.
    assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
    assert set(got) == {(i, j) for i in range(5) for j in range(5) if abs(i - j) <= 1} and got[2, 1] == pytest.approx(1 / 4)
