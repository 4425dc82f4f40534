"""Placement, linkage, calibration, quality, files and refresh."""

from __future__ import annotations

import gzip
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from hustings.functions.sequences import edit_distances
from hustings.operators import calibrate, linkage, place, quality
from hustings.sources import files
from hustings.streaming.refresh import SCHEMA, refresh


def test_vetoed_seat_keeps_its_largest_district(spark):
    rows = spark.createDataFrame([("S", 1, 1, 0.7), ("S", 1, 2, 0.3), ("S", 2, 1, 0.4), ("S", 2, 3, 0.6)], "s string, n int, district int, share double")
    got = {(r.n, r.district): r.share for r in place.vetoed(rows, F.col("district") == 1).collect()}
    assert got == {(1, 1): 1.0, (2, 1): 1.0}
    assert {(r.n, r.district) for r in place.vetoed(rows, F.col("district") == 9).collect()} == {(1, 1), (2, 3)}


def test_overlay_shares(spark):
    a = spark.createDataFrame([(1, 0, 0, 4, 5)], "id int, x1 int, y1 int, x2 int, y2 int")
    b = spark.createDataFrame([(10, 0, 0, 2, 5), (11, 2, 0, 4, 4), (12, 2, 4, 3, 5)], "id int, x1 int, y1 int, x2 int, y2 int")
    got = {r.b: r.share for r in place.overlaid(a, b).collect()}
    assert got == {10: pytest.approx(10 / 18), 11: pytest.approx(8 / 18)}


def test_names_meet_their_mutual_best(spark):
    left = spark.createDataFrame([("K", "Shimla"), ("K", "Poona"), ("K", "Nowhere")], "k string, name string")
    right = spark.createDataFrame([("K", "Simla"), ("K", "Puna City"), ("K", "Shimlaa"), ("L", "Shimla")], "k string, name string")
    assert [(r.left_name, r.right_name) for r in linkage.mutual_best(left, right, ["k"]).collect()] == [("Shimla", "Shimlaa")]
    keys = spark.createDataFrame([("Shimla", "Simmla"), ("Poona", "Puna")], "a string, b string").select(linkage.phonetic(F.col("a")).alias("a"), linkage.phonetic(F.col("b")).alias("b")).collect()
    assert all(r.a == r.b for r in keys)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def test_edit_distances_are_those_of_plain_loops():
    rnd = random.Random(3)
    for low, high in ((0, 8), (10, 20), (31, 33), (62, 67)):
        for start in ("", "xy"):
            one, other = ([start + "".join(rnd.choice("abé") for _ in range(rnd.randint(low, high))) for _ in range(12)] for _ in range(2))
            assert edit_distances(one, other).tolist() == [[distance(a, b) for b in other] for a in one]
    assert edit_distances([], ["a"]).shape == (0, 1) and edit_distances(["", "ab"], [""]).tolist() == [[0], [2]]


def test_mutual_best_names_are_those_of_plain_loops(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("TN") + rnd.choice("aio") for _ in range(rnd.randint(2, 4))) + rnd.choice(["", " ", "x" * 70])
    left, right = ([(k, word()) for k in ("K", "L", None) for _ in range(60)] + [("K", None), ("K", "#")] for _ in range(2))
    frames = [spark.createDataFrame(x, "k string, name string") for x in (left, right)]
    keys = {r.name: (r.flat, r.head) for r in frames[0].union(frames[1]).where("name is not null").select("name", linkage.flat(F.col("name")).alias("flat"), F.left(linkage.skeleton(F.col("name")), F.lit(2)).alias("head")).collect()}
    want = set()
    for k in ("K", "L"):
        a, b = ({n for g, n in side if g == k and n is not None} for side in (left, right))
        score = {}
        for x in a:
            for y in b:
                longer = max(len(keys[x][0]), len(keys[y][0]))
                if keys[x][1] == keys[y][1] and longer and (v := 1 - distance(keys[x][0], keys[y][0]) / longer) >= 0.72:
                    score[x, y] = v
        for (x, y), v in score.items():
            if (x, y) == min((p for p in score if p[0] == x), key=lambda p: (-score[p], p[1])) and (x, y) == min((p for p in score if p[1] == y), key=lambda p: (-score[p], p[0])):
                want.add((k, x, y, v))
    assert len(want) > 20 and {tuple(r) for r in linkage.mutual_best(*frames, ["k"]).collect()} == want


def test_names_of_one_head_meet_their_mutual_best_soon(spark):
    left, right = (spark.range(n).select(F.lit(1).alias("k"), F.format_string("Seat %09d", F.col("id") * step).alias("name")) for n, step in ((6000, 2), (4000, 3)))
    began = time.time()
    got = {(r.left_name, r.right_name) for r in linkage.mutual_best(left, right, ["k"]).collect()}
    assert time.time() - began < 45
    assert {(f"Seat {n:09d}",) * 2 for n in range(0, 12_000, 6)} <= got


def test_calibration_meets_targets_within_bounds(spark):
    rng = np.random.default_rng(4)
    means = rng.uniform(0, 100, (12, 3))
    truth = rng.dirichlet(np.ones(12) * 5)
    share = calibrate.calibrated_shares(np.ones(12), means, truth @ means)
    bound = calibrate.calibrated_shares(np.array([1.0, 1.0, 1.0, 7.0]), np.array([[0.0], [0.0], [0.0], [100.0]]), np.array([0.0]))
    prior = np.array([1.0, 1.0, 1.0, 7.0]) / 10
    assert abs(bound.sum() - 1) < 1e-9 and (bound >= 0.2 * prior - 1e-9).all() and (bound <= 5 * prior + 1e-9).all() and bound[3] < 0.2
    assert share.sum() == pytest.approx(1) and (share >= 0.2 / 12 - 1e-9).all() and (share <= 5 / 12 + 1e-9).all()
    assert np.abs(share @ means - truth @ means).max() < np.abs(means.mean(axis=0) - truth @ means).max()
    units = spark.createDataFrame([("g", 1, 1.0, 10.0), ("g", 2, 1.0, 20.0), ("one", 3, 2.0, 5.0), ("none", 4, 1.0, 1.0), ("none", 5, 3.0, 2.0)], "g string, u int, prior double, x double")
    got = {r.u: (round(r.share, 3), r.status) for r in calibrate.calibrate(units, spark.createDataFrame([("g", 18.0)], "g string, x double"), "g", "u", "prior", ["x"]).collect()}
    assert got[3] == (1.0, "single") and got[4] == (0.25, "prior") and got[2][1] == "calibrated" and got[2][0] > 0.75


def test_checks(spark):
    rows = spark.createDataFrame([("g", 1), ("g", 2), ("g", 2), ("h", 1), ("h", 3)], "g string, n int")
    got = {r.g: (r.is_unique, r.is_whole) for r in quality.unique_and_whole(rows, ["g"], "n").collect()}
    assert got == {"g": (False, True), "h": (True, False)}
    whole = spark.createDataFrame([("g", 5), ("h", 4), ("i", 1)], "g string, n long")
    assert {r.g for r in quality.additive(rows, whole, ["g"], ["n"]).collect()} == {"i"}
    assert quality.check("rows", rows, F.lit(5), F.count("n")).first().ok


def test_csv_contract_and_partitions(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as out:
        out.write('kind,state,year,seat,party,evm,post\nAE, Goa ,2000,1,X,"1,000",5\nAE,Goa,2000,1,Y,7,\n')
    names = {"arena": "kind", "s": "state", "y": "year", "n": "seat", "p": "party", "votes": "evm+post"}
    rows = files.candidates_csv(spark, str(tmp_path / "a.csv.gz"), names)
    assert sorted(tuple(r) for r in rows.collect()) == [("AE", "Goa", 2000, 1, "X", 1005), ("AE", "Goa", 2000, 1, "Y", 7)]
    with pytest.raises(ValueError, match="no column"):
        files.csv(spark, str(tmp_path / "a.csv.gz"), ["missing"])
    files.write_by_state(rows, str(tmp_path / "out"))
    kept = files.read_state(spark, str(tmp_path / "out"), "Goa")
    assert kept.count() == 2 and "PartitionFilters: [isnotnull" in kept._jdf.queryExecution().toString()


def test_refresh_keeps_what_is_there(spark, tmp_path):
    source, kept, state = (str(tmp_path / x) for x in ("in", "kept", "state"))
    spark.createDataFrame([("AE", "S", 2000, 1, "A", 9), ("AE", "S", 2000, 1, "B", 5)], SCHEMA).write.parquet(source)
    refresh(spark, source, kept, state).awaitTermination()
    spark.createDataFrame([("AE", "S", 2000, 1, "B", 99), ("AE", "S", 2001, 1, "B", 7)], SCHEMA).write.mode("append").parquet(source)
    refresh(spark, source, kept, state).awaitTermination()
    got = spark.read.parquet(kept)
    assert sorted((r.y, r.p) for r in got.collect()) == [(2000, "A"), (2001, "B")]
