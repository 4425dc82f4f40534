"""From candidate rows to seats, parties and segments, on literal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hustings.operators import candidates


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_numbers_in_first_seen_order(spark):
    rows = spark.createDataFrame([("S", "b", 5), ("S", "a", 7), ("S", "b", 1), ("S", "c", 5), ("T", "x", 9)], "s string, c string, i int")
    assert rows_of(candidates.first_seen_numbers(rows, ["s"], "c", "i")) == [("S", "a", 3), ("S", "b", 1), ("S", "c", 2), ("T", "x", 1)]


def test_candidates_told_twice_are_one(spark):
    rows = spark.createDataFrame([(1, "Ann", "INC", 5, 2), (1, " ANN ", "inc", 5, 1), (1, "Ann", "INC", 6, 3), (1, "Bo", "X", None, 0), (1, "Cy", "X", 5, 9), (2, "Z", None, None, 0), (2, "z", None, None, 1)], "n int, name string, p string, votes int, i int")
    got = rows_of(candidates.distinct_candidates(rows, ["n"], "name", "p", "votes", "i", most=3))
    assert got == [(1, 1, "Ann", "INC", 6), (1, 2, " ANN ", "inc", 5), (1, 3, "Cy", "X", 5), (2, 1, "Z", None, None)]


def test_missing_shares_are_told_by_valid_votes(spark):
    winners = spark.createDataFrame([(1, 50, 10, None, None), (2, 50, 10, 44.0, None), (3, 0, 0, None, None), (4, 50, 10, None, None), (5, 50, 10, None, 3.0)], "n int, votes int, lead int, share double, margin double")
    known = spark.createDataFrame([(1, 90), (1, 200), (2, 150), (3, 100), (4, 0), (5, 100)], "n int, valid int")
    got = {r.n: (r.share, r.margin) for r in candidates.with_known_votes(winners, known, ["n"]).collect()}
    assert got == {1: (25.0, 5.0), 2: (44.0, 6.67), 3: (None, None), 4: (None, None), 5: (50.0, 3.0)}


def test_parties_by_what_their_seats_belong_to(spark):
    cand = spark.createDataFrame([(1, "a", "A", 6), (1, "a", "B", 4), (1, "b", "A", 3), (1, "b", "B", 7), (1, "c", "A", 99), (1, "d", "C", 0)], "y int, seat string, p string, votes int")
    seats = spark.createDataFrame([(1, "a", "old", "A"), (1, "b", "old", "B"), (1, "d", "new", "C")], "y int, seat string, g string, p string")
    assert rows_of(candidates.parties_by_seats(cand, seats, ["y"], "seat", "g").select("g", "p", "fought", "won", "votes", "share")) == [("new", "C", 1, 1, 0, None), ("old", "A", 2, 1, 9, 45.0), ("old", "B", 2, 1, 11, 55.0)]


def test_segments_of_two_sources(spark):
    direct = spark.createDataFrame([("S", 1, 2019, "A", "B", 3, 10)], "s string, n int, y int, p string, tp string, mg int, sv int")
    cand = spark.createDataFrame([("S", 1, 2019, "Z", 9, 1), ("S", 1, 2024, "B", 9, 1), ("S", 1, 2024, "A", 4, 2), ("S", 1, 2024, "C", 1, 3), ("S", 2, 2024, "B", 5, 1), ("T", 1, 2024, "D", 5, 2)], "s string, n int, y int, p string, votes int, position int")
    segs = candidates.segments(direct, cand, ["s", "n"])
    assert rows_of(segs) == [("S", 1, 2019, "A", "B", 3, 10), ("S", 1, 2024, "B", "A", 5, 14), ("S", 2, 2024, "B", None, None, 5)]
    seats = spark.createDataFrame([("S", 101), ("S", 102), ("S", 1), ("Out", 1)], "s string, j int")
    got = candidates.segment_leads(seats, segs, F.when(F.col("s") == "S", 100).otherwise(0), F.col("s") == "Out")
    assert rows_of(got.select("s", "j", "segment_lead")) == [("Out", 1, None), ("S", 1, None), ("S", 101, "B"), ("S", 102, "B")]


def test_overlay_and_winners_only(spark):
    base, over = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "y int, t double"), spark.createDataFrame([(2, 7.0), (3, 8.0), (4, 9.0), (1, None)], "y int, t double")
    assert rows_of(candidates.overlaid(base, over, ["y"], "t")) == [(1, 5.0), (2, 7.0), (3, 8.0), (4, 9.0)]
    parties = spark.createDataFrame([(1, "A", None), (1, "B", None), (2, "A", None), (2, "B", 3.0)], "y int, p string, v double")
    cand = spark.createDataFrame([(2,), (2,), (9,)], "y int")
    assert rows_of(candidates.winners_only(parties, cand, ["y"])) == [(1, 2, True, False), (2, 2, False, True)]
