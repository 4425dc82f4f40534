"""Operators on literal rows with the edge cases: ties, single candidates, renumbered seats, boundary breaks, nulls."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from hustings.functions import canon
from hustings.operators import board, merge, project, resolve, rollup, signals

CAND = "arena string, s string, y int, n int, p string, votes long"
SEATS = "arena string, s string, y int, j int, n int, p string, q string, v double, m double, t double, a string, r string"


def test_tie_goes_to_the_first_party_and_single_candidates_have_no_margin(spark):
    rows = [("AE", "S", 2000, 1, "B", 10), ("AE", "S", 2000, 1, "A", 10), ("AE", "S", 2000, 2, "A", 5), ("AE", "S", 2000, 3, "A", 0)]
    got = {r.n: r for r in resolve.contests(spark.createDataFrame(rows, CAND)).collect()}
    assert (got[1].p, got[1].q, got[1].m) == ("A", "B", 0.0)
    assert got[2].q is None and got[2].m is None and got[2].v == 100.0
    assert got[3].v is None and got[3].m is None


def test_renumbered_and_broken_states(spark):
    rows = spark.createDataFrame([("AE", "NATION_3", 1997, 1), ("AE", "NATION_3", 1998, 1), ("GE", "NATION_3", 1998, 1)], "arena string, s string, y int, n int")
    assert sorted(r[0] for r in rows.select(canon.continuity(*[F.col(c) for c in ("arena", "s", "y", "n")])).collect()) == [1, 1, 120]
    seats = [("AE", "NATION_5", y, 1, 1, p, "Q", 50.0, 5.0, 60.0, "X", "GEN") for y, p in ((1996, "A"), (1997, "A"), (1998, "A"), (1999, "B"))]
    got = {r.y: r.status for r in resolve.with_previous(spark.createDataFrame(seats, SEATS)).collect()}
    assert got == {1996: "no-previous", 1997: "held", 1998: "not-comparable", 1999: "flipped"}


def test_streak_stops_at_a_break(spark):
    seats = [("AE", "NATION_5", y, 1, 1, "A", "Q", 50.0, 5.0, 60.0, "X", "GEN") for y in (1995, 1996, 1997, 1998, 1999, 2000)]
    assert [(r.wins, r.since) for r in resolve.streaks(spark.createDataFrame(seats, SEATS)).collect()] == [(3, 1998)]


def test_seat_curve_is_monotone_and_net_changes_cancel(spark):
    seats = spark.createDataFrame([("AE", "S", y, j, j, p, q, 45.0, float(j), 60.0, "X", "GEN") for y, shift in ((1999, 0), (2000, 1)) for j in range(1, 9) for p, q in [("AB"[(j + shift) % 3 % 2], "BA"[(j + shift) % 3 % 2])]], SEATS)
    curve = project.seat_curve(seats.where("y = 2000")).orderBy("p", "pp").collect()
    for a, b in zip(curve, curve[1:], strict=False):
        assert a.p != b.p or a.seats <= b.seats
    assert sum(r.net for r in rollup.net_change(resolve.changes(seats, 2000), "arena").collect()) == 0


def test_rounding_keeps_totals(spark):
    rows = spark.createDataFrame([("g", "a", 1.4, 4), ("g", "b", 1.4, 4), ("g", "c", 1.2, 4), ("h", "a", 0.5, 1), ("h", "b", 0.5, 1)], "g string, k string, x double, total long")
    got = {(r.g, r.k): r.rounded for r in merge.rounded_to_total(rows, "g", "k", "x", "total").collect()}
    assert got == {("g", "a"): 2, ("g", "b"): 1, ("g", "c"): 1, ("h", "a"): 1, ("h", "b"): 0}


def test_apportioned_shares_add_up(spark):
    wards = spark.createDataFrame([("S", "t", n, w, split, 100.0) for n, w, split in ((1, 0.5, True), (2, 0.5, True), (1, 1.0, False), (2, 1.0, False))], "s string, town string, n int, weight double, split boolean, pop double")
    electors = spark.createDataFrame([("S", 1, 70.0), ("S", 2, 90.0)], "s string, n int, e double")
    got = {r.n: r.share for r in merge.apportioned(wards, electors).collect()}
    assert abs(sum(got.values()) - 1) < 1e-12 and got[2] > got[1]


def test_weighted_rates_skip_nulls(spark):
    rows = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, None), ("a", 1.0, 20.0)], "k string, w double, x double")
    assert merge.weighted_rates(rows, ["k"], "w", ["x"]).first().x == 15.0


def test_numbers_and_names(spark):
    rows = spark.createDataFrame([("1,234", "  INC [2] ", "Foo and Bar (SC)"), ("-", "NOTA", "x"), (None, None, None)], "a string, p string, c string")
    got = rows.select(canon.tolerant_number(F.col("a")).alias("a"), canon.party_name(F.col("p")).alias("p"), canon.is_junk_party(F.col("p")).alias("junk"), canon.seat_key(F.col("c")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(1234, "INC", False, "FOOBAR"), (None, "NOTA", True, "X"), (None, None, True, None)]


def test_scorecard_of_a_party_that_never_won(spark):
    seats = spark.createDataFrame([("AE", "S", 2000, 1, 1, "A", "B", 45.0, 2.0, 60.0, "X", "GEN"), ("AE", "S", 2000, 2, 2, "A", None, 100.0, None, 60.0, "X", "SC")], SEATS)
    got = {r.p: r for r in signals.scorecards(seats).collect()}
    assert (got["B"].won, got["B"].second, got["B"].strike) == (0, 1, 0.0) and got["A"].won == 2


def test_residuals_are_divided_between_the_towns_of_a_seat(spark):
    rows = [("S", "t", 1, 10.0, True, 0.0), ("S", "t", 2, 90.0, True, 0.0), ("S", "u", 3, 1.0, False, 100.0)]
    wards = spark.createDataFrame(rows, "s string, town string, n int, weight double, split boolean, pop double")
    electors = spark.createDataFrame([("S", 1, 100.0), ("S", 2, 100.0), ("S", 3, 50.0)], "s string, n int, e double")
    assert {r.n: r.share for r in merge.apportioned(wards, electors).collect()} == {1: 0.5, 2: 0.5}
    assert {r.n: r.share for r in merge.apportioned(wards, electors.limit(0)).collect()} == {1: 0.1, 2: 0.9}


def test_lone_codes_have_weight(spark):
    rows = spark.createDataFrame([(1, "358"), (2, "358:0.6; 346:0.2;"), (3, "x;y:1"), (4, "7;8:3;9:z"), (5, None)], "k int, pins string")
    got = sorted(tuple(r) for r in board.code_weights(rows, "k", "pins").collect())
    assert [g[:2] for g in got] == [(1, 358), (2, 346), (2, 358), (4, 7), (4, 8)]
    assert [round(g[2], 9) for g in got] == [1.0, 0.25, 0.75, 0.25, 0.75]


def test_the_leader_of_today_is_asked_what_it_held(spark):
    rows = [("AE", "S", "A", "A", "held"), ("AE", "S", "A", "B", "flipped"), ("AE", "S", "B", "A", "flipped"), ("AE", "S", "A", "B", "not-comparable"), ("AE", "S", "C", "B", "flipped"), ("AE", "T", "X", None, "no-previous")]
    got = [tuple(r) for r in board.leader_retention(spark.createDataFrame(rows, "arena string, s string, p string, prev_p string, status string")).collect()]
    assert got == [("AE", "S", "A", 3, 2, 1, 0, 50.0)]


def test_lookups_trust_names_before_numbers_but_not_against_a_nameless_entry(spark):
    seats = spark.createDataFrame([("k", 1, "Kalol"), ("k", 2, "Daman and Diu (ST)"), ("k", 3, "Jeypore"), ("k", 4, "Kalol"), ("k", 9, None)], "g string, n int, c string")
    book = spark.createDataFrame([("k", 1, None, 5), ("k", 2, "DADRA", 6), ("k", 7, "DAMAN", 7), ("k", 3, "Jayapur", 8), ("k", 4, "X", 9), ("k", 8, "kalol", 10), ("k", 10, "KALOL (SC)", 11), ("j", 9, "y", 1)], "g string, n int, c string, e int")
    got = {r.n: (r.e, r.by) for r in board.looked_up(seats, book, ["g"], "n", "c", "e").collect()}
    assert got == {1: (5, "both"), 2: (7, "name"), 3: (8, "number"), 4: (9, "number"), 9: (None, None)}


def test_parties_by_lines(spark):
    rows = spark.createDataFrame([("AE", f"P{i:02}", 20 - i % 3) for i in range(12)], "arena string, p string, wins int")
    got = [(r.p, r.line, r.parties) for r in board.first_lines(rows, ["arena"], "wins", 8).orderBy("line").collect()]
    assert len(got) == 8 and got[0] == ("P00", 1, 12) and got[4][0] == "P01"


def test_zeros_take_one_from_the_largest(spark):
    rnd = random.Random(8)
    groups = {g: [rnd.choice((0, 0, 0, 1, 2, 5, 9, 9, 40)) for _ in range(rnd.randint(1, 14))] for g in range(120)}
    groups |= {200: [0, 0, 2], 201: [0, 0, 3], 202: [5, 5, 5, 0, 0, 0, 0], 203: [0], 204: [1, 1]}
    rows = spark.createDataFrame([(g, i, v) for g, values in groups.items() for i, v in enumerate(values)], "g int, i int, v long")
    got = {}
    for r in merge.without_zeros(rows, "g", "i", "v").collect():
        got.setdefault(r.g, {})[r.i] = r.v
    for g, values in groups.items():
        want = list(values)
        if sum(want) >= len(want):
            for i in [i for i, v in enumerate(want) if v == 0]:
                want[want.index(max(want))] -= 1
                want[i] = 1
        assert [got[g][i] for i in range(len(want))] == want, (g, values)
    assert merge.without_zeros(rows.limit(0), "g", "i", "v").count() == 0
