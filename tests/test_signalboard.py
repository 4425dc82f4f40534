"""Signals of a house on literal seats, at and beside their limits."""

from __future__ import annotations

from hustings.operators import signalboard

SEATS = "arena string, scope string, s string, n int, p string, q string, v double, m double, r string, y int"


def seats(spark, rows):
    return spark.createDataFrame([("AE", "S", "S", n, p, q, v, m, r, 3) for n, (p, q, v, m, r) in enumerate(rows, 1)], SEATS)


def told(df):
    return {r.signal: (r.severity, r.party, round(r.score, 3)) for r in df.collect()}


def test_margin_of_control(spark):
    majority = seats(spark, [("A", "B", 45.0, float(n), None) for n in range(1, 20)] + [("B", "A", 45.0, 9.0, None)] * 11)
    assert told(signalboard.margin_of_control(majority)) == {"tipping": ("critical", "A", 110.0)}
    assert [(r.nth, r.m) for r in signalboard.turning_seats(majority).orderBy("nth").collect()] == [(i, float(i)) for i in range(1, 8)]
    large = seats(spark, [("A", "B", 45.0, 3.0, None)] * 25 + [("B", "A", 45.0, 9.0, None)] * 5)
    assert told(signalboard.margin_of_control(large)) == {"tipping": ("note", "A", 40.0)}
    hung = seats(spark, [("A", "B", 45.0, 3.0, None)] * 12 + [("B", "A", 45.0, float(n), None) for n in range(9)] + [("C", "A", 45.0, None, None)] * 9)
    assert told(signalboard.margin_of_control(hung)) == {"tipping": ("note", "A", 50.0)}
    nearest = signalboard.turning_seats(hung).orderBy("nth").collect()
    assert [(r.p, r.m) for r in nearest] == [("B", float(n)) for n in range(8)]
    assert signalboard.margin_of_control(seats(spark, [("A", "B", 45.0, 3.0, None)] * 29)).count() == 0


def test_thin_margins(spark):
    rows = [("A", "B", 45.0, 4.9, None)] * 3 + [("A", "B", 45.0, 5.0, None)] * 7 + [("B", "A", 45.0, 1.0, None)] * 4
    assert told(signalboard.thin_margins(seats(spark, rows))) == {"thinbook": ("critical", "A", 130.0)}
    assert told(signalboard.thin_margins(seats(spark, rows + [("A", "B", 45.0, 9.0, None)] * 5))) == {"thinbook": ("watch", "A", 80.0)}
    assert told(signalboard.thin_margins(seats(spark, rows[:9]))) == {}
    assert told(signalboard.thin_margins(seats(spark, rows + [("A", "B", 45.0, 9.0, None)] * 20))) == {}


def test_split_fields_and_softening(spark):
    rows = [("A", "B", 39.9, 9.0, None)] * 3 + [("B", "A", 30.0, 9.0, None)] + [("B", "A", 40.0, 9.0, None)] * 26
    assert told(signalboard.split_fields(seats(spark, rows))) == {"divided": ("watch", "A", 73.0)}
    assert told(signalboard.split_fields(seats(spark, rows[1:] + [("B", "A", 40.0, 9.0, None)]))) == {}
    history = [("AE", "S", "S", n, "A", "B", 45.0, m, None, y) for n in range(1, 5) for y, m in ((1, 9.0), (2, 20.0), (3, 15.0 if n == 4 else 14.9))]
    assert told(signalboard.softening(spark.createDataFrame(history, SEATS))) == {"eroding": ("watch", "A", 66.0)}
    assert told(signalboard.softening(spark.createDataFrame(history[3:], SEATS))) == {}


def test_votes_and_seats(spark):
    house = seats(spark, [("A", "B", 45.0, 9.0, "SC")] * 8 + [("A", "B", 45.0, 9.0, "GEN")] * 6 + [("B", "A", 45.0, 9.0, None)] * 6)
    votes = spark.createDataFrame([("AE", "S", y, p, v, w) for y, a in ((1, 30.0), (2, 31.5), (3, 33.0)) for p, v, w in (("A", a, 14), ("B", 60.0 - a, 6), ("C", 1.9, 0), ("D", None, 0))], "arena string, scope string, y int, p string, v double, wo long")
    # A has 70 % of seats for 33 % of votes, B 30 for 27.
    assert told(signalboard.vote_efficiency(house, votes)) == {"efficiency": ("watch", "B", 94.0)}
    assert told(signalboard.momentum(votes)) == {"momentum": ("note", "A", 37.5)}
    assert told(signalboard.momentum(votes.where("y < 3"))) == {}
    assert told(signalboard.social_coalition(house)) == {"reservation": ("note", "A", 42.5)}
    board = signalboard.signal_board(house, house, votes).orderBy("place").collect()
    assert [(r.signal, r.place) for r in board] == [("efficiency", 1), ("reservation", 2), ("momentum", 3)]
    assert signalboard.signal_board(house.limit(0), house.limit(0), votes.limit(0)).count() == 0
