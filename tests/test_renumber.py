"""Fill from neighbours and new numbers, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

from hustings.operators import renumber


def plain_fill(values):
    """Seat after seat, as one would by hand."""
    known = dict(values)
    for _ in range(3):
        for n in sorted(known):
            if known[n]:
                continue
            for d in (1, 2, 3, 4):
                low, high = known.get(n - d), known.get(n + d)
                if low and high and low != high:
                    continue
                if low or high:
                    known[n] = low or high
                    break
    return known


def test_fill_is_that_of_a_plain_loop(spark):
    rnd = random.Random(5)
    rows = []
    for state, gap in enumerate((0.1, 0.5, 0.8, 0.95, 0.99)):
        rows += [(state, n, None if rnd.random() < gap else rnd.choice("XY")) for n in range(-3, 200) if rnd.random() > 0.1]
    rows += [(9, n, None) for n in range(20)] + [(10, n, "XY"[n > 4] if n in (0, 9) else None) for n in range(10)]
    got = defaultdict(dict)
    for r in renumber.neighbour_fill(spark.createDataFrame(rows, "s int, n int, v string").repartition(4), ["s"], "n", "v").collect():
        got[r.s][r.n] = r.v
    assert got == {s: plain_fill({n: v for t, n, v in rows if t == s}) for s in {r[0] for r in rows}}
    assert set(got[9].values()) == {None} and got[10][4] == "X"
    assert renumber.neighbour_fill(spark.createDataFrame([], "s int, n int, v string"), ["s"], "n", "v").count() == 0


def probe(rows, official):
    """First come at a number, then official numbers, then try number after number, lowest first."""
    seats = {}
    for n, name, order in sorted(rows, key=lambda x: x[2]):
        seats.setdefault((n, name.upper()), order)
    held, new = {}, {}
    for (n, name), _ in sorted(seats.items(), key=lambda x: (x[1], x[0][1])):
        if n not in held:
            held[n], new[n, name] = name, n
    wanted = defaultdict(set)
    for n, name in official:
        wanted[name.upper()].add(n)
    kept = dict(held)
    for (n, name), _ in sorted(seats.items(), key=lambda x: (x[1], x[0][1])):
        if (n, name) not in new and len(wanted[name]) == 1:
            o = min(wanted[name])
            if kept.get(o, name) == name and held.get(o, name) == name:
                held[o], new[n, name] = name, o
    for (n, name), _ in sorted(seats.items(), key=lambda x: (x[0][0], x[1], x[0][1])):
        if (n, name) not in new:
            at = n
            while at in held:
                at += 1
            held[at], new[n, name] = name, at
    return new


def test_new_numbers_are_those_of_trying_one_after_the_other(spark):
    rnd = random.Random(7)
    rows, official = [], []
    for g in range(6):
        rows += [(g, rnd.choice((1, 2, 3, 5, 8, 8, 8, 9, 40, 1000)) + rnd.randint(0, 3), rnd.choice("abcdefghijklmnopq"), i) for i in range(60)]
        official += [(g, rnd.randint(1, 30), rnd.choice("abcdefghijklmnopqrs")) for _ in range(14)]
    frame, names = spark.createDataFrame(rows, "g int, n long, c string, i int"), spark.createDataFrame(official, "g int, n long, c string")
    found = renumber.renumbered(frame.repartition(3), names, ["g"], "n", "c", "i")
    got = {(r.g, r.n, r.c.upper()): r.new_number for r in found.collect()}
    want = {(g, *k): v for g in range(6) for k, v in probe([r[1:] for r in rows if r[0] == g], [r[1:] for r in official if r[0] == g]).items()}
    assert got == want
    kinds = {(r.g, r.n, r.c): r.how for r in found.collect()}
    assert set(kinds.values()) == {"kept", "official", "next"}
    assert all(got[g, n, c.upper()] == n for (g, n, c), how in kinds.items() if how == "kept")
    assert renumber.with_new_numbers(frame, found, ["g"], "n", "c").where("new_number is null").count() == 0
    assert renumber.renumbered(frame.limit(0), names, ["g"], "n", "c", "i").count() == 0
