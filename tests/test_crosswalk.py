"""Likeness by common blocks against the standard library, and the tiers of the matcher against plain loops."""

from __future__ import annotations

import difflib
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hustings.functions.sequences import block_ratio, block_ratios, like_pairs
from hustings.operators import crosswalk, pieces


def plain_ratio(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_block_ratios_are_those_of_the_standard_library():
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdeé\U0001f600") for _ in range(n))
    pairs = [(word(rnd.randint(0, 18)), word(rnd.randint(0, 18))) for _ in range(10_000)] + [("", ""), ("", "a"), ("ab", ""), ("a" * 300, "a" * 250 + "b")]
    pairs += [(a, "".join(c for c in a if rnd.random() > 0.2)) for a, _ in pairs[:2000]]
    got = block_ratios([a for a, _ in pairs], [b for _, b in pairs])
    assert np.array_equal(got, np.array([plain_ratio(a, b) for a, b in pairs]))


def test_ratio_of_columns(spark):
    rows = spark.createDataFrame([("abc", "abd"), (None, "x"), ("x", None), ("", "")], "a string, b string")
    assert [r[0] for r in rows.select(block_ratio("a", "b")).collect()] == [2 * 2 / 6, None, None, 1.0]


def keys(name):
    s = re.sub(r"\(\s*(S\.?\s*C|S\.?\s*T|B\.?\s*L)\s*\.?\)", " ", (name or "").upper().replace("&", " AND "))
    s = re.sub(r"(\s|-\s*)(SC|ST)\s*$", " ", s)
    tokens = [crosswalk.DIRECTIONS.get(t, t) for t in re.sub("[^A-Z0-9]+", " ", re.sub("(ASSEMBLY )?CONSTITUENCY", " ", s)).split()]
    tokens = [t for t in tokens if t]
    flat = sound = "".join(tokens)
    for a, b in (*crosswalk.RENAMED, *crosswalk.SOUNDS):
        sound = sound.replace(a, b)
    sound = re.sub(r"(.)\1+", r"\1", sound)
    return flat, sound, "".join(sorted(tokens)), sound[:1] + re.sub("[AEIOU]", "", sound[1:])


def like(a, b):
    x, y = keys(a), keys(b)
    return round(max(plain_ratio(x[i], y[i]) for i in range(3)), 3) if x[0] and y[0] else 0.0


def plain_crosswalk(left, right):
    """One block; left: (code, name, parent, number), right: (seat, names, parent, numbers). Rows of (code, seat, method, similarity)."""
    sim = {(c, s): max(like(n, m) for m in names) for c, n, _, _ in left for s, names, _, _ in right}
    same = lambda i: {(c, s): any(keys(n)[i] == keys(m)[i] != "" for m in names) for c, n, _, _ in left for s, names, _, _ in right}
    flat, sound, skeleton = same(0), same(1), same(3)
    parents = {(c, s): p is not None and q is not None and like(p, q) >= 0.8 for c, _, p, _ in left for s, _, q, _ in right}
    out = {}
    free = lambda: [(c, s) for c, *_ in left for s, *_ in right if c not in out and s not in {x[0] for x in out.values()}]

    def take(pairs, method, sure=False):
        for c, s in sorted(pairs, key=lambda x: (1 if sure else -sim[x], x[0])):
            if (c, s) in free():
                out[c] = (s, method, 1.0 if sure else sim[c, s])

    users = Counter(n for *_, n in left if n is not None)
    claims = []
    for c, _, _, n in left:
        best = max(((sim[c, s], -s) for s, *_ in right), default=(0, 0))
        ok = []
        for s, _, _, numbers in right:
            v = sim[c, s]
            if n is not None and n in numbers and (v >= 0.6 or sound[c, s] or parents[c, s] and v >= 0.45) and not (best[0] >= 0.85 and -best[1] != s and v < best[0] - 0.05) and not (users[n] > 1 and v < 0.85):
                ok.append((-v, s))
        if ok:
            claims.append((c, min(ok)[1]))
    take(claims, "eci_code")
    alone = lambda pairs: [x for x in pairs if sum(y[0] == x[0] for y in pairs) == 1 and sum(y[1] == x[1] for y in pairs) == 1]
    take(alone([x for x in free() if flat[x]]), "exact_name", True)
    same_parent = [x for x in free() if flat[x] and parents[x]]
    take([x for x in same_parent if sum(y[0] == x[0] for y in same_parent) == 1], "exact_name", True)
    take(alone([x for x in free() if sound[x]]), "fuzzy")
    for nth in range(1, 6):
        score = {x: round(sim[x] + 0.12 * parents[x] + 0.08 * skeleton[x], 6) for x in free() if sim[x] >= 0.72 or sim[x] >= 0.55 and (parents[x] or skeleton[x])}
        found = [(c, s) for c, s in score if (c, s) == min((x for x in score if x[0] == c), key=lambda x: (-score[x], x[1])) and (c, s) == min((x for x in score if x[1] == s), key=lambda x: (-score[x], x[0]))]
        if not found:
            break
        for c, s in found:
            out[c] = (s, f"fuzzy-{nth}", sim[c, s])
    return sorted((c, *v) for c, v in out.items())


LEFT, RIGHT = "block int, code long, name string, parent string, number long", "block int, seat long, names array<string>, parent string, numbers array<long>"


def test_tiers_match_as_plain_loops_do(spark):
    rnd = random.Random(6)
    say = lambda n: "".join(rnd.choice("KTSRMNDL") + rnd.choice("AIUE") for _ in range(n))
    left, right = [], []
    for block in range(4):
        names = [say(rnd.randint(1, 4)) for _ in range(28)] + ["Kalol", "Kalol", "Bengaluru North", "St. Thomas (SC)", "", "A"]
        for s, n in enumerate(names):
            right.append((block, s, [n] + ([say(3)] if s % 5 == 0 else []), f"P{'abcd'[s % 4] * 4}", [s] + ([s + 100] if s % 7 == 0 else [])))
        for c, n in enumerate(names):
            v = list(n)
            for _ in range(rnd.randint(0, 3)):
                if v:
                    i = rnd.randrange(len(v))
                    v[i : i + rnd.randint(0, 1)] = [rnd.choice(["", "H", "A", "K", "I"])]
            name = {"Bengaluru North": "Uttar-Bangalore", "Kalol": "KALOL", "St. Thomas (SC)": "SAINT THOMAS - SC"}.get(n, "".join(v))
            left.append((block, c, None if c == 5 else name, f"P{'abcd'[c % 4] * 4}" if c % 3 else None, rnd.choice([None, None, c, c + 1, 3, 100])))
    got = crosswalk.crosswalk(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT)).collect()
    methods = Counter()
    for block in range(4):
        want = plain_crosswalk([x[1:] for x in left if x[0] == block], [x[1:] for x in right if x[0] == block])
        assert sorted((r.code, r.seat, r.method, r.similarity) for r in got if r.block == block) == want
        methods.update(x[2] for x in want)
    assert methods["eci_code"] and methods["exact_name"] and methods["fuzzy"] and methods["fuzzy-1"] and methods["fuzzy-2"], methods


def test_a_hand_made_pair_comes_first_and_empty_lists_match_nothing(spark):
    left = spark.createDataFrame([(1, 1, "Abc", None, None), (1, 2, "Abd", None, None)], LEFT)
    right = spark.createDataFrame([(1, 1, ["Abc"], None, [1]), (1, 2, ["Abx"], None, [2])], RIGHT)
    hand = spark.createDataFrame([(1, 2, 1), (9, 9, 9)], "block int, code long, seat long")
    got = {r.code: (r.seat, r.method) for r in crosswalk.crosswalk(left, right, hand).collect()}
    assert got[2] == (1, "manual") and got.get(1, (2, ""))[0] == 2
    assert crosswalk.crosswalk(left.limit(0), right).count() == 0 and crosswalk.crosswalk(left, right.limit(0)).count() == 0


def test_no_like_pair_is_missed(spark):
    rnd = random.Random(9)
    names = sorted({"".join(rnd.choice("ABDN") for _ in range(rnd.randint(2, 9))) for _ in range(120)})
    left = spark.createDataFrame([(1, i, n, None, None) for i, n in enumerate(names)], LEFT)
    right = spark.createDataFrame([(1, i, [n], None, []) for i, n in enumerate(names)], RIGHT)
    got = {(r.code, r.seat): r.similarity for r in crosswalk.scored_pairs(left, right).where(F.col("similarity") >= 0.55).collect()}
    assert got == {(i, j): like(a, b) for i, a in enumerate(names) for j, b in enumerate(names) if like(a, b) >= 0.55}


def test_many_pairs_at_once_are_fast():
    rnd = random.Random(2)
    a, b = (["".join(rnd.choice("abcdefghij") for _ in range(12)) for _ in range(20_000)] for _ in range(2))
    began = time.time()
    block_ratios(a, b)
    assert time.time() - began < 60


def test_a_shifted_list_is_told_from_a_misspelt_one(spark):
    names = ["Kalol", "Daman", "Jeypore", "Badwani", "Thrissur", "Ludhiana", "Panaji", "Sirohi"]
    spelled = ["Kalol", "Damann", "Jaypore", "Barwani", "Trissur", "Ludhyana", "Panjim", "Sirohee"]
    rows = [(1, n, x) for n, x in enumerate(spelled)] + [(2, n + 1, x) for n, x in enumerate(spelled)] + [(3, 0, "Nowhere"), (3, 77, "Kalol")]
    left = spark.createDataFrame(rows, "block int, code long, name string")
    right = spark.createDataFrame([(b, n, [x]) for b in (1, 2, 3) for n, x in enumerate(names)], "block int, seat long, names array<string>")
    told = crosswalk.closer_names(left, right)
    got = {(r.block, r.code): (r.seat, r.verdict) for r in told.collect()}
    # Of the shifted block all have a closer name one number before; one that stands at no number on the right is left out.
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, n): (n - 1, "closer") for n in range(1, 8)}
    assert {v[1] for k, v in got.items() if k[0] == 1} == {"spelling"} and (1, 0) not in got and got[3, 0] == (0, "spelling") and (3, 77) not in got
    assert [tuple(r) for r in crosswalk.row_shifts(told).collect()] == [(2, -1, 7, 7, True)]
    assert crosswalk.row_shifts(crosswalk.closer_names(left.limit(0), right)).count() == 0


def test_pairs_of_two_lists_are_those_of_the_standard_library():
    rnd = random.Random(8)
    word = lambda low, high: "".join(rnd.choice("abcé\U0001f600") for _ in range(rnd.randint(low, high)))
    for low, high in ((0, 8), (5, 20), (20, 40), (50, 90)):
        sides = [[word(low, high) for _ in range(40)] + ["", "ab" * 60] for _ in range(2)]
        sides[1] += ["".join(c for c in x if rnd.random() > 0.1) for x in sides[0]]
        others = [[x[: len(x) // 2] if rnd.random() < 0.5 else x for x in side] for side in sides]
        i, j, ratio = like_pairs([sides[0], others[0]], [sides[1], others[1]], 0.6)
        best = {(i, j): max(plain_ratio(a, b), plain_ratio(others[0][i], others[1][j])) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1])}
        assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), ratio.tolist(), strict=True)) == {k: v for k, v in best.items() if v >= 0.6}
    assert all(len(x) == 0 for x in like_pairs([[]], [["a"]], 0.5)) and all(len(x) == 0 for x in like_pairs([["a"]], [[]], 0.5))


def test_every_piece_meets_every_other(spark):
    left = spark.createDataFrame([(k % 3 if k % 10 else None, k) for k in range(40)], "k int, a long")
    right = spark.createDataFrame([(k % 4, f"x{k}") for k in range(50)], "k long, b string")

    def work(one, other):
        i, j = np.divmod(np.arange(one.num_rows * other.num_rows), max(1, other.num_rows))
        return one.select(["a"]).take(i).append_column("b", other["b"].take(j))

    schema = left.select("a", F.lit("").alias("b")).schema
    got = sorted((r.a, r.b) for r in pieces.all_met(left, right, ["k"], ("a", "b"), work, schema, (4, 6)).collect())
    assert got == sorted((r.a, r.b) for r in left.join(right, "k").collect())


def test_like_names_of_a_large_block_are_all_found_and_soon(spark):
    rnd = random.Random(5)
    say = lambda: "".join(rnd.choice("KANIRUTOSEMALUDI") for _ in range(9))
    names = [say() for _ in range(3000)] + ["HHHH"]  # what sounds like nothing has no two characters in common with H
    listed = [names[k * 3][:8] for k in range(150)] + ["H"]
    left = spark.createDataFrame([(1, i, n) for i, n in enumerate(listed)], "block int, code long, name string")
    right = spark.createDataFrame([(1, i, [n, say()]) for i, n in enumerate(names)], "block int, seat long, names array<string>")
    began = time.time()
    got = {(r.code, r.seat): r.similarity for r in crosswalk.like_seats(left, right).collect()}
    assert time.time() - began < 45
    assert got[150, 3000] == 1.0 and all(got[k, k * 3] >= 0.94 for k in range(150))
    theirs = {r.seat: r.names for r in right.collect()}
    want = {(c, s): v for c in (0, 7, 149) for s, both in theirs.items() if (v := max(like(listed[c], n) for n in both)) >= 0.55}
    assert {k: v for k, v in got.items() if k[0] in (0, 7, 149)} == want


def large_block(spark, shift):
    """A list of 200 seats of a block that has 2000, with numbers and spellings that differ by rule; both lists."""
    rnd = random.Random(11)
    names = ["".join(rnd.choice("KANIRUTOSEMALUDI") for _ in range(9)) for _ in range(2000)]
    left = spark.createDataFrame([(1, n + shift, names[n][:8], None, n + shift if n % 2 else None) for n in range(0, 1000, 5)], LEFT)
    return left, spark.createDataFrame([(1, n, [x], None, [n]) for n, x in enumerate(names)], RIGHT), names


def test_closer_names_of_a_large_block_are_told_soon(spark):
    left, right, names = large_block(spark, 2)
    began = time.time()
    got = {r.code: (r.seat, r.same, r.best, r.verdict) for r in crosswalk.closer_names(left, right).collect()}
    assert time.time() - began < 45
    for code in (2, 52, 997):
        best = max((like(names[code - 2][:8], n), -s) for s, n in enumerate(names))
        assert got[code] == (-best[1], like(names[code - 2][:8], names[code]), best[0], "closer")
    assert len(got) == 200


def test_shifts_of_a_large_block_are_told_soon(spark):
    left, right, _ = large_block(spark, 3)
    began = time.time()
    got = [tuple(r) for r in crosswalk.row_shifts(crosswalk.closer_names(left, right)).collect()]
    assert time.time() - began < 45 and got == [(1, -3, 200, 200, True)]


def test_the_crosswalk_of_a_large_block_comes_soon(spark):
    left, right, names = large_block(spark, 0)
    began = time.time()
    got = {r.code: (r.seat, r.method) for r in crosswalk.crosswalk(left, right).collect()}
    assert time.time() - began < 60
    by_name = lambda n: "fuzzy" if keys(names[n][:8])[1] == keys(names[n])[1] else "fuzzy-1"
    assert got == {n: (n, "eci_code" if n % 2 else by_name(n)) for n in range(0, 1000, 5)}
