"""Fill-in-middle, spelling variants and main text of pages, each against a plain version on awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from hustings.llm import fillmiddle, spelling
from tests.llm.conftest import DOCS, document


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def filled_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form = "spm" if h4 % 100 < 20 else "psm"
    return (doc_id, n, form, len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"), sha(text))


def test_fill_middle_is_a_plain_cut(spark, awkward, nothing):
    odd = [document(i, t) for i, t in enumerate(["<P>", "a <S> b", "<M", "<P<S<", "\n\n a\r\nb", "$1 \\1 \\E", "<", "P>x<", "é<\U0001f600>漢 a1b2"] * 12, 200)]
    long = [document(999, "word and, 12 " * 40000 + "x" * 200000), document(-5, "negative id")]
    rows = awkward.union(spark.createDataFrame(odd + long, DOCS))
    got = Counter(tuple(r) for r in fillmiddle.digests(rows).collect())
    assert got == Counter(filled_middle(r.doc_id, r.text) for r in rows.collect())
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fillmiddle.digests(nothing).count() == 0


def test_fill_middle_with_other_sentinels(spark):
    style = fillmiddle.Format("<$pre\\1>", "<suf.*>", "<mid|>", transformed=100, suffix_first=50)
    rows = fillmiddle.transformed(spark.createDataFrame([document(i, f"one two, three {i}") for i in range(40)], DOCS), style)
    for r in rows.select("*", fillmiddle.restored(rows.output, rows.form, style).alias("again")).collect():
        assert r.again == r.text == r.prefix + r.middle + r.suffix and r.form != "plain"
        parts = [("<$pre\\1>", r.prefix), ("<suf.*>", r.suffix), ("<mid|>", r.middle)]
        assert r.output == "".join(a + b for a, b in (parts if r.form == "psm" else [parts[1], parts[0], parts[2]]))


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, times=10):
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in beside.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= times * counts[w] else None
    rows = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, len(beside[w]), counts[form[w]] if form[w] else None))
    return sorted(rows, key=str)


def test_variants_are_all_near_words(spark):
    rnd = random.Random(3)
    counts = {}
    for base in ("aaaaaaa", "abababab", "misspell", "éèàüößßßß", "q" * 199, "q" * 200, "zw" * 130, "xy" * 300):
        counts[base] = rnd.choice((3, 500, 50000))
        for _ in range(40):
            w, i, c = base, rnd.randrange(len(base)), rnd.choice("abqé")
            w = rnd.choice((w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :], w[:i] + c + w[i:]))
            counts.setdefault(w, rnd.choice((2, 3, 30, 300, 3000)))
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = sorted((tuple(r) for r in spelling.variants(frame).collect()), key=str)
    want = plain_variants(counts)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 5 for r in want)
    assert spelling.variants(frame.limit(0)).count() == 0


def test_long_words_take_no_square_of_their_length(spark):
    word = "ab" * 60000
    frame = spark.createDataFrame([(word, 20), (word + "c", 2), (word[1:], 200)], "word string, n long")
    got = {len(r.word): (r.n_near, r.form_n, len(r.root)) for r in spelling.variants(frame).collect()}
    assert got == {120000: (2, 200, 119999), 120001: (1, 20, 119999), 119999: (1, None, 119999)}


def test_words_of_documents_are_counted_whole(spark, awkward, nothing):
    rnd = random.Random(4)
    text = " ".join(rnd.choice(("Spelling", "SPELLING,", "variants7group", "ÀÉaccent×", "ÉÉlower", "misspelt")) for _ in range(3000))
    rows = awkward.union(spark.createDataFrame([document(i, text[i * 7 :]) for i in range(300, 360)], DOCS))
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.LOWER)
    for r in rows.collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", (r.text or "").translate(lower)):
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    got = sorted((tuple(r) for r in spelling.spelling_variants(rows).collect()), key=str)
    assert got == plain_variants(counts) and any(r[1] for r in got)
    assert spelling.spelling_variants(nothing).count() == 0


@pytest.mark.parametrize("sql", [fillmiddle.digests_sql, spelling.spelling_variants_sql])
def test_sql_tells_the_same(spark, awkward, tmp_path, sql):
    from tests.test_oracle import normal

    awkward.write.parquet(str(tmp_path / "documents.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    found = connection.execute(sql())
    columns = [c[0] for c in found.description]
    rows = {fillmiddle.digests_sql: fillmiddle.digests, spelling.spelling_variants_sql: spelling.spelling_variants}[sql](awkward)
    assert sorted(rows.columns) == sorted(columns)
    assert normal(rows.collect(), rows.columns) == normal(found.fetchall(), columns)
