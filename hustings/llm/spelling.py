"""Spelling variant grouping: permuterm rotations.

A word with a terminator is turned so that each of its places comes to the end once. Two words that differ in one
character agree, turned so that it comes last, in all before it; and of a word with one character more, the turn without
that last character is a whole turn of the other word. So every turn is listed under itself, with nothing after it, and
under its prefix without the last character, with that character after it. All these are sorted by range; what stands
under one prefix is a group, whose members are each other's neighbours. Members of a group are distinct characters at one
place, so a group is never larger than the alphabet (90 letters and the end), whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import discard, sizes_bounded, text_or_empty, written

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as its variant.
TIMES_AS_OFTEN = 10
#: Of so many occurrences of a run in a document one is misspelt, to have variants in made-up texts.
MISSPELT_ONE_IN = 31
#: Prefixes up to this length stand for themselves; of longer ones, whose turns would take the square of their length, a
#: 127-bit rolling hash stands for them.
PLAIN_PREFIX = 200
MODULUS, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
TERMINATOR = "\x00"
WORDS_A_PART = 40_000
BATCH_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def misspelt(doc_id: Column, run: Column) -> Column:
    """The run, without one of its code points where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % MISSPELT_ONE_IN == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def occurrences(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """word, n: how often every word of so many code points occurs in whole texts. Shorter runs have no such word, so they aren't taken."""
    runs = F.regexp_extract_all(F.translate(text_or_empty(), UPPER, LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    each = docs.select("doc_id", F.explode(runs).alias("run"))
    said = each.select(misspelt(F.col("doc_id"), F.col("run")).alias("word")).where(F.char_length("word") >= least_length)
    return said.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def long_turns(word: str) -> Iterator[tuple[str, int, bool]]:
    """As turns(), where prefixes are longer than PLAIN_PREFIX, in time and space that grow with the word alone."""
    size = len(word)
    codes = [ord(c) for c in word]
    power = [1] * (size + 2)
    for i in range(size + 1):
        power[i + 1] = power[i] * BASE % MODULUS
    front, back = [0] * (size + 1), [0] * (size + 1)  # hashes of word[:i] and word[i:]; the terminator counts 1
    for i, c in enumerate(codes):
        front[i + 1] = (front[i] * BASE + c + 2) % MODULUS
    for i in range(size - 1, -1, -1):
        back[i] = ((codes[i] + 2) * power[size - 1 - i] + back[i + 1]) % MODULUS
    told = lambda tail, i: f"{TERMINATOR}{((back[tail] * BASE + 1) * power[i] + front[i]) % MODULUS:032x}"
    if size + 1 > PLAIN_PREFIX:
        for i in range(size + 1):
            yield told(i, i), 0, False
    if size > PLAIN_PREFIX:
        for i, c in enumerate(codes):
            yield told(i + 1, i), c, codes[i + 1 : i + 2] == [c]


def turns(word: str) -> Iterator[tuple[str, int, bool]]:
    """(prefix, code point after it or 0, whether the same character follows in the word) of every turn."""
    size = len(word)
    if size + 1 <= PLAIN_PREFIX:
        for i in range(size + 1):
            yield f"{word[i:]}{TERMINATOR}{word[:i]}", 0, False
    if size <= PLAIN_PREFIX:
        for i, c in enumerate(word):
            yield f"{word[i + 1 :]}{TERMINATOR}{word[:i]}", ord(c), word[i + 1 : i + 2] == c
    if size + 1 > PLAIN_PREFIX:
        yield from long_turns(word)


def all_turns(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, word, n) to (prefix, after, again, id, n), in batches of bounded size."""
    kinds = (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.int64())
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*held, strict=True), kinds, strict=True)]
        held.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["prefix", "after", "again", "id", "n"])

    for rows in batches:
        for i, word, n in zip(*(c.to_pylist() for c in rows.columns), strict=True):
            for turn in turns(word):
                held.append((*turn, i, n))
                if len(held) >= BATCH_ROWS:
                    yield batch()
    if held:
        yield batch()


def neighbours(words: DataFrame, parts: int) -> DataFrame:
    """id, n_near and best (n, and the id's negative) of every word (id, word, n) that has near words; ids follow the words' order."""
    listed = words.mapInArrow(all_turns, "prefix string, after int, again boolean, id long, n long")
    members = F.sort_array(F.collect_list(F.struct("after", "again", "n", "id"))).alias("members")
    groups = listed.repartitionByRange(parts, "prefix").groupBy("prefix").agg(members).where(F.size("members") > 1).select("members")
    # Of a run of equal characters only the last one's turn may lose it to a shorter word, so a pair is met once.
    near = lambda x, y: (x["id"] != y["id"]) & ((x["after"] > 0) & (y["after"] > 0) | ~x["again"] & ~y["again"])
    others = lambda x: F.filter("members", lambda y: near(x, y))
    found = F.transform("members", lambda x: F.struct(x["id"].alias("id"), F.transform(others(x), lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("minus"))).alias("near")))
    each = groups.select(F.explode(found).alias("x")).select("x.id", F.size("x.near").cast("long").alias("n_near"), F.array_max("x.near").alias("best")).where("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def rooted(links: DataFrame) -> DataFrame:
    """id, root of every link (id, form), by doubling: a form is ten times as frequent, so no chain is long."""
    done = written(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        step = done.join(done.select(F.col("id").alias("root"), F.col("root").alias("further")), "root", "left")
        further = written(step.select("id", F.coalesce("further", "root").alias("root"), F.isnotnull("further").alias("moved")), "roots")
        moved = further.where("moved").limit(1).count()
        discard(done)
        done = further.drop("moved")
        if not moved:
            return done


def variants(counts: DataFrame, times: int = TIMES_AS_OFTEN) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of counts (word, n; words distinct).

    Near words differ by one inserted, deleted or replaced code point. form is the near word of largest n, of these the
    smallest, where that n is `times` as large; root is the last of a word's chain of forms, itself if it has none.
    """
    # Ids follow the order of words, so that ties are told by ids.
    words = written(counts.orderBy("word").select(F.monotonically_increasing_id().alias("id"), "word", F.col("n").cast("long").alias("n")), "words")
    parts = sizes_bounded(words.count(), WORDS_A_PART)
    near = written(neighbours(words.repartition(parts), max(parts, words.sparkSession.sparkContext.defaultParallelism)), "near")
    known = words.select("id", "n").join(near, "id").where(F.col("best.n") >= times * F.col("n"))
    links = written(known.select("id", (-F.col("best.minus")).alias("form"), F.col("best.n").alias("form_n")), "forms")
    roots = rooted(links)
    name = lambda column: words.select(F.col("id").alias(column), F.col("word").alias(f"{column}_word"))
    named = links.join(roots, "id").join(name("form"), "form").join(name("root"), "root").select("id", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "form_n")
    rows = words.join(near.select("id", "n_near"), "id", "left").join(named, "id", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES_AS_OFTEN) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of so many code points and occurrences in whole texts; see variants().

    A null text has no words, a null doc_id hashes like an empty one, repeated rows count each, other columns are
    ignored, an empty table gives an empty result.
    """
    return variants(occurrences(docs, least_length).where(F.col("n") >= least_count), times)


def spelling_variants_sql() -> str:
    """The same rows in DuckDB SQL: words that share a deletion at a place, or of which one is a deletion of the other; CRC-32 by its table."""
    step = "CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END"
    table = "list_transform(range(256), lambda c: c)"
    for _ in range(8):
        table = f"list_transform({table}, lambda c: {step})"
    return f"""WITH RECURSIVE crc AS (SELECT {table} AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS times, encode(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)) AS raw FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc_id, run),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_transform(range(octet_length(raw)), lambda i: CAST(concat('0x', substr(hex(raw), 2 * i + 1, 2)) AS BIGINT)), lambda acc, b: xor(acc >> 8, t[CAST(xor(acc, b) & 255 AS INTEGER) + 1]), 4294967295)) AS h FROM counted, crc),
said AS (SELECT CASE WHEN h % {MISSPELT_ONE_IN} = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS INTEGER)), substr(run, CAST(h % length(run) AS INTEGER) + 2)) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM said WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM cut),
pairs AS (SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
near AS (SELECT word, count(*) AS n_near, max(n) AS form_n FROM pairs GROUP BY word),
forms AS (SELECT w.word, min(p.other) AS form, x.form_n FROM words w JOIN near x ON x.word = w.word AND x.form_n >= {TIMES_AS_OFTEN} * w.n JOIN pairs p ON p.word = w.word AND p.n = x.form_n GROUP BY w.word, x.form_n),
chain AS (SELECT word, form AS last FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.last),
roots AS (SELECT word, last AS root FROM chain WHERE last NOT IN (SELECT word FROM forms))
SELECT w.word, f.form, coalesce(r.root, w.word) AS root, w.n, coalesce(x.n_near, 0) AS n_near, f.form_n FROM words w LEFT JOIN near x ON x.word = w.word LEFT JOIN forms f ON f.word = w.word LEFT JOIN roots r ON r.word = w.word"""
