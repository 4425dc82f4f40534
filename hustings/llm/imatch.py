"""Document fingerprints: I-Match with randomised lexicon subsets. DataFrame functions only.

A term's document frequency over the whole corpus decides whether it is in the lexicon: neither too rare nor too common.
Every lexicon term belongs to some of SUBSETS random sub-lexicons. For each sub-lexicon a text's distinct terms in it are
sorted and hashed together, in this order; the fingerprint is the row of these hashes.

Sub-lexicons are of several densities, so that short and long texts alike have some with a handful of their terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import sizes_bounded, text_or_empty, written

#: Terms in at least and at most these shares of all documents are in the lexicon, and in two documents at least.
LEAST_SHARE = 0.0005
MOST_SHARE = 0.5
#: Sub-lexicons: number, and how many densities from one term in eight, one in sixteen and so on.
SUBSETS = 32
DENSITIES = 8
#: A lexicon of at most so many terms is broadcast (its size is at most the mean number of terms a text over LEAST_SHARE).
BROADCAST_TERMS = 1_000_000
#: Documents, in order of doc_id, that are sorted together to find each one's next; more of them beyond MOST_BUCKETS buckets.
BUCKET_ROWS = 4000
MOST_BUCKETS = 200_000


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text: runs of letters and digits, in lower case."""
    found = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(F.filter(found, lambda w: w != ""), lambda w: F.xxhash64(w))


def lexicon(docs: DataFrame, rows: int) -> DataFrame:
    """(term, subsets): lexicon terms of documents (text), and the sub-lexicons that each is in, if any."""
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    band = counts.where((F.col("n") >= max(2, LEAST_SHARE * rows)) & (F.col("n") <= MOST_SHARE * rows))
    chosen = [F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(8 << k % DENSITIES)) == 0, F.lit(k)) for k in range(SUBSETS)]
    return band.select("term", F.array_compact(F.array(*chosen)).alias("subsets"))


def edges(keys: DataFrame, rows: int) -> tuple[list[int], list[int]]:
    """(place, tie) of the first document of every bucket, in order: two numbers for BUCKET_ROWS documents come to the driver."""
    parts = sizes_bounded(rows, BUCKET_ROWS, MOST_BUCKETS)
    ranged = keys.repartitionByRange(parts, "place", "tie").select(F.spark_partition_id().alias("bucket"), "place", "tie")
    found = ranged.groupBy("bucket").agg(F.min(F.struct("place", "tie")).alias("first")).select("first.*").orderBy("place", "tie").collect()
    return [r["place"] for r in found], [r["tie"] for r in found]


def numbers(values: list[int]) -> Column:
    """One literal, whatever the number of values."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def bucket_of(firsts: tuple[list[int], list[int]]) -> Column:
    """The last bucket whose first document is not after this one, by binary search."""
    places, ties = map(numbers, firsts)
    middle = lambda s: F.shiftright(s["lo"] + s["hi"] + 1, 1)
    after = lambda i: (F.get(places, i) > F.col("place")) | ((F.get(places, i) == F.col("place")) & (F.get(ties, i) > F.col("tie")))
    below = lambda s: F.struct(s["lo"].alias("lo"), (middle(s) - 1).alias("hi"))
    above = lambda s: F.struct(middle(s).alias("lo"), s["hi"].alias("hi"))
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(after(middle(s)), below(s)).otherwise(above(s))
    number = len(firsts[0])
    start = F.struct(F.lit(0).alias("lo"), F.lit(max(0, number - 1)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, number.bit_length()))), start, step)["lo"]


HIGHEST = (1 << 63) - 1


def likeness(a: str, b: str, same: Column) -> Column:
    """Of the sub-lexicons that either text has terms of, the share with equal parts; without any, whether the texts are equal."""
    pairs = F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))
    told = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(told == 0, same.cast("double")).otherwise(equal / told)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they are.

    The edited text has the last third of its code points replaced by the first as many of the next document's, in
    descending doc_id; after the last comes the first. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (0 to 1).

    A null text counts as empty. A null doc_id comes after all others. Rows of equal doc_id are in order of their texts'
    XXH64, so each has a next one; rows equal in both are sorted by one task. The next of a sole document is itself. A text
    without any term in a sub-lexicon has an empty fingerprint, and is like another one without if their texts are equal.
    Other columns are ignored; an empty table gives an empty result.
    """
    # place: ascending where doc_id is descending, nulls last.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.select("doc_id", "text", F.coalesce(F.bitwise_not("doc_id"), F.lit(HIGHEST)).alias("place"), F.xxhash64("text").alias("tie"))
    rows = docs.count()
    known = written(lexicon(texts, rows), "lexicon")
    firsts = edges(texts.select("place", "tie"), rows)
    mark = 0  # every text has this pseudo-term, which carries its other columns and is in subset -1 alone
    known = known.where((F.col("term") != mark) & (F.size("subsets") > 0)).union(docs.sparkSession.range(1).select(F.lit(mark).cast("long"), F.array(F.lit(-1))))
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known

    # Documents in buckets of neighbours; each bucket's first is in the one before as a guest, for its text.
    number = max(1, len(firsts[0]))
    own = texts.select("*", (bucket_of(firsts) if firsts[0] else F.lit(0)).alias("bucket"))
    is_first = (F.get(numbers(firsts[0]), F.col("bucket")) == F.col("place")) & (F.get(numbers(firsts[1]), F.col("bucket")) == F.col("tie")) if firsts[0] else F.lit(True)
    home = F.struct("bucket", F.lit(0).alias("guest"))
    away = F.struct(F.pmod(F.col("bucket") - 1, F.lit(number)).alias("bucket"), F.lit(1).alias("guest"))
    placed = own.select("doc_id", "place", "tie", "text", F.explode(F.when(is_first, F.array(home, away)).otherwise(F.array(home))).alias("at"))
    placed = placed.select("doc_id", "place", "tie", "text", "at.bucket", "at.guest")
    order = Window.partitionBy("bucket").orderBy("guest", "place", "tie")
    n = F.char_length("text")
    edit = F.floor(n / 3).cast("int")
    with_next = placed.select("bucket", "guest", "doc_id", "text", F.row_number().over(order).alias("nth"), F.lead("text").over(order).alias("next"))
    edited = with_next.select("bucket", "guest", "doc_id", "nth", "text", n.cast("long").alias("n_chars"), F.concat(F.left("text", n - edit), F.left(F.coalesce("next", F.lit("")), edit)).alias("edited"))
    hashed = edited.select("*", F.sha2("text", 256).alias("text_sha256"), F.sha2("edited", 256).alias("edited_sha256"))
    kept = F.struct("guest", "doc_id", "n_chars", "text_sha256", "edited_sha256")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))
    both = hashed.select("bucket", "nth", kept.alias("kept"), F.explode(sides).alias("x")).select("bucket", "nth", "kept", "x.side", F.col("x.t").alias("t"))
    each = both.select("bucket", "nth", "side", "kept", F.explode(F.concat(F.array(F.lit(mark).cast("long")), terms(F.col("t")))).alias("term"))
    each = each.select("bucket", "nth", "side", F.when(F.col("term") == mark, F.col("kept")).alias("kept"), "term")
    met = each.join(known, "term").select("bucket", "nth", "side", "kept", "term", F.explode("subsets").alias("k"))
    # The distinct terms of each sub-lexicon, sorted and hashed in this order.
    parts = met.groupBy("bucket", "nth", "side", "k").agg(F.max("kept").alias("kept"), F.xxhash64(F.sort_array(F.collect_list("term"))).alias("part"))
    every = [F.max(F.when((F.col("side") == side) & (F.col("k") == k), F.col("part"))).alias(f"p{side}_{k}") for side in (0, 1) for k in range(SUBSETS)]
    found = parts.groupBy("bucket", "nth").agg(F.max("kept").alias("kept"), *every)
    row = lambda side: F.array(*[f"p{side}_{k}" for k in range(SUBSETS)])
    found = found.select("bucket", "nth", "kept.*", row(0).alias("a"), row(1).alias("b"))
    after = Window.partitionBy("bucket").orderBy("nth")
    found = found.select("*", F.lead("a").over(after).alias("c"), F.lead("text_sha256").over(after).alias("next_sha256")).where("guest = 0")
    as_text = lambda c: F.array_join(F.transform(F.col(c), lambda x: F.coalesce(F.hex(x), F.lit("-"))), ".")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text("a").alias("fingerprint"), as_text("b").alias("edited_fingerprint"),
        likeness("a", "b", F.col("text_sha256") == F.col("edited_sha256")).alias("near_edited"),
        likeness("a", "c", F.col("text_sha256") == F.col("next_sha256")).alias("near_next"),
    )
