"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least a bound, none left out.

SimHash fingerprints a few bits apart give the first pairs, by pivot distance tables. No bit bound of 64-bit fingerprints
with usable keys reaches all pairs at 0.8, so the others meet by their shingles. All sets are put in one order of shingles, and of each set only the beginning (n - ceil(least * n) + 1 shingles) is looked at: two
sets whose beginnings share nothing are less similar than the bound. Each shingle's sets are first held against the set
whose shingles are shared most, which is close to what a group was copied from; so most groups become one component. Sets
of different components need to meet only at the first shingle that they share, of which both must have enough left for
the bound. The order has common shingles last, so that copies that differ too much run out of it on shingles of their own;
which ones count as common is told from a sample, which decides the work, never the result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import discard, sizes_bounded, small_batches, text_or_empty, written
from hustings.llm.components import components
from hustings.llm.pivots import HASH_SEED, MOST_BITS, links

WORDS = 5
LEAST = 0.8
#: Share of all documents, and of few documents their number, about, from which the common shingles are told; how many of
#: them share one; how many are told at most.
SAMPLE_SHARE, SAMPLE_DOCS = 1 / 8, 20_000
COMMON_IN = 2
MOST_COMMON = 500_000
#: Shingles of beginnings that a task holds at a time, and sets whose shingles go to one bucket, about.
BLOCK_KEYS = 2_000_000
BUCKET_SETS = 8000
#: Sets named in pairs up to which their names are broadcast to fetch their texts; beyond, Spark shuffles all texts.
BROADCAST_SETS = 1_000_000


def shingles(text: str, words: int) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted; a text of fewer words is one shingle."""
    found = text.lower().encode().split()
    if not found:
        return np.empty(0, "u8")
    joined = b" ".join(found)
    ends = list(itertools.accumulate(len(w) + 1 for w in found))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a : b - 1], HASH_SEED) for a, b in zip([0, *ends], ends[min(words, len(found)) - 1 :], strict=False)])
    return np.unique(np.frombuffer(hashes, ">u8").astype("u8"))


def beginning(n: int, least: float) -> int:
    """How many shingles of n are looked at. The small term makes it one too long rather than one too short."""
    return n - math.ceil(least * n - 1e-9) + 1 if n else 0


def among(every: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of `every` are in `known`, which is sorted."""
    at = np.searchsorted(known, every)
    found = at < len(known)
    found[found] = known[at[found]] == every[found]
    return found


def sampled(words: int) -> object:
    """For mapInArrow: (text) to (key), each text's shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys = np.concatenate([np.empty(0, "u8"), *[shingles(t, words) for t in batch.column(0).to_pylist()]])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view("i8"))], names=["key"])

    return run


def fingerprint_of(every: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed integer."""
    bits = np.unpackbits(every.astype(">u8").view("u1").reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(axis=0, dtype="i8") * 2 > len(bits)).view(">i8")[0])


def beginnings(words: int, least: float, common: np.ndarray) -> object:
    """For mapInArrow: (doc_id, text) to (doc_id, packed, same, fp, n, keys): the set's hash, fingerprint and size, and its beginning."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in small_batches(batches):
            packed, same, fps, sizes, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                every = shingles(text, words)
                packed.append(press.compress(text.encode()))
                same.append(xxhash.xxh64_digest(every.tobytes(), HASH_SEED))
                fps.append(fingerprint_of(every))
                sizes.append(len(every))
                late = among(every, common)
                keys.append(np.concatenate([every[~late], every[late]])[: beginning(len(every), least)].view("i8"))
            starts = np.cumsum([0, *map(len, keys)]).astype("i4")
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate([np.empty(0, "i8"), *keys])))
            sets = pa.array(np.frombuffer(b"".join(same), ">i8").astype("i8"))
            columns = [batch.column(0), pa.array(packed, pa.binary()), sets, pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "packed", "same", "fp", "n", "keys"])

    return run


SHARED = "bucket int, data binary, key long, same long, n long, pos long"
PLACE = [("key", "<i8"), ("same", "<i8"), ("n", "<i4"), ("pos", "<i4")]
NAMES = [name for name, _ in PLACE]


def shared_rows(bucket: list, data: list, *known: np.ndarray) -> pa.RecordBatch:
    """Blobs, and rows (key, same, n, pos) of shingles known to be shared."""
    gap = len(known[0])
    columns = [pa.array([*bucket, *[None] * gap], pa.int32()), pa.array([*data, *[None] * gap], pa.binary())]
    columns += [pa.concat_arrays([pa.nulls(len(bucket), pa.int64()), pa.array(c.astype("i8"))]) for c in known]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "data", *NAMES])


def sharing(buckets: int) -> object:
    """For mapInArrow: (same, n, keys) to rows of shingles that sets of this task share, and of all its shingles one place each, in blobs by bucket.

    So a bucket gets a shingle once from each block of sets at most, however many share it.
    """

    def block(sets: dict[int, tuple[int, list]]) -> pa.RecordBatch:
        same = np.fromiter(sets, "i8", len(sets))
        size = np.array([n for n, _ in sets.values()], "i8")
        keys = [np.array(k, "i8") for _, k in sets.values()]
        key, owner = np.concatenate([np.empty(0, "i8"), *keys]), np.repeat(np.arange(len(keys)), list(map(len, keys)))
        pos = np.concatenate([np.empty(0, "i8"), *[np.arange(len(k)) for k in keys]])
        order = np.argsort(key, kind="stable")
        key, owner, pos = key[order], owner[order], pos[order]
        new = np.append(True, key[1:] != key[:-1])
        several = ~new | ~np.append(new[1:], True)
        one_key, one, one_pos = key[new], owner[new], pos[new]
        at = np.argsort(one_key % buckets, kind="stable")
        of, first = np.unique((one_key % buckets)[at], return_index=True)
        place = np.zeros(len(at), PLACE)
        place["key"], place["same"], place["n"], place["pos"] = one_key[at], same[one[at]], size[one[at]], one_pos[at]
        blobs = [place[i:j].tobytes() for i, j in zip(first, np.append(first[1:], len(at)), strict=False)]
        return shared_rows(of.tolist(), blobs, key[several], same[owner[several]], size[owner[several]], pos[several])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[int, list]] = {}
        held = 0
        for batch in batches:
            for same, n, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), strict=True):
                if same not in sets:
                    sets[same] = (n, keys)
                    held += len(keys)
                if held > BLOCK_KEYS:
                    yield block(sets)
                    sets, held = {}, 0
        if sets:
            yield block(sets)

    return run


def meeting(table: pa.Table) -> pa.Table:
    """For applyInArrow on a bucket's blobs: places (key, same, n, pos) of shingles that several blocks have."""
    place = np.frombuffer(b"".join(table.column("data").to_pylist()), PLACE)
    place = place[np.argsort(place["key"], kind="stable")]
    new = np.append(True, place["key"][1:] != place["key"][:-1])[: len(place)]
    place = place[~new | ~np.append(new[1:], True)[: len(place)]]
    return pa.table([pa.array(place[c].astype("i8")) for c in NAMES], names=NAMES)


def compared(words: int, least: float) -> object:
    """For mapInArrow: (u, v, texts of both, packed) to the (u, v) that are similar enough."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small_batches(batches):
            near = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = (shingles(unpack.decompress(t).decode(), words) for t in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    return run


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """The shingles that most sampled texts share, sorted. The sample grows with the documents, or passages that few in a thousand share would escape it and their documents meet pair by pair."""
    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_DOCS / max(1, texts.count())))
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1e6 * share).select("text").distinct()
    counted = some.mapInArrow(sampled(words), "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_IN)
    counted = written(counted.select("key", F.floor(F.log2("n") * 8).cast("int").alias("level")), "common")
    # As many levels as stay within the bound; there are a few hundred at most.
    levels = sorted(counted.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    told = itertools.accumulate(row.n for row in levels)
    taken = [row.level for row, n in zip(levels, told, strict=True) if n <= MOST_COMMON]
    found = counted.where(F.col("level").isin(taken)).select("key").toArrow().column(0).to_numpy() if taken else np.empty(0, "i8")
    discard(counted)
    return np.sort(found.view("u8"))


def _enough(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v, nu, nv), a row for each shared key, to the pairs that may be similar enough: outside of what both beginnings share there are only the rests."""
    rest = F.greatest(*[F.ceil(F.lit(least) * F.col(n) - 1e-9) - 1 for n in ("nu", "nv")])
    both = F.lit(least / (1 + least)) * (F.col("nu") + F.col("nv")) - 1e-6
    return pairs.groupBy("u", "v", "nu", "nv").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") + rest >= both).select("u", "v")


def _sizes_agree(least: float):
    return F.least("nu", "nv") >= F.lit(least) * F.greatest("nu", "nv") - 1e-6


def _left_over(least: float):
    """Of a set, what is left from a shingle on, less its own share of what a similar pair has in common."""
    return F.col("n") - F.col("pos") - F.lit(least / (1 + least)) * F.col("n")


def _reaches(least: float, left: str, n: str):
    """Whether that is enough for the other set's share. It is at the first shingle that a similar pair has in common, as all it shares lies from there on."""
    return F.col(left) >= F.lit(least / (1 + least)) * F.col(n) - 1e-6


def _verified(pairs: DataFrame, sets: DataFrame, words: int, least: float) -> DataFrame:
    """The similar pairs of (u, v), by whole texts of sets (same, packed); written. Only texts that a pair asks for are shuffled, if their number is bounded."""
    pairs = written(pairs, "pairs")
    asked = written(pairs.select(F.col("u").alias("same")).union(pairs.select(F.col("v").alias("same"))).distinct(), "asked", 2 * pairs.count())
    texts = sets.join(F.broadcast(asked) if asked.count() <= BROADCAST_SETS else asked, "same", "left_semi").dropDuplicates(["same"])
    for k in ("u", "v"):
        pairs = pairs.join(texts.select(F.col("same").alias(k), F.col("packed").alias(f"packed_{k}")), k)
    found = written(pairs.select("u", "v", "packed_u", "packed_v").mapInArrow(compared(words, least), "u long, v long"), "similar")
    discard(asked)
    return found


def near_copies(docs: DataFrame, most: int = MOST_BITS, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, fp (SimHash of the set) and component_id (smallest doc_id reachable over pairs of similarity `least` or more) of every document.

    Words are lower-cased and stand between ASCII white space. Texts without words are copies of each other. Repeated rows
    have rows each; a null doc_id gives no component its name; other columns are ignored; an empty table gives an empty
    result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found = written(texts.mapInArrow(beginnings(words, least, common_shingles(texts, words)), "doc_id long, packed binary, same long, fp long, n long, keys array<long>"), "beginnings")
    sets = found.select("same", "packed")
    # Shingles of the beginnings that several sets have.
    rows = found.count()
    places = written(found.select("same", "n", "keys").mapInArrow(sharing(sizes_bounded(rows, BUCKET_SETS)), SHARED), "places")
    shared = places.where("bucket is null").select(*NAMES).union(places.where("bucket is not null").groupBy("bucket").applyInArrow(meeting, "key long, same long, n long, pos long"))
    shared = written(shared.distinct(), "shared")
    most_met = shared.count()
    met = written(shared.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "lowest", most_met)
    counted = written(shared.join(met, "key"), "counted", most_met)
    middle = written(counted.groupBy("same").agg((F.sum("m") / F.first("n")).alias("pop")), "middle", most_met)
    centres = written(counted.join(middle, "same").groupBy("key").agg(F.max(F.struct("pop", "same", "n")).alias("x")).select("key", F.col("x.same").alias("u"), F.col("x.n").alias("nu")), "centres", most_met)
    keyed = written(counted.join(centres, "key").select(*NAMES, "u", "nu"), "met", most_met)
    discard(places, shared, met, counted, middle, centres)
    # Sets whose fingerprints are linked, each with the lowest of its fingerprint's component.
    marked = found.groupBy("same", "n").agg(F.min("fp").alias("fp"))
    alike = components(links(marked.select("fp").distinct(), most)).withColumnRenamed("node", "fp")
    marked = marked.join(alike, "fp", "left").select("same", "n", F.coalesce("root", "fp").alias("root"))
    lowest = marked.groupBy("root").agg(F.min(F.struct("same", "n")).alias("x"))
    hinted = marked.join(lowest, "root").select(F.col("x.same").alias("u"), F.col("x.n").alias("nu"), F.col("same").alias("v"), F.col("n").alias("nv"))
    hinted = hinted.where("u != v").where(_sizes_agree(least)).select("u", "v")
    # Then each set with the centre of each key: large groups of near copies become one component in linear time.
    star = keyed.select("u", "nu", F.col("same").alias("v"), F.col("n").alias("nv")).where("u != v").where(_sizes_agree(least))
    edges = _verified(_enough(star, least).union(hinted).distinct(), sets, words, least)
    # Then all pairs of different components that may meet at the first shingle they share.
    rooted = keyed.select(*NAMES).join(components(edges).withColumnRenamed("node", "same"), "same", "left").select(*NAMES, F.coalesce("root", "same").alias("root"))
    rooted = written(rooted.withColumn("left", _left_over(least)), "rooted", most_met)
    sides = rooted.groupBy("key", "root").agg(F.max("left").alias("left"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    one, two = (sides.select("key", *[F.col(c).alias(f"{c}_{r}") for c in ("root", "left", "lo", "hi")]) for r in "ab")
    may = (_reaches(least, "left_a", "lo_b") & _reaches(least, "left_b", "lo_a")) & (F.least("hi_a", "hi_b") >= F.lit(least) * F.greatest("lo_a", "lo_b") - 1e-6)
    apart = written(one.join(two, "key").where("root_a < root_b").where(may).select("key", "root_a", "root_b", "left_b", "lo_b", "hi_b"), "apart")
    one, two = (rooted.select("key", F.col("root").alias(f"root_{r}"), F.col("same").alias(x), F.col("n").alias(f"n{x}"), F.col("left").alias(f"left_{x}")) for r, x in (("a", "u"), ("b", "v")))
    # Of a component, only sets that may be similar to any of the other one.
    some = (F.col("nu") >= F.lit(least) * F.col("lo_b") - 1e-6) & (F.col("hi_b") >= F.lit(least) * F.col("nu") - 1e-6)
    some &= _reaches(least, "left_u", "lo_b") & _reaches(least, "left_b", "nu")
    met = apart.join(one, ["key", "root_a"]).where(some).join(two, ["key", "root_b"]).where(_sizes_agree(least)).where(_reaches(least, "left_u", "nv") & _reaches(least, "left_v", "nu"))
    pairs = met.select("u", "v").distinct()
    edges = edges.union(_verified(pairs, sets, words, least))
    classes = found.groupBy("same").agg(F.min("doc_id").alias("lowest")).join(components(edges).withColumnRenamed("node", "same"), "same", "left").select("same", "lowest", F.coalesce("root", "same").alias("root"))
    names = classes.groupBy("root").agg(F.min("lowest").alias("component_id"))
    told = written(found.select("doc_id", "fp", "same").join(classes.join(names, "root").select("same", "component_id"), "same").select("doc_id", "fp", "component_id"), "told", rows)
    discard(found, keyed, rooted, apart)
    return told
