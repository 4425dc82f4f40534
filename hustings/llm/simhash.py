"""SimHash near-duplicates: fingerprints of word shingles, linked by pivot distance tables (pivots.py).

Each text gets a 64-bit fingerprint of its word shingles; texts whose fingerprints differ in a few bits are linked. With a
bound on similarity, links are verified on the texts' whole sets of shingles, and what fingerprints cannot tell at that
bound is completed (nearcopies.py).
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import small_batches, text_or_empty, written
from hustings.llm.components import components
from hustings.llm.nearcopies import near_copies
from hustings.llm.pivots import HASH_SEED, MOST_BITS, links

SHINGLE_WORDS = 3


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> bytes:
    """8 bytes, the highest bit first. A-Z are lower-cased; words stand between ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_digest(joined, seed=HASH_SEED)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    digest, seed = xxhash.xxh64_digest, HASH_SEED
    starts = [0, *ends]
    hashes = b"".join([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle_words - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, "u1").reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype="i8") * 2 > len(bits)).tobytes()


def fingerprints(words: int) -> Callable:
    """For mapInArrow: (doc_id, text) to (doc_id, fp)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            raw = b"".join([fingerprint(t, words) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype("i8"))], names=["doc_id", "fp"])

    return run


def as_hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, words: int = SHINGLE_WORDS, least: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable over links) of every document.

    Links are between fingerprints at most `most` bits apart. With `least` they are between texts whose sets of shingles
    have that Jaccard similarity or more, all of them, and the fingerprint is that of the set.

    A null or empty text has fingerprint zero and is linked like any other; repeated rows have rows each; rows whose
    doc_id is null take part, but give no component its name, and a component of such rows alone has a null one; other
    columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    if least is not None:
        return near_copies(texts, most, words, least).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
    found = written(texts.mapInArrow(fingerprints(words), "doc_id long, fp long"), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("lowest"))
    roots = components(links(distinct.select("fp"), most))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = named.join(names, "root").select("fp", "component_id")
    return found.join(classes, "fp", "left").select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
