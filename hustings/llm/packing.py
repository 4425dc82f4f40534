"""Best-fit packing: large-item matching.

Documents become token ids with an end id, longer ones are cut at the capacity, and all pieces are packed into as few
sequences as the method finds. How many pieces there are of each length decides the packing: lengths run from 1 to the
capacity, so that histogram is of fixed size whatever the corpus. The plan is made on it alone; the pieces stay
distributed and look up their place in the plan by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import small_batches, text_or_empty, written
from hustings.llm.tokens import encoder

CAPACITY = 4096
END_ID = 1

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def piece_cutter(vocabulary: str, capacity: int, end_id: int) -> Callable:
    """For mapInArrow: (doc_id, text) to a row for each piece, with its rank among this task's pieces of its length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part = encoder(vocabulary).ids, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = np.zeros(capacity + 1, "i8")
        for batch in small_batches(batches):
            rows = []
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                raw = ids(text) + end
                for piece, start in enumerate(range(0, len(raw) // 4, capacity)):
                    cut = raw[4 * start : 4 * (start + capacity)]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, start, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """(segments, sequences) for so many pieces of each length.

    A segment (length, first rank, number, first sequence, offset) places consecutive ranks of one length, one into each
    of as many consecutive sequences, all at the same offset. Pieces above a third of the capacity come first: of these
    no three fit together, so each sequence takes one and the largest partner that still fits. The others go, longest
    first, into the smallest gap that holds them; where none does, new sequences are opened.
    """
    left = dict(counts)
    ranks: dict[int, int] = dict.fromkeys(counts, 0)
    segments: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, number)
    open_gaps: list[int] = []  # the keys of gaps, sorted
    opened = 0

    def put(length: int, number: int, first: int, offset: int) -> None:
        segments.append((length, ranks[length], number, first, offset))
        ranks[length] += number
        left[length] -= number

    def free(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, number))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        for b in reversed(large[: bisect.bisect_right(large, min(a, capacity - a))]):
            pairs = left[a] // 2 if a == b else min(left[a], left[b])
            if pairs:
                put(a, pairs, opened, 0)
                put(b, pairs, opened, a)
                free(capacity - a - b, opened, pairs)
                opened += pairs
            if not left[a]:
                break
        if left[a]:
            number = left[a]
            put(a, number, opened, 0)
            free(capacity - a, opened, number)
            opened += number
    for a in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[a]:
            at = bisect.bisect_left(open_gaps, a)
            if at == len(open_gaps):
                each = capacity // a
                full, rest = divmod(left[a], each)
                for number, copies in ((full, each), (1 if rest else 0, rest)):
                    for i in range(copies if number else 0):
                        put(a, number, opened, i * a)
                    free(capacity - copies * a, opened, number)
                    opened += number
                continue
            gap = open_gaps[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                del open_gaps[at]
            take = min(number, left[a])
            put(a, take, first, capacity - gap)
            free(gap - a, first, take)
            free(gap, first + take, number - take)
    return np.array(sorted(segments), "i8").reshape(-1, 5), opened


def placer(segments: np.ndarray) -> Callable:
    """For mapInArrow: pieces with their rank to pieces with their place."""
    keys = (segments[:, 0] << 44) + segments[:, 1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            found = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            row = segments[found]
            places = [pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])]
            names = [x.split()[0] for x in PLACES.split(", ")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), *places], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one (its piece holds the end id alone); a null doc_id stays null; repeated rows are packed
    as often as they come; other columns are ignored; an empty table gives an empty result. Pieces of equal length are
    interchangeable, so ties need no rule.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    pieces = written(texts.mapInArrow(piece_cutter(vocabulary, capacity, end_id), PIECES), "pieces")
    cells = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = cells.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(placer(segments), PLACES)
