"""Suffix-array dedup: common-prefix-aware distributed merge sort.

Every string of LENGTH bytes that starts at more than one place is to go. To sort all suffixes would be to sort the whole
corpus many times over; instead each window of LENGTH bytes is represented by its anchor, the place in it with the lowest
hash of GRAM bytes. Equal windows have their anchor at the same offset, and neighbouring windows mostly share theirs, so
there is one suffix for a run of windows. A run's suffix is its bytes from the anchor on, then those before it, reversed.

1. A run whose anchor occurs nowhere else is out. Runs of equal bytes form a class; two members of each go on.
2. Tasks sort their suffixes and exchange the sorted runs by ranges, front-coded: each suffix as the length of the prefix
   it shares with the one before, and the rest.
3. Each range is merged by a loser tree that keeps, for every contender, the length of its common prefix with the last
   winner: the longer one wins unseen, and only equally long ones are compared, from there on.
4. The merged order with its common prefixes is the suffix array. Two windows are equal if their suffixes share the part
   after the anchor in this order, and the part before it in the same order of the reversed parts.
5. A class of equal windows may reach over the end of a range only as far as the end's own common prefix goes. Runs with
   such windows are sorted and merged once more by their reversed parts, in ranges of that order. Windows that reach over
   the ends in both orders are few different ones; these are counted by their bytes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import discard, sizes_bounded, small_batches, text_or_empty, written

LENGTH = 400
#: Bytes whose hash chooses the anchors.
GRAM = 32
#: Classes in one range, about, and bytes of suffixes in one sorted run at most.
RANGE_ROWS = 8000
RUN_BYTES = 24 << 20
#: The whole suffix of one class in so many is sampled, by hash; the ranges end at some of these.
SAMPLE_EVERY = 500
#: Samples that one task puts in order.
CUT_ROWS = 4096

ODD = 0x9E3779B97F4A7C15
ANCHORS = "key long, h1 long, h2 long, row binary, a int, s1 int, s2 int, head binary"
U64 = np.uint64
_table = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype="u8")


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """64-bit hashes of all strings of GRAM bytes."""
    h, width = _table[b], 1
    while width < GRAM:
        h = h[:-width] * U64(pow(ODD, width, 1 << 64)) + h[width:]
        width *= 2
    h = (h ^ (h >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return h ^ (h >> U64(32))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of every `width` neighbours, from least values of blocks' beginnings and ends."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, ~U64(0))
    padded[: len(v)] = v
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def runs_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, anchor, first window, last window) of the runs of windows with a common anchor, in order."""
    if len(data) < length:
        none = np.zeros(0, "i8")
        return none.astype("u8"), none, none, none
    h = gram_hashes(np.frombuffer(data, "u1"))
    place = np.arange(len(h), dtype="u8")
    least = sliding_least((h & U64(0xFFFFFFFF00000000)) | place, length - GRAM + 1)
    anchor = (least & U64(0xFFFFFFFF)).astype("i8")
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(first[1:], len(anchor)) - 1
    return h[anchor[first]], anchor[first], first, last


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def anchors(length: int, sample_every: int) -> Callable:
    """For mapInArrow: (row, text) to a row for each run of windows. h1, h2: hash of all its bytes; head: its suffix, of a sample."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            keys, same, rows, places, heads = [], [], [], [], []
            for row, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                data = text.encode()
                key, *found = runs_of(data, length)
                keys.append(key)
                place = np.stack(found, axis=1)
                each = place.tolist()
                raw = b"".join([xxhash.xxh3_128_digest(data[x : y + length], seed=p - x) for p, x, y in each])
                hashes = np.frombuffer(raw, "<i8").reshape(-1, 2)
                same.append(hashes)
                places.append(place)
                rows += [row] * len(each)
                heads += [suffix(data, *p, length) if h % sample_every == 0 else None for h, p in zip(hashes[:, 0].tolist(), each, strict=True)]
            columns = [np.concatenate(keys).view("i8"), *np.concatenate(same).T, pa.array(rows, pa.binary()), *np.concatenate(places).T.astype("i4"), pa.array(heads, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=names(ANCHORS))

    return run


def suffix(data: bytes, a: int, s1: int, s2: int, length: int) -> bytes:
    return data[a : s2 + length] + data[s1:a][::-1]


def common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, of which `start` bytes are known."""
    n, step = min(len(a), len(b)), 16
    while start < n:
        if a[start : start + step] != b[start : start + step]:
            while start < n and a[start] == b[start]:
                if step > 1 and a[start : start + step // 2] == b[start : start + step // 2]:
                    start += step // 2
                    step = max(1, step // 2)
                else:
                    step = max(1, step // 2)
                    if step == 1:
                        start += 1
            return min(start, n)
        start += step
        step *= 2
    return n


RUNS = "range int, run long, lcp binary, lens binary, data binary, meta binary"
RUN_KINDS = (pa.int32(), pa.int64(), *[pa.binary()] * 4)


def coded(items: list[tuple], number: int, ends: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Items (string, key, h1, h2, p1, p2) sorted, cut at the ends of ranges and front-coded: a row for each range."""
    press = zstandard.ZstdCompressor(level=1)
    items.sort()
    strings = [x[0] for x in items]
    cuts = [0, *(bisect.bisect_left(strings, e) for e in ends), len(items)]
    for at, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if i < j:
            lcp = [0, *(common(strings[k - 1], strings[k], 0) for k in range(i + 1, j))]
            rest = [strings[k][c:] for k, c in zip(range(i, j), lcp, strict=True)]
            meta = np.array([x[1:] for x in items[i:j]], "i8").tobytes()
            row = (at, number, np.array(lcp, "u4").tobytes(), np.array([len(r) for r in rest], "u4").tobytes(), press.compress(b"".join(rest)), press.compress(meta))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, RUN_KINDS, strict=True)], names=names(RUNS))


def run_writer(ends: list[bytes], strings: Callable) -> Callable:
    """For mapInArrow: batches, of which `strings` makes items, to this task's sorted runs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, held, number = [], 0, TaskContext.get().partitionId() << 24
        for batch in small_batches(batches, 64):
            for item in strings(batch):
                items.append(item)
                held += len(item[0])
            if held > RUN_BYTES:
                yield from coded(items, number, ends)
                items, held, number = [], 0, number + 1
        yield from coded(items, number, ends)

    return run


def from_texts(length: int) -> Callable:
    """Of rows (packed, runs: list of (key, h1, h2, a, s1, s2)): the suffixes of the runs; p1 to p2: bytes of windows after the anchor."""

    def items(batch: pa.RecordBatch) -> Iterator[tuple]:
        unpack = zstandard.ZstdDecompressor()
        for packed, runs in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            data = unpack.decompress(packed) if runs else b""
            for x in runs or ():
                a, s1, s2 = x["a"], x["s1"], x["s2"]
                yield suffix(data, a, s1, s2, length), x["key"], x["h1"], x["h2"], length - a + s1, length - a + s2

    return items


def from_open(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Of rows (open, key, h1, h2, lo, hi): the strings and places given."""
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def cutter_of_ranges(every: int) -> Callable:
    """For mapInArrow: sorted strings to every so manieth as the end of a range, no longer than needed to tell it from the one before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = b"", 0
        for batch in batches:
            found = []
            for text in batch.column(0).to_pylist():
                seen += 1
                if seen % every == every // 2 and text != last:
                    found.append(text[: common(last, text, 0) + 1])
                last = text
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["cut"])

    return run


def range_ends(heads: DataFrame, every: int) -> list[bytes]:
    """Where the ranges end: one short string for each of them comes to the driver. heads: (head), a sample of what is to be sorted."""
    heads = written(heads, "heads")
    parts = sizes_bounded(heads.count(), CUT_ROWS)
    ordered = heads.repartitionByRange(parts, "head").sortWithinPartitions("head")
    ends = sorted({bytes(r["cut"]) for r in ordered.mapInArrow(cutter_of_ranges(every), "cut binary").collect()})
    discard(heads)
    return ends


class LoserTree:
    """Merges sorted runs. Each is an iterator of (string, common prefix with the one before, payload)."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, tuple]]]):
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.known = [0] * self.size  # each contender's common prefix with the winner it last lost to
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        a, b = self.heads[x], self.heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if self.known[x] != self.known[y]:
            return (x, y) if self.known[x] > self.known[y] else (y, x)
        n = common(a[0], b[0], self.known[x])
        if a[0][n : n + 1] <= b[0][n : n + 1]:
            self.known[y] = n
            return x, y
        self.known[x] = n
        return y, x

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[bytes, int, tuple]]:
        """All strings in order, each with its common prefix with the one before."""
        while self.heads[self.winner] is not None:
            best = self.winner
            text, _, payload = self.heads[best]
            yield text, self.known[best], payload
            after = next(self.runs[best], None)
            self.heads[best], self.known[best] = after, after[1] if after else 0
            node = (best + self.size) // 2
            while node:
                best, self.losers[node] = self._play(best, self.losers[node])
                node //= 2
            self.winner = best


def decoded(lcp: bytes, lens: bytes, data: bytes, meta: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """A front-coded run, string after string."""
    unpack = zstandard.ZstdDecompressor()
    text, at, data = b"", 0, unpack.decompress(data)
    rows = np.frombuffer(unpack.decompress(meta), "i8").reshape(-1, 5).tolist()
    for c, n, row in zip(np.frombuffer(lcp, "u4").tolist(), np.frombuffer(lens, "u4").tolist(), rows, strict=True):
        text, at = text[:c] + data[at : at + n], at + n
        yield text, c, tuple(row)


def classes_at(lcp: np.ndarray, place: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each (place in a sorted order, depth): the number of the class of strings that are equal up to this depth. lcp: with the string before."""
    out = np.empty(len(place), "i8")
    order = np.argsort(depth, kind="stable")
    depths, first = np.unique(depth[order], return_index=True)
    for d, i, j in zip(depths.tolist(), first, np.append(first[1:], len(order)), strict=False):
        at = order[i:j]
        out[at] = np.cumsum(lcp < d)[place[at]]
    return out


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of all values from lo to hi of each owner."""
    n = np.maximum(hi - lo + 1, 0)
    own = np.repeat(np.arange(len(lo)), n)
    return own, np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + lo[own]


def reach_of(lcp: np.ndarray) -> np.ndarray:
    """The longest common prefix with a neighbour. lcp: with the string before."""
    return np.maximum(lcp, np.append(lcp[1:], 0))


FOUND = "key long, h1 long, h2 long, lo int, hi int, open binary, n int"


def merger(length: int, ends: list[bytes], last: bool) -> Callable:
    """For applyInArrow on a range's runs.

    Repeated windows (lo to hi: their bytes in a string's first part) have a null `open`. Windows whose class may go on in
    other ranges come with `open`: for a first pass one string with its parts exchanged, for the last one the window.
    """

    def run(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        merged = list(LoserTree([decoded(*r) for r in zip(*(table.column(c).to_pylist() for c in ("lcp", "lens", "data", "meta")), strict=True)]))
        texts, m = [t for t, _, _ in merged], len(merged)
        meta = np.array([x for _, _, x in merged], "i8").reshape(-1, 5)
        p1, p2 = meta[:, 3], meta[:, 4]
        lcp = np.array([0, *(c for _, c, _ in merged[1:])])
        low = common(ends[number - 1], texts[0], 0) if number else 0
        high = common(ends[number], texts[-1], 0) if number < len(ends) else 0
        to_low = np.minimum.accumulate(np.append(low, lcp[1:]))
        to_high = np.minimum.accumulate(np.append(lcp[1:], high)[::-1])[::-1]
        over = np.maximum(to_low, to_high)
        # The second parts, in their own order.
        rest = [t[n:] for t, n in zip(texts, p2.tolist(), strict=True)]
        order = sorted(range(m), key=rest.__getitem__)
        rank = np.empty(m, "i8")
        rank[order] = np.arange(m)
        lcp2 = np.array([0, *(common(rest[x], rest[y], 0) for x, y in zip(order, order[1:], strict=False))])
        lo, hi = np.maximum(p1, length - reach_of(lcp2)[rank]), np.minimum(p2, reach_of(lcp))
        if last:  # windows over the ends are wanted too
            lo, hi = np.where(over >= p1, p1, lo), np.where(over >= p1, np.maximum(hi, np.minimum(p2, over)), hi)
        own, depth = spread(lo, hi)
        both = (depth * (m + 1) + classes_at(lcp, own, depth)) * (m + 1) + classes_at(lcp2, rank[own], length - depth)
        _, one, back, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
        hit = count[back] > 1
        at = np.flatnonzero(hit)
        first = np.flatnonzero(np.append(True, (own[at][1:] != own[at][:-1]) | (depth[at][1:] != depth[at][:-1] + 1))) if len(at) else at
        stop = np.append(first[1:], len(at))[: len(first)] - 1
        settled = zip(own[at[first]].tolist(), depth[at[first]].tolist(), depth[at[stop]].tolist(), strict=True)
        known = meta.tolist()
        out = {(*known[i][:3], x, y, None, 0) for i, x, y in settled}
        if last:
            open_ = np.flatnonzero(depth <= over[own])
            wanted = open_[~hit[open_] | np.isin(open_, one)]
            windows = zip(own[wanted].tolist(), depth[wanted].tolist(), hit[wanted].tolist(), strict=True)
            out |= {(*known[i][:3], p, p, texts[i][:p] + rest[i][: length - p], 2 if x else 1) for i, p, x in windows}
        else:
            reach = np.minimum(p2, over)
            for i in np.flatnonzero(reach >= p1).tolist():
                p, q = int(p1[i]), int(reach[i])
                out.add((*known[i][:3], p, q, rest[i][: length - p] + texts[i][:q], 1))
        kinds = (*[pa.int64()] * 3, pa.int32(), pa.int32(), pa.binary(), pa.int32())
        columns = zip(*out, strict=True) if out else [[]] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names(FOUND))

    return run


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (row, doc_id, text) with the text compressed, as it is shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches):
        texts = pa.array([press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["row", "doc_id", "packed"])


def cut_out(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """What is left without the spans, which may overlap or touch, and how many maximal ones they are."""
    kept, at, number = [], 0, 0
    for start, stop in sorted(spans):
        if start > at or not number:
            kept.append(data[at:start])
            number += 1
        at = max(at, stop)
    kept.append(data[at:])
    return b"".join(kept), number


def cutter(digest: bool) -> Callable:
    """For mapInArrow: (doc_id, packed, spans) to doc_id, n_bytes, n_removed, n_spans and what is kept: its SHA-256, or itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in small_batches(batches):
            rows = []
            for text, spans in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                data = unpack.decompress(text)
                kept, number = cut_out(data, [(x["start"], x["stop"]) for x in spans or ()])
                last = hashlib.sha256(kept).hexdigest() if digest else kept
                rows.append((len(data), len(data) - len(kept), number, last))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


CLASS = ["key", "h1", "h2"]


def repeated(runs: DataFrame, ends: list[bytes], length: int, sample_every: int, cut_every: int) -> DataFrame:
    """(key, h1, h2, some: array of lo and hi), written, of the repeated windows of sorted runs: lo to hi of their bytes are from the anchor on."""
    merged = written(runs.groupBy("range").applyInArrow(merger(length, ends, last=False), FOUND), "merged")
    used, found = [merged], merged.where("open is null").select(*CLASS, "lo", "hi")
    open_ = merged.where("open is not null").select("open", *CLASS, (length - F.col("hi")).alias("lo"), (length - F.col("lo")).alias("hi"))
    if ends:
        other = range_ends(open_.where(F.pmod("h1", F.lit(sample_every)) == 0).select(F.col("open").alias("head")).distinct(), cut_every)
        twice = open_.mapInArrow(run_writer(other, from_open), RUNS).groupBy("range").applyInArrow(merger(length, other, last=True), FOUND)
        twice = written(twice, "twice")
        used.append(twice)
        over = twice.where("open is not null")
        counted = over.groupBy("lo", "open").agg(F.sum("n").alias("total")).where("total > 1").select("lo", "open")
        more = twice.where("open is null").select(*CLASS, "lo", "hi").union(over.join(counted, ["lo", "open"]).select(*CLASS, "lo", "hi"))
        found = found.union(more.select(*CLASS, (length - F.col("hi")).alias("lo"), (length - F.col("lo")).alias("hi")))
    marks = written(found.groupBy(*CLASS).agg(F.collect_set(F.struct("lo", "hi")).alias("some")), "marks")
    discard(*used)
    return marks


def _removed(docs: DataFrame, digest: bool, schema: str, length: int, range_rows: int) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))))
    texts = texts.select(key.alias("row"), "doc_id", "text")
    sample_every = max(1, min(SAMPLE_EVERY, range_rows // 16))
    cut_every = range_rows // sample_every
    found = written(texts.select("row", "text").mapInArrow(anchors(length, sample_every), ANCHORS), "anchors")
    # Written before joins, so that these are plain shuffles of two tables, whose hot keys Spark can split.
    again = written(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "again")
    sought = written(found.join(again, "key", "left_semi"), "sought")
    discard(found, again)
    place = F.struct("row", "a", "s1", "s2")
    members = sought.groupBy(*CLASS).agg(F.min(place).alias("one"), F.max(place).alias("two"))
    members = members.select(*CLASS, F.explode(F.array_distinct(F.array("one", "two"))).alias("x")).select(*CLASS, "x.*")
    ends = range_ends(sought.where("head is not null").select("head").distinct(), cut_every)
    rows = texts.mapInArrow(packed, "row binary, doc_id long, packed binary").repartition("row")
    # Both joins with the texts keep all rows, so that they read one shuffle of them.
    lists = members.groupBy("row").agg(F.collect_list(F.struct(*CLASS, "a", "s1", "s2")).alias("runs"))
    runs = rows.join(lists, "row", "left").select("packed", "runs", "doc_id").mapInArrow(run_writer(ends, from_texts(length)), RUNS)
    marks = repeated(runs, ends, length, sample_every, cut_every)
    span = F.struct((F.col("a") - length + F.col("x.lo")).alias("start"), (F.col("a") + F.col("x.hi")).alias("stop"))
    spans = sought.select(*CLASS, "row", "a").join(marks, CLASS).select("row", "a", F.explode("some").alias("x")).select("row", span.alias("span"))
    given = spans.groupBy("row").agg(F.collect_set("span").alias("spans"))
    return rows.join(given, "row", "left").select("doc_id", "packed", "spans").mapInArrow(cutter(digest), schema)


def remove_digests(docs: DataFrame, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document, as of remove()."""
    return _removed(docs, True, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, range_rows)


def remove(docs: DataFrame, length: int = LENGTH, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary: what is left) of every document's UTF-8 bytes.

    Each byte goes that is covered by a string of `length` bytes which also starts elsewhere, in the same document or in
    another; all of its places lose it. Matches don't cross documents. A null text counts as empty; a null doc_id stays
    null; repeated rows are documents of their own, and so copies of each other; other columns are ignored; an empty
    table gives an empty result.
    """
    return _removed(docs, False, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", length, range_rows)
