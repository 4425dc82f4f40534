"""Pivot distance tables: which 64-bit fingerprints differ in few bits.

For every distinct fingerprint a row of Hamming distances to fixed reference fingerprints is computed once. By the
triangle inequality two fingerprints at distance d differ by at most d in each of these coordinates. So pairs meet in
bands: a fingerprint is at home in the cell of its distances to two references and looks into the cells that distances up
to d away can fall in. Two references alone would leave cells of a fixed share of all fingerprints; so the cells are those
within an untouched block of bits, one of which any linked pair has (d differing bits touch d of d + 1 blocks at most).
Of the pairs that meet, those whose largest coordinate difference is above d are discarded without looking at their bits;
survivors are verified.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import written

HASH_SEED = 42
#: Reference fingerprints.
PIVOTS = 16
#: Distances to a reference in one cell; more than twice the greatest distance of a link, so that a row looks into two cells at most.
CELL = 5
MOST_BITS = 2
#: Distinct fingerprints of one block above which the block is split: another part of the other bits must be untouched too.
SPLIT_ABOVE = 2048

BLOCKS = ((0, 22), (22, 43), (43, 64))


def references(number: int = PIVOTS) -> list[int]:
    """Reference fingerprints, by hashing their numbers; as signed 64-bit integers."""
    found = [xxhash.xxh64_intdigest(str(i), seed=HASH_SEED) for i in range(number)]
    return [h - (h >> 63 << 64) for h in found]


def bits_of(fp: Column, parts: Iterable[tuple[int, int]]) -> Column:
    """The named bit ranges of a fingerprint, the others zero."""
    mask = sum(((1 << (b - a)) - 1) << a for a, b in parts)
    return fp.bitwiseAND(F.lit(mask - (mask >> 63 << 64)))


def finer(block: tuple[int, int]) -> list[tuple[tuple[int, int], ...]]:
    """A block and one of three parts of the other bits."""
    rest = [b for b in BLOCKS if b != block]
    bits = [x for a, b in rest for x in range(a, b)]
    third = -(-len(bits) // 3)
    return [(block, *((x, x + 1) for x in bits[i : i + third])) for i in range(0, len(bits), third)]


def cells(distance: Column, most: int) -> Column:
    """The cells that distances up to `most` away fall in."""
    low, high = (F.floor((distance + x) / CELL).cast("int") for x in (-most, most))
    return F.array_distinct(F.array(low, high))


def linker(most: int) -> object:
    """For mapInArrow: rows (key, bits, fp, pivots, home) sorted by key to edges (u, v) that connect what is linked under each key."""

    def forest(fps: np.ndarray, pivots: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, int]]:
        parent = list(range(len(fps)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        looks = np.flatnonzero(~home)
        for i in np.flatnonzero(home).tolist():
            near = looks[fps[looks] > fps[i]]
            near = near[np.abs(pivots[near] - pivots[i]).max(axis=1, initial=0) <= most]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= most]
            for j in near.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[b] = a
                    yield i, j

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last key's rows may go on in the next batch
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = pa.concat_tables([held, new]) if held is not None else new
            if held is None or not held.num_rows:
                continue
            key = np.stack([held.column(i).to_numpy() for i in (0, 1)])
            starts = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))
            last = held.num_rows if batch is None else int(starts[-1])
            fps = held.column(2).to_numpy().view("u8")
            ends = np.append(starts[1:], held.num_rows)
            edges = []
            some = [(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a > 2 and b <= last]
            if some:
                pivots = np.frombuffer(b"".join(held.column(3).to_pylist()), "i1").reshape(held.num_rows, -1)
                home = np.array(held.column(4).to_pylist(), bool)
                for a, b in some:
                    edges += [(int(fps[a + i].view("i8")), int(fps[a + j].view("i8"))) for i, j in forest(fps[a:b], pivots[a:b], home[a:b])]
            held = held.slice(last).combine_chunks()
            u, v = zip(*edges, strict=True) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def links(distinct: DataFrame, most: int = MOST_BITS, split_above: int = SPLIT_ABOVE) -> DataFrame:
    """(u, v): edges between distinct fingerprints (fp) that connect all that are linked, not all linked pairs. most: 2 at most."""
    if most >= len(BLOCKS):
        raise ValueError(f"fingerprints can be linked at {len(BLOCKS) - 1} differing bits at most")
    fp = F.col("fp")
    distances = [F.bit_count(fp.bitwiseXOR(F.lit(r))).cast("int") for r in references()]
    blocks = F.array(*[F.struct(F.lit(i).alias("k"), bits_of(fp, (b,)).alias("bits")) for i, b in enumerate(BLOCKS)])
    keyed = distinct.select("fp", F.explode(blocks).alias("key")).select("key.*", "fp")
    shared = written(keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "blocks")
    met = keyed.join(shared, ["k", "bits"])
    # A key is a block, perhaps with another part, and the cells of two references; each block has its own two.
    keys = F.array()
    for i, block in enumerate(BLOCKS):
        whole = F.array(F.struct(F.lit(i).alias("k"), "bits"))
        parts = F.array(*[F.struct(F.lit(10 + 3 * i + j).alias("k"), bits_of(fp, p).alias("bits")) for j, p in enumerate(finer(block))])
        found = F.when(F.col("n") <= split_above, whole).otherwise(parts)
        keys = F.when(F.col("k") == i, found).otherwise(keys) if i else found
    pick = lambda j: F.when(F.col("k") == 0, distances[j]).when(F.col("k") == 1, distances[2 + j]).otherwise(distances[4 + j])
    pivots = F.concat(*[F.unhex(F.lpad(F.hex(d), 2, "0")) for d in distances])
    rows = met.select("fp", pivots.alias("pivots"), pick(0).alias("d0"), pick(1).alias("d1"), F.explode(keys).alias("key"))
    at = lambda a, b, home: F.struct((a * 100 + b).alias("cell"), F.lit(home).alias("home"))
    own = F.array(at(*(F.floor(F.col(d) / CELL).cast("int") for d in ("d0", "d1")), home=True))
    looks = F.flatten(F.transform(cells(F.col("d0"), most), lambda a: F.transform(cells(F.col("d1"), most), lambda b: at(a, b, False))))
    banded = rows.select("fp", "pivots", "key", F.explode(F.concat(own, looks)).alias("at"))
    banded = banded.select((F.col("key.k") * 10_000 + F.col("at.cell")).cast("long").alias("k"), "key.bits", "fp", "pivots", "at.home")
    return banded.repartition("k", "bits").sortWithinPartitions("k", "bits").mapInArrow(linker(most), "u long, v long")
