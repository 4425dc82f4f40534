"""Approximate nearest neighbours: adaptive dimension scan.

Largest inner products become smallest distances by one more dimension that makes all vectors equally long. Vectors are
then rotated at random, so that every block of dimensions tells as much as any other, and kept in column blocks. They are
dealt to lists around centres; a query probes the lists whose centres are nearest, as many as a measured sample of queries
needs. Within a list the blocks are added up one after the other, and after each a hypothesis test abandons the candidates
whose distance so far says that the whole distance will exceed the query's present 20th. What remains is ranked by exact
inner products of the original vectors.

There are about as many lists as the root of the number of vectors. Neighbouring lists form groups, which are what is
shuffled: a query goes once to each group in which it probes any list. A group's candidates and its queries are both cut
into parts of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import sizes_bounded, written

NEAREST = 20
#: The centres are fitted on about so many vectors, chosen by hash, and on their root of all; every vector is indexed.
SAMPLE = 20_000
MOST_LISTS = 4096
#: Lists in a group, about.
GROUP_LISTS = 8
#: A query's first bound comes from vectors of the sample, of so many bytes at most; where lists yield too few answers, they fill them up.
REFERENCE_BYTES = 16 << 20
#: As many lists are probed as hold this share of the true neighbours of so many queries of the sample, which are compared with all vectors.
LIST_RECALL = 0.97
MEASURED = 128
#: Candidates, and queries, of a group that are scanned together; more are scanned in several parts.
PART_ROWS = 65_536
#: Candidates after which the queries' bounds are drawn tighter, and queries that are looked at together.
CHUNK = 2048
QUERIES = 512
#: Dimensions of a column block.
BLOCK = 16
#: A candidate is abandoned beyond so much: the larger, the surer the test.
SURENESS = 2.1
SEED = 7


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, norm2) without vectors that are null or zero, hold a null, NaN or infinity, or are not as long as most are."""
    v = F.transform(column, lambda x: x.cast("double"))
    inf = float("inf")
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & sound)
    rows = rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).where("norm2 > 0 and vec_id is not null")
    length = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("v") == (length["length"] if length else 0))


def rotation(dims: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))[0]


def lifted(v: np.ndarray, most: float, candidate: bool) -> np.ndarray:
    """One more dimension: candidates get the same length, queries a zero."""
    extra = np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0)) if candidate else np.zeros(len(v))
    return np.column_stack([v, extra])


def centres(sample: np.ndarray, number: int, rounds: int = 8) -> np.ndarray:
    """k-means on the sample."""
    rng = np.random.default_rng(SEED)
    found = sample[rng.choice(len(sample), min(number, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest_centres(sample, found, 1)[:, 0]
        counts = np.bincount(near, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def nearest_centres(v: np.ndarray, found: np.ndarray, number: int) -> np.ndarray:
    out = []
    for at in range(0, len(v), 1024):
        d = from_centres(v[at : at + 1024], found)
        out.append(np.argsort(d, axis=1, kind="stable")[:, :number])
    return np.concatenate(out) if out else np.zeros((0, number), "i8")


def top(query: np.ndarray, ids: np.ndarray, score: np.ndarray, number: int) -> np.ndarray:
    """Places of each query's best: highest score first, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < number]


def exact(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products pair by pair, added in the same order for each, so that equal vectors tie."""
    return (rows * queries).sum(axis=1)


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False))


def lists_of(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype="i4") * values.shape[1]), pa.array(values.ravel()))


def homes(found: np.ndarray, turn: np.ndarray, most: float) -> Callable:
    """For mapInArrow: (vec_id, v) to (list, vec_id, v): every vector in the list of the nearest centre."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = nearest_centres(lifted(vectors_of(batch.column(1)), most, True) @ turn, found, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype("i4")), *batch.columns], names=["list", "vec_id", "v"])

    return run


def measured(queries: np.ndarray, query_ids: np.ndarray, number: int) -> Callable:
    """For mapInArrow: (list, vec_id, v) to (query, list, vec_id, score) of each query's best among a task's rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, "i8")] * 3 + [np.zeros(0)]
        for batch in batches:
            if batch.num_rows:
                ids, score = batch.column(1).to_numpy(), queries @ vectors_of(batch.column(2)).T
                score[query_ids[:, None] == ids] = -np.inf
                best = np.argpartition(-score, min(number, len(ids)) - 1, axis=1)[:, :number]
                query = np.repeat(np.arange(len(queries)), best.shape[1])
                found = [query, batch.column(0).to_numpy()[best.ravel()].astype("i8"), ids[best.ravel()], score[query, best.ravel()]]
                held = [np.concatenate(x) for x in zip(held, found, strict=True)]
                keep = top(held[0], held[2], held[3], number)
                held = [x[keep] for x in held]
        yield pa.RecordBatch.from_arrays(list(map(pa.array, held)), names=["query", "list", "vec_id", "score"])

    return run


def probes_needed(placed: DataFrame, sample: np.ndarray, sample_ids: np.ndarray, found: np.ndarray, turn: np.ndarray, most: float, number: int) -> int:
    """How many lists hold LIST_RECALL of the true neighbours of MEASURED vectors of the sample."""
    some = np.random.default_rng(SEED + 1).permutation(len(sample))[:MEASURED]
    best = placed.mapInArrow(measured(sample[some], sample_ids[some], number), "query long, list long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= number) & (F.col("score") > float("-inf")))
    true = best.select("query", "list").toPandas()  # MEASURED times NEAREST rows
    if not len(true):
        return len(found)
    places = np.argsort(nearest_centres(lifted(sample[some], most, False) @ turn, found, len(found)), axis=1)
    deep = np.sort(places[true["query"], true["list"]])
    return int(deep[min(len(deep) - 1, math.ceil(LIST_RECALL * len(deep)))]) + 1


def asker(found: np.ndarray, groups: np.ndarray, turn: np.ndarray, most: float, probes: int, known: np.ndarray, known_ids: np.ndarray, number: int) -> Callable:
    """For mapInArrow: queries (vec_id, v) to rows (part of the grid, vec_id, v, bar, radius): one for each group with a list to probe.

    bar bounds the query's distances: that of its `number`th best among the known vectors. radius: of the furthest centre probed.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, v = batch.column(0).to_numpy(), vectors_of(batch.column(1))
                near = from_centres(lifted(v, most, False) @ turn, found)
                radius = np.partition(near, probes - 1, axis=1)[:, probes - 1]
                bar = np.full(len(ids), np.inf)
                if len(known) > number:
                    score = v @ known.T
                    score[ids[:, None] == known_ids] = -np.inf
                    bar = most + (v * v).sum(axis=1) + 2 * np.partition(-score, number - 1, axis=1)[:, number - 1]
                wanted = np.zeros((len(ids), groups.max() + 1), bool)
                q, at = np.nonzero(near <= radius[:, None])
                wanted[q, groups[at]] = True
                q, group = np.nonzero(wanted)
                columns = [pa.array(group.astype("i4")), pa.array(ids[q]), lists_of(v[q]), pa.array(bar[q]), pa.array(radius[q])]
                yield pa.RecordBatch.from_arrays(columns, names=["group", "vec_id", "v", "bar", "radius"])

    return run


def from_centres(v: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Squared distances to all centres but for a term that is the same for all of a vector."""
    return (found * found).sum(axis=1) - 2 * v @ found.T


def scan(queries: np.ndarray, query_ids: np.ndarray, bars: np.ndarray, probed: np.ndarray, rows: np.ndarray, ids: np.ndarray, lists: np.ndarray, turn: np.ndarray, most: float, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its nearest of the rows in lists that it probes (probed: query by list), by adaptive dimension scan: query places, ids and scores."""
    asked, bars = lifted(queries, most, False) @ turn, bars + 1e-9 * most  # for rounding
    dims = asked.shape[1]
    best = [np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0)]
    for at in range(0, len(ids), CHUNK):
        turned = lifted(rows[at : at + CHUNK], most, True) @ turn
        q, c = np.nonzero(probed[:, lists[at : at + CHUNK]])
        so_far = np.zeros(len(q))
        for start in range(0, dims, BLOCK):
            seen = min(dims, start + BLOCK)
            if start:
                part = turned[c, start:seen] - asked[q, start:seen]
                so_far = so_far + np.einsum("ij,ij->i", part, part)
            else:
                a, b = asked[:, :seen], turned[:, :seen]
                so_far = np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T, 0)[q, c]
            # A candidate whose distance so far is beyond what the bar allows for these dimensions is abandoned.
            keep = so_far <= bars[q] * min(1.0, seen / dims * (1 + SURENESS / math.sqrt(seen)) ** 2)
            q, c, so_far = q[keep], c[keep], so_far[keep]
        other = ids[at + c] != query_ids[q]
        q, c = q[other], at + c[other]
        best = [np.concatenate(x) for x in zip(best, (q, ids[c], exact(rows[c], queries[q])), strict=True)]
        keep = top(*best, number)
        best = [x[keep] for x in best]
        full = np.bincount(best[0], minlength=len(queries)) == number
        worst = np.full(len(queries), np.inf)
        np.minimum.at(worst, best[0], best[2])
        reached = most + (queries * queries).sum(axis=1) - 2 * worst + 1e-9 * most
        bars = np.where(full, np.minimum(bars, reached), bars)
    return tuple(best)


def scanner(found: np.ndarray, turn: np.ndarray, most: float, number: int) -> Callable:
    """For applyInArrow on parts of the grid: candidates (list) and queries (bar, radius) to the nearest of each query."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        bar = group.column("bar").to_numpy()
        is_query = ~np.isnan(bar)
        ids, lists, radius = (group.column(c).to_numpy() for c in ("vec_id", "list", "radius"))
        out: list = [[np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]]
        if is_query.any() and not is_query.all():
            v = vectors_of(group.column("v").chunk(0))
            order = np.flatnonzero(~is_query)
            order = order[np.lexsort((ids[order], lists[order]))]
            rows, row_ids = v[order], ids[order]
            there, row_lists = np.unique(lists[order], return_inverse=True)
            asks = np.flatnonzero(is_query)
            for start in range(0, len(asks), QUERIES):
                some = asks[start : start + QUERIES]
                near = from_centres(lifted(v[some], most, False) @ turn, found)[:, there]
                q, near_ids, score = scan(v[some], ids[some], bar[some], near <= radius[some][:, None], rows, row_ids, row_lists, turn, most, number)
                for column, values in zip(out, (ids[some][q], near_ids, score), strict=True):
                    column.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def first_answers(known: np.ndarray, known_ids: np.ndarray, number: int) -> Callable:
    """For mapInArrow: queries (vec_id, v) to (query_id, vec_id, score) of their best known vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(known):
                ids, v = batch.column(0).to_numpy(), vectors_of(batch.column(1))
                score = v @ known.T
                score[ids[:, None] == known_ids] = -np.inf
                near = np.argpartition(-score, min(number, len(known)) - 1, axis=1)[:, :number]
                q, c = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
                other = known_ids[c] != ids[q]
                q, c = q[other], c[other]
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(known_ids[c]), pa.array(exact(known[c], v[q]))], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, every: int = 20, number: int = NEAREST, references: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector whose id `every` divides, its nearest others by inner product.

    Ties go to the smaller vec_id. Vectors that are null or zero or hold a null or non-finite component, rows without an
    id, and vectors whose length is not the most frequent one (of equally frequent ones, the largest) take no part; a query
    with fewer candidates gets them all as far as its lists are probed. Of repeated ids one row counts, that of the largest
    vector. Other columns are ignored; an empty table gives an empty result.
    """
    rows = usable(vectors).groupBy("vec_id").agg(F.max(F.struct("v", "norm2")).alias("x")).select("vec_id", "x.v", "x.norm2")
    rows = written(rows, "vectors")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most"), F.max(F.size("v")).alias("dims")).first()
    n, most, dims = whole["n"], whole["most"] or 1.0, (whole["dims"] or 1) + 1
    turn = rotation(dims)
    lists = max(1, min(MOST_LISTS, math.isqrt(n)))
    share = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1_000_000)) < 1e6 * min(1.0, max(SAMPLE, 16 * lists) / max(1, n))
    chosen = rows.where(share).select("vec_id", "v").toPandas().sort_values("vec_id")  # about SAMPLE rows, 16 * MOST_LISTS at most
    sample, sample_ids = (np.stack(chosen["v"].to_numpy()), chosen["vec_id"].to_numpy()) if len(chosen) else (np.zeros((0, dims - 1)), np.zeros(0, "i8"))
    found = centres(lifted(sample, most, True) @ turn, lists) if len(chosen) else np.zeros((1, dims))
    group_centres = centres(found, -(-len(found) // GROUP_LISTS))
    groups = nearest_centres(found, group_centres, 1)[:, 0]
    placed = written(rows.select("vec_id", "v").mapInArrow(homes(found, turn, most), "list int, vec_id long, v array<double>"), "lists")
    probes = probes_needed(placed, sample, sample_ids, found, turn, most, number)
    known = np.random.default_rng(SEED).permutation(len(sample))[: REFERENCE_BYTES // (8 * dims) if references is None else references]
    known, known_ids = sample[known], sample_ids[known]
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v")
    asked = queries.mapInArrow(asker(found, groups, turn, most, probes, known, known_ids, number), "group int, vec_id long, v array<double>, bar double, radius double")
    # The grid: parts of a group's candidates by blocks of queries.
    blocks = sizes_bounded(-(-n // every), PART_ROWS)
    of_list = F.split(F.lit(",".join(map(str, groups))), ",").cast("array<int>")
    placed = placed.withColumn("group", F.get(of_list, F.col("list")))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    sizes = F.broadcast(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).select("group", parts.alias("parts")))  # a row for each group
    digit = lambda number, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), number).cast("int")
    candidates = placed.join(sizes, "group").select("group", digit(F.col("parts"), "part").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v", "list", F.lit(float("nan")).alias("bar"), F.lit(0.0).alias("radius"))
    asking = asked.join(sizes, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), digit(F.lit(blocks), "block").alias("block"), "vec_id", "v", F.lit(-1).alias("list"), "bar", "radius")
    best = candidates.unionByName(asking).groupBy("group", "part", "block").applyInArrow(scanner(found, turn, most, number), "query_id long, vec_id long, score double")
    # Where its lists yield too few, a query's best known vectors fill up its answers.
    first = queries.mapInArrow(first_answers(known, known_ids, number), "query_id long, vec_id long, score double")
    both = best.withColumn("known", F.lit(0)).unionByName(first.withColumn("known", F.lit(1)))
    both = both.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("known").alias("known"))
    of_query, order = Window.partitionBy("query_id"), Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = both.withColumn("found", F.sum(1 - F.col("known")).over(of_query)).where((F.col("known") == 0) | (F.col("found") < number))
    return both.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= number)
