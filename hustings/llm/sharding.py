"""Sharding: balanced label propagation. DataFrame functions only.

Documents of equal text are linked. Every document starts in a shard by the hash of its id. Then, round by round, linked
documents move towards the shard where most of their neighbours are. A neighbourhood is a group of equal texts, and all
its members see the same neighbours, so what moves is a cell: the members of one group that started in one shard. A
shard takes cells only up to its quota, what is missing to an even share and what leaves. The rounds end when no cell
moves. Groups that fit a shard and are split even then are placed whole.

Documents without links then fill the shards evenly, the large ones first: on a line of cumulated sizes each shard gets
a stretch as long as what it lacks. So sizes end as near to each other as the smallest documents allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hustings.llm.common import sizes_bounded, text_or_empty, written

SHARDS = 40
#: Bytes that a document counts besides its text.
EXTRA_BYTES = 16
#: Each shard's quota is dealt to a part of the groups for every so many documents, so that admission is decided in parallel.
QUOTA_ROWS = 2_000_000
#: Groups and documents without links are placed in classes: above these shares of a shard's even size, then the rest.
CLASSES = (1 / 8, 1 / 32, 1 / 128, 1 / 512)
#: Rows of the line of sizes that one task orders.
LINE_ROWS = 50_000
LINE_PARTS = 4096


def running_start(rows: DataFrame, part: str, order: list, size: Column) -> DataFrame:
    """rows and `at`, the sum of size over all rows before: first over the parts (LINE_PARTS at most), then within."""
    sums = rows.groupBy(part).agg(F.sum(size).alias("held"))
    line = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(part, F.coalesce(F.sum("held").over(line), F.lit(0)).alias("first"))
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(first, part).select("*", (F.col("first") + F.coalesce(F.sum(size).over(within), F.lit(0))).alias("at")).drop("first")


def water_level(loads: list[int], extra: int) -> list[int]:
    """What each shard lacks to the level that all reach if `extra` more is poured in, lowest first."""
    order = sorted(range(len(loads)), key=lambda i: loads[i])
    level, left, n = loads[order[0]], extra, 1
    while n < len(order) and (loads[order[n]] - level) * n <= left:
        left -= (loads[order[n]] - level) * n
        level = loads[order[n]]
        n += 1
    each, rest = divmod(left, n)
    add = [0] * len(loads)
    for k, i in enumerate(order[:n]):
        add[i] = level + each + (k < rest) - loads[i]
    return add


def stretch_of(at: Column, ends: list[int]) -> Column:
    """The number of ends at or below a place on the line."""
    return F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends[:-1]]), lambda e: e <= at))


def loads_of(placed: DataFrame, shards: int, size: str) -> list[int]:
    found = {r["shard"]: r["held"] for r in placed.groupBy("shard").agg(F.sum(size).alias("held")).collect()}  # a row a shard
    return [found.get(i, 0) for i in range(shards)]


def circulation(flow: list[list[int]], room: list[int]) -> list[list[int]]:
    """What may go from shard to shard, of flow[from][to]: no shard gets more than its room and what leaves it."""
    may, n = [row[:] for row in flow], range(len(room))
    trimmed = True
    while trimmed:
        trimmed = False
        for t in n:
            comes, can = sum(may[s][t] for s in n), max(0, room[t] + sum(may[t]))
            if comes > can:
                trimmed = True
                for s in n:
                    may[s][t] = may[s][t] * can // comes
    return may


def propagate(cells: DataFrame, taken: list[int], shards: int, share: int, parts: int) -> DataFrame:
    """cells (g, start, shard, held) after label propagation under quotas beside what is taken: shard is where each cell ends.

    Rounds of first choices (the shard with most votes) and of second ones (that with most votes of those with room, for
    the whole rest of the group if there is one) take turns until neither moves a cell. A cell only goes where its group
    has more votes, so the sum of their squares grows with each move, and the rounds end.
    """
    still, second = 0, False
    while still < 2:
        room = [share - a - b for a, b in zip(taken, loads_of(cells, shards, "held"), strict=True)]
        votes = cells.groupBy("g", "shard").agg(F.sum("held").alias("votes")).withColumn("rank", F.struct("votes", F.xxhash64("g", "shard").alias("tie")))
        free = F.get(F.array(*[F.lit(x).cast("long") for x in room]), F.col("shard"))
        choice = votes.join(votes.groupBy("g").agg(F.sum("votes").alias("total")), "g").withColumn("fits", F.when(F.lit(second), free >= F.col("total") - F.col("votes")).otherwise(F.lit(True)))
        best = choice.where(free > 0 if second else F.lit(True)).groupBy("g").agg(F.max(F.struct("fits", "rank", "shard")).alias("best")).select("g", F.col("best.shard").alias("to"), F.col("best.rank").alias("top"))
        wish = written(cells.join(votes, ["g", "shard"]).join(best, "g").where("top > rank").select("g", "start", "shard", "to", "held", F.col("top.votes").alias("gain")), "wishes")
        flow = [[0] * shards for _ in range(shards)]
        for r in wish.groupBy("shard", "to").agg(F.sum("held").alias("held")).collect():  # a row for two shards
            flow[r["shard"]][r["to"]] = r["held"]
        if not second and not any(map(any, flow)):
            break  # every group is whole
        may = [(s, t, x // parts) for s, row in enumerate(circulation(flow, room)) for t, x in enumerate(row) if x]
        quota = F.broadcast(cells.sparkSession.createDataFrame(may, "shard int, to int, quota long"))
        queue = Window.partitionBy("shard", "to", "part").orderBy(F.desc("gain"), "g", "start")
        able = wish.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts))).join(quota, ["shard", "to"]).where("held <= quota")
        moved = written(able.select("g", "start", "to", (F.sum("held").over(queue) <= F.col("quota")).alias("fits")).where("fits").drop("fits"), "moved")
        if moved.limit(1).count():
            cells = written(cells.join(moved, ["g", "start"], "left").select("g", "start", F.coalesce("to", "shard").alias("shard"), "held"), "cells")
            still = 0
        else:
            still += 1
        second = not second
    return cells


def on_line(items: DataFrame, loads: list[int], parts: int) -> DataFrame:
    """items (g, size, ...; each g once) and shard: a stretch of the line of sizes for what each shard lacks."""
    add = water_level(loads, items.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    ends = [sum(add[: i + 1]) for i in range(len(loads))]
    line = running_start(items.withColumn("part", F.pmod(F.xxhash64("g", F.lit(2)), F.lit(parts))), "part", [F.desc("size"), "g"], F.col("size"))
    return line.withColumn("shard", stretch_of(F.col("at") + F.floor(F.col("size") / 2), ends).cast("int")).drop("part", "at")


def gathered(cells: DataFrame, taken: list[int], shards: int, share: int, parts: int) -> DataFrame:
    """cells with each group in one shard: those still split, and some of overfull shards, are placed whole by size."""
    over = [max(0, a + b - share) // parts for a, b in zip(taken, loads_of(cells, shards, "held"), strict=True)]
    groups = cells.groupBy("g").agg(F.min("shard").alias("low"), F.max("shard").alias("high"), F.sum("held").alias("size")).withColumn("part", F.pmod(F.xxhash64("g"), F.lit(parts)))
    queue = Window.partitionBy("low", "part").orderBy(F.xxhash64("g", F.lit(4))).rowsBetween(Window.unboundedPreceding, -1)
    too_many = F.get(F.array(*[F.lit(x).cast("long") for x in over]), F.col("low"))
    leaves = groups.where("low = high").withColumn("before", F.coalesce(F.sum("size").over(queue), F.lit(0))).where(F.col("before") < too_many)
    units = written(groups.where("low < high").select("g", "size").union(leaves.select("g", "size")), "units")
    rest = cells.join(units, "g", "left_anti")
    loads = [a + b for a, b in zip(taken, loads_of(rest, shards, "held"), strict=True)]
    placed = on_line(units, loads, parts).select("g", F.col("shard").alias("to"))
    return written(cells.join(placed, "g", "left").select("g", "start", F.coalesce("to", "shard").alias("shard"), "held"), "cells")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null: this law keeps no shard when grown).

    A null text has no bytes and the links of an empty one. Rows of null or repeated doc_id are documents of their own.
    A group of equal texts larger than a shard is spread over several, any other one is whole in one, even where that makes
    shards uneven. Ties between shards are told by hash, so that cells go both ways. Other columns are ignored; an empty table gives an empty result.
    """
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + EXTRA_BYTES).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("g"))
    rows = written(rows.withColumn("start", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).cast("int")), "rows")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("held")).first()
    share = whole["held"] // shards
    parts = sizes_bounded(whole["n"], LINE_ROWS, LINE_PARTS)
    size_class = sum((F.when(F.col("size") <= int(c * share), 1).otherwise(0) for c in CLASSES), F.lit(1))
    cells = rows.groupBy("g", "start").agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("members"), F.sum("held").alias("size")).where("members > 1").select("g", F.when(F.col("size") > share, 0).otherwise(size_class).alias("class"))
    cells = written(cells.join(linked, "g").select("g", "start", F.col("start").alias("shard"), "held", "class"), "linked")
    # Groups are placed in classes, the larger ones first, each on top of what is there; class 0 fits no shard.
    loads, settled = [0] * shards, cells.drop("class").limit(0)
    for number in sorted(r["class"] for r in cells.select("class").distinct().collect()):
        some = propagate(cells.where(F.col("class") == number).drop("class"), loads, shards, share, sizes_bounded(whole["n"], QUOTA_ROWS))
        some = gathered(some, loads, shards, share, parts) if number else some
        loads = [a + b for a, b in zip(loads, loads_of(some, shards, "held"), strict=True)]
        settled = settled.unionByName(some)
    placed = rows.join(settled.select("g", "start", "shard"), ["g", "start"], "left")
    singles = written(placed.where("shard is null").select("doc_id", "size", "text_crc32", "g"), "singles")
    # So are documents without links.
    done = [placed.where("shard is not null").select("doc_id", "size", "text_crc32", "g", "shard")]
    for number in sorted(r["class"] for r in singles.select(size_class.alias("class")).distinct().collect()):
        filled = written(on_line(singles.where(size_class == number), loads, parts), "filled")
        loads = [a + b for a, b in zip(loads, loads_of(filled, shards, "size"), strict=True)]
        done.append(filled)
    every = done[0]
    for filled in done[1:]:
        every = every.unionByName(filled)
    return numbered(every, parts).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def numbered(placed: DataFrame, parts: int) -> DataFrame:
    """placed and slot: 0, 1, ... within each shard, over parts of each shard at a time."""
    rows = placed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(parts)))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "g", "text_crc32")
    return rows.join(first, ["shard", "part"]).select("*", (F.col("first") + F.row_number().over(within) - 1).alias("slot"))
