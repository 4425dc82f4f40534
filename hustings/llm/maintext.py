"""HTML extraction by consensus host paths.

Every page is read twice (markup.py). First its containers are scored and it votes for the path of its best one: the tags
from the root, each with its first class, digits made alike. Spark counts votes by host and path, and tells for each
layout, the set of paths that a page has, which of them has most votes of the host. Then pages are read again, and their
text is what stands in the containers of the winning path. Only votes and layouts are grouped; the text of a page is never
shuffled while winners are few enough to be broadcast, by Spark's own threshold on the size of their file.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm import markup
from hustings.llm.common import discard, small_batches, written

HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@\s]+)")
#: A host's rows are dealt over so many parts when they meet a winner, as one host may have a third of all pages. Winners
#: are repeated so often, so what is broadcast is so many times Spark's threshold at most.
SALTS = 16

VOTE = "host string, layout long, paths array<long>, best long, path string, depth int"
READ = "page_id long, url string, host string, layout long, salt int, best long, path string, blocks array<string>, containers array<struct<path: long, start: int, end: int>>"
TEXT = "page_id long, url string, text string, host string, path string"


def host_of(url: str | None) -> str | None:
    found = HOST.match(url or "")
    return found[1].lower() if found else None


def layout_of(paths: Iterable[int]) -> int:
    """A hash of the set of paths."""
    return xxhash.xxh64_intdigest(",".join(map(str, sorted(paths)))) - (1 << 63)


def ballots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (url, html) to VOTE; pages without host or text don't vote."""
    kinds = (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.int32())
    for batch in small_batches(batches, 64):
        rows = []
        for url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            host = host_of(url)
            page = markup.read(html or "") if host else None
            scores = markup.path_scores(page, markup.kept(page)) if page else {}
            if scores:
                best = markup.best_container(page, scores)
                rows.append((host, layout_of(scores), sorted(scores), page.paths[best], markup.readable(page, best), markup.depth_of(page, best)))
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "layout", "paths", "best", "path", "depth"])


def readings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (page_id, url, html) to READ: what may be text, and the places of containers that hold any."""
    place = pa.struct([("path", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(place))
    for batch in small_batches(batches, 64):
        rows = []
        for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = markup.read(html or "")
            stays = markup.kept(page)
            scores = markup.path_scores(page, stays)
            best = markup.best_container(page, scores)
            nth = [0]  # how many blocks before each stay
            for stay in stays:
                nth.append(nth[-1] + stay)
            places = [(p, nth[a], nth[b]) for p, a, b in zip(page.paths, page.starts, page.ends, strict=True) if nth[a] < nth[b]]
            blocks = [t for t, stay in zip(page.blocks, stays, strict=True) if stay]
            salt = xxhash.xxh32_intdigest(html or "", seed=1) % SALTS if best is not None else 0
            rows.append((page_id, url, host_of(url), layout_of(scores), salt, None if best is None else page.paths[best], None if best is None else markup.readable(page, best), blocks, [dict(zip(("path", "start", "end"), x, strict=True)) for x in places]))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "host", "layout", "salt", "best", "path", "blocks", "containers"])


def extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: READ's page_id, url, host, path, blocks and containers, and the winning path, to TEXT."""
    for batch in small_batches(batches, 64):
        rows = []
        for page_id, url, host, path, blocks, containers, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chosen, done = [], 0
            for x in containers:  # in page order, outer ones first
                if x["path"] == winner:
                    chosen += blocks[max(x["start"], done) : x["end"]]
                    done = max(done, x["end"])
            rows.append((page_id, url, "\n".join(chosen), host, path))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 4), strict=True)], names=["page_id", "url", "text", "host", "path"])


def winners(pages: DataFrame) -> DataFrame:
    """host, layout, winner, path: of a layout's paths the one with most votes of its host; ties to the deepest, then the smallest hash."""
    cast = pages.select("url", "html").mapInArrow(ballots, VOTE)
    # A row for each layout and choice, not for each page; the paths follow from the layout.
    counted = written(cast.groupBy("host", "layout", "best").agg(F.count(F.lit(1)).alias("votes"), F.any_value("paths").alias("paths"), F.min("path").alias("path"), F.min("depth").alias("depth")), "ballots")
    votes = written(counted.groupBy("host", "best").agg(F.sum("votes").alias("votes"), F.min("path").alias("path"), F.min("depth").alias("depth")), "votes")
    layouts = counted.groupBy("host", "layout").agg(F.any_value("paths").alias("paths"))
    candidates = layouts.select("host", "layout", F.explode("paths").alias("best"), F.pmod("layout", F.lit(SALTS)).cast("int").alias("salt"))
    salted = votes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = candidates.join(salted, ["host", "best", "salt"])
    won = met.groupBy("host", "layout").agg(F.max(F.struct("votes", "depth", (-F.col("best")).alias("order"), "best", "path")).alias("won"))
    found = written(won.select("host", "layout", F.col("won.best").alias("winner"), F.col("won.path").alias("winning")), "winners")
    discard(counted, votes)
    return found


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, host and path (of the containers that text comes from) of every page.

    text has the article's blocks, one a line, white space in them made one space; it is empty where a page has none. A
    null html counts as empty. A page whose url is null or has no host neither votes nor is voted for: its own best
    container holds. Repeated rows vote and return each, other columns are ignored, an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    salted = winners(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    read = rows.mapInArrow(readings, READ)
    chosen = read.join(salted, ["host", "layout", "salt"], "left")
    named = chosen.select("page_id", "url", "host", F.coalesce("winning", "path").alias("path"), "blocks", "containers", F.coalesce("winner", "best").alias("winner"))
    return named.mapInArrow(extracted, TEXT).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "host", "path")
