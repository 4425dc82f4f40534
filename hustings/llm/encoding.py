"""BPE encoding and decoding: content-defined chunk reuse.

A rolling hash over the bytes of every text cuts it into chunks whose ends depend on nearby content alone, so the same
passage gives the same chunks in whatever document it stands. Chunks that occur more than once are encoded once, at
their first place, and the ids travel to every other place; what is not shared is encoded where it stands.

A chunk ends anywhere, so the tokens beside its ends mean nothing. Its ids are kept for its core only, from its first to
its last space. The text between two cores, one more word of each core included, is encoded anew at the join; the ids of
these extra words must agree with those that the cores bring. As long as they don't, the join grows by the whole core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import discard, small_batches, text_or_empty, written
from hustings.llm.tokens import PieceEncoder, encoder

#: The rolling hash looks at so many bytes.
WINDOW = 16
#: A chunk ends where the low bits of the rolling hash are all zero; so many bytes on average.
CHUNK_BYTES = 512

REFS = "h binary, row binary, start int, stop int"


def chunk_ends(data: bytes) -> np.ndarray:
    """Offsets, in order, at which content-defined chunks of UTF-8 bytes end; the last one is the length."""
    n = len(data)
    if n <= WINDOW:
        return np.array([n] if n else [], "i8")
    b = np.frombuffer(data, "u1")
    h, width = (b.astype("u8") + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while width < WINDOW:
        h = h[:-width] * np.uint64(pow(0x100000001B3, width, 1 << 64)) + h[width:]
        width *= 2
    at = np.flatnonzero((h >> np.uint64(40)) % np.uint64(CHUNK_BYTES) == 0) + WINDOW
    at = at[at < n]
    at = at[(b[at] & 0xC0) != 0x80]  # never inside a character
    return np.append(at, n)


def core(data: bytes, start: int, stop: int) -> tuple[int, int]:
    """From the first to the last space of a chunk, both spaces left out; (start, start) if there is no word between."""
    a = data.find(b" ", start, stop)
    b = data.rfind(b" ", start, stop)
    return (a + 1, b) if 0 <= a < b - 1 else (start, start)


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (row, doc_id, text) with the text compressed, as it is shuffled."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in small_batches(batches):
        texts = pa.array([press.compress(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["row", "doc_id", "packed"])


def chunk_refs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (row, text) to a row for each chunk that has a core: its hash and its place."""
    for batch in small_batches(batches):
        out: tuple[list, list, list, list] = ([], [], [], [])
        for row, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
            data, at = text.encode(), 0
            for stop in chunk_ends(data).tolist():
                a, b = core(data, at, stop)
                if b > a:
                    for column, value in zip(out, (xxhash.xxh3_128_digest(data[at:stop]), row, at, stop), strict=True):
                        column.append(value)
                at = stop
        kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["h", "row", "start", "stop"])


def core_encoder(vocabulary: str) -> Callable:
    """For mapInArrow: (packed, chunks: list of (h, start, stop)) to (h, ids) of each chunk's core."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, unpack = encoder(vocabulary).ids, zstandard.ZstdDecompressor()
        for batch in small_batches(batches):
            hs, out = [], []
            for text, chunks in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                data = unpack.decompress(text) if chunks else b""
                for c in chunks or ():
                    a, b = core(data, c["start"], c["stop"])
                    hs.append(c["h"])
                    out.append(ids(data[a:b].decode()))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary()), pa.array(out, pa.binary())], names=["h", "ids"])

    return run


def joined(encode: PieceEncoder, data: bytes, chunks: list[tuple[int, int, bytes]]) -> bytes:
    """The ids of a whole text. chunks: (start, stop, ids of the core) of its known chunks, in order."""
    out: list[bytes] = []
    at = 0  # the text before it is done
    held: tuple[int, int, bytes] | None = None  # the core on the left of the join: start, stop, ids

    def words_at(a: int, b: int, last: bool) -> tuple[int, bytes]:
        """Where the last (first) word of a core begins (ends), and its ids."""
        edge = (data.rfind(b" ", a, b) + 1 or a) if last else data.find(b" ", a, b)
        edge = b if edge < 0 else edge
        return edge, encode.ids((data[edge:b] if last else data[a:edge]).decode())

    for start, stop, ids in [*chunks, (len(data), len(data), b"")]:
        a, b = core(data, start, stop) if start < stop else (start, start)
        left, left_ids = words_at(*held[:2], last=True) if held else (at, b"")
        right, right_ids = words_at(a, b, last=False) if b > a else (a, b"")
        new = encode.ids(data[left:right].decode())
        fits = (not held or held[2].endswith(left_ids)) and ids.startswith(right_ids)
        if fits and new.startswith(left_ids) and new.endswith(right_ids):
            out += [held[2]] if held else []
            out.append(new[len(left_ids) : len(new) - len(right_ids)])
            held, at = ((a, b, ids), b) if b > a else (None, a)
        else:  # no agreement: all up to this core is encoded again, in one piece
            out = [encode.ids(data[: b or a].decode())]
            held, at = None, b or a
    return b"".join(out)


def assembler(vocabulary: str, digest: Callable[[PieceEncoder, bytes], tuple], kinds: list[tuple[str, pa.DataType]]) -> Callable:
    """For mapInArrow: (doc_id, packed, chunks: list of (start, stop, ids)) to doc_id and digest's columns of the ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, unpack = encoder(vocabulary), zstandard.ZstdDecompressor()
        for batch in small_batches(batches, 256):
            rows = []
            for text, chunks in zip(*(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                known = sorted({c["start"]: (c["start"], c["stop"], c["ids"]) for c in chunks or ()}.values())
                rows.append(digest(encode, joined(encode, unpack.decompress(text), known)))
            cols = [pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *(n for n, _ in kinds)])

    return run


def raw_ids(encode: PieceEncoder, ids: bytes) -> tuple:
    return (np.frombuffer(ids, "<u4").tolist(),)


def digests(encode: PieceEncoder, ids: bytes) -> tuple:
    """Number of ids, SHA-256 of the decimal ids and of the decoded text."""
    numbers = np.frombuffer(ids, "<u4").tolist()
    decimal = " ".join(map(encode.decimals.__getitem__, numbers))
    return len(numbers), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(encode.decode(numbers).encode()).hexdigest()


def _encoded(docs: DataFrame, vocabulary: str, digest: Callable, schema: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    key = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text"))))
    texts = texts.select(key.alias("row"), "doc_id", "text")
    refs = written(texts.select("row", "text").mapInArrow(chunk_refs, REFS), "chunks")
    # Only chunks that occur again go on; written before the join, so that Spark can split the places of very common ones.
    again = written(refs.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "again")
    places = written(refs.join(again, "h", "left_semi"), "shared")
    discard(refs, again)
    # A chunk's first place is by row key; only there it is encoded, and only to the other places its ids travel.
    shared = places.groupBy("h").agg(F.min(F.struct("row", "start", "stop")).alias("first"))
    rows = texts.mapInArrow(packed, "row binary, doc_id long, packed binary").repartition("row")
    owners = shared.select("h", "first.*").groupBy("row").agg(F.collect_list(F.struct("h", "start", "stop")).alias("chunks"))
    # Both joins keep all rows, so that they read one shuffle of the texts.
    own = rows.join(owners, "row", "left").select("packed", "chunks", "doc_id").mapInArrow(core_encoder(vocabulary), "h binary, ids binary")
    cores = own.groupBy("h").agg(F.first("ids").alias("ids"))
    known = places.join(shared, "h").where("row != first.row or start != first.start").join(cores, "h")
    given = known.groupBy("row").agg(F.collect_list(F.struct("start", "stop", "ids")).alias("chunks"))
    return rows.join(given, "row", "left").select("doc_id", "packed", "chunks").mapInArrow(assembler(vocabulary, digest, kinds), schema)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array<long>) of every document, as the tokenizers library gives them without special tokens.

    A null text counts as empty and has no ids; a null doc_id stays null; repeated rows give repeated rows; columns
    other than doc_id and text are ignored; an empty table gives an empty result.
    """
    return _encoded(docs, vocabulary, raw_ids, "doc_id long, ids array<long>", [("ids", pa.list_(pa.int64()))])


def decode(ids: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids): the tokenizer's decode(ids, skip_special_tokens=False). Null ids are none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = encoder(vocabulary)
        for batch in small_batches(batches):
            texts = [names.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As encode() and decode() of its ids, but only doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _encoded(docs, vocabulary, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", kinds)
