"""Encoding, fingerprints, suffix dedup, packing, licences, SimHash and shards against brute force."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from tokenizers import Tokenizer

from hustings.llm import encoding, imatch, licences, packing, sharding, simhash, suffixes
from hustings.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    found.no_truncation()
    found.no_padding()
    return found


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def multiset(rows):
    return Counter(map(tuple, rows))


def test_encoding_is_that_of_the_library(spark, awkward, tokenizer):
    expected = Counter()
    for r in awkward.collect():
        ids = ids_of(tokenizer, r.text)
        expected[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert multiset(encoding.encode_digests(awkward, word_vocabulary()).collect()) == expected


def test_round_trip_of_ids(spark, awkward, tokenizer):
    ids = encoding.encode(awkward, word_vocabulary())
    got = multiset(encoding.decode(ids, word_vocabulary()).collect())
    assert got == Counter((r.doc_id, tokenizer.decode(ids_of(tokenizer, r.text), skip_special_tokens=False)) for r in awkward.collect())


def test_joins_without_agreement_are_encoded_again(tokenizer):
    encode = encoding.encoder(word_vocabulary())
    data = b"one two three four five six seven"
    wrong = [(4, 24, b"\1\0\0\0")]  # ids that the text does not have
    assert encoding.joined(encode, data, wrong) == encode.ids(data.decode())


def signed(h):
    return h - (h >> 63 << 64)


def terms_of(text):
    return {signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def subsets_of(term):
    first = xxhash.xxh64_intdigest(struct.pack("<q", term), seed=42)
    return {k for k in range(imatch.SUBSETS) if signed(xxhash.xxh64_intdigest(struct.pack("<i", k), seed=first)) % (8 << k % imatch.DENSITIES) == 0}


def imatch_of(text, lexicon):
    row = []
    for k in range(imatch.SUBSETS):
        mine = sorted(t for t in terms_of(text) if k in lexicon.get(t, ()))
        h = 42
        for t in mine:
            h = xxhash.xxh64_intdigest(struct.pack("<q", t), seed=h)
        row.append(f"{h:X}" if mine else "-")
    return row


def imatch_likeness(a, b, same):
    told = [(x, y) for x, y in zip(a, b, strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in told) / len(told) if told else float(same)


def test_imatch_against_brute_force(spark, awkward):
    tie = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), seed=42))
    rows = sorted(((r.doc_id is None, -(r.doc_id or 0), tie(r.text or ""), r.doc_id, r.text or "") for r in awkward.collect()), key=lambda x: x[:3])
    texts = [r[4] for r in rows]
    counts = Counter(t for text in texts for t in terms_of(text))
    lexicon = {t: subsets_of(t) for t, n in counts.items() if max(2, imatch.LEAST_SHARE * len(texts)) <= n <= imatch.MOST_SHARE * len(texts)}
    expected = Counter()
    for i, text in enumerate(texts):
        after = texts[(i + 1) % len(texts)]
        edit = len(text) // 3
        edited = text[: len(text) - edit] + after[:edit]
        a, b, c = (imatch_of(t, lexicon) for t in (text, edited, after))
        expected[(rows[i][3], len(text), hashlib.sha256(edited.encode()).hexdigest(), ".".join(a), ".".join(b), imatch_likeness(a, b, text == edited), imatch_likeness(a, c, text == after))] += 1
    got = imatch.fingerprints(awkward).collect()
    assert multiset(got) == expected
    by = {r.doc_id: r.fingerprint for r in got}
    assert by[3] == by[105] == by[106] and by[1] != by[2]


def test_imatch_buckets_do_not_matter(spark, awkward, monkeypatch):
    one = multiset(imatch.fingerprints(awkward).collect())
    monkeypatch.setattr(imatch, "BUCKET_ROWS", 5)
    assert multiset(imatch.fingerprints(awkward).collect()) == one


def brute_removal(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        spans = [(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1]
        kept, number = suffixes.cut_out(t, spans)
        yield len(t), len(t) - len(kept), number, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize(("range_rows", "length"), [(8000, 400), (16, 400), (3, 64), (2, 150)])
def test_suffix_dedup_removes_exactly_what_repeats(spark, awkward, range_rows, length):
    rows = awkward.collect()
    expected = Counter((r.doc_id, *x) for r, x in zip(rows, brute_removal([(r.text or "").encode() for r in rows], length), strict=True))
    assert multiset(suffixes.remove_digests(awkward, length, range_rows).collect()) == expected
    assert sum(x[2] * n for x, n in expected.items()) > 0


@pytest.mark.parametrize("range_rows", [8000, 16, 2])
def test_suffix_dedup_of_hot_lines_and_passages(spark, range_rows):
    """One line and one passage in most documents, between different words: their suffixes fill many ranges."""
    rnd = np.random.default_rng(9)
    say = lambda n: "".join(chr(97 + x) for x in rnd.integers(0, 3, n))
    line, passage = say(70), say(130)
    texts = [say(40) + line + say(60) for _ in range(60)] + [say(rnd.integers(1, 9)) + passage + say(rnd.integers(1, 9)) for _ in range(60)] + [say(50) + passage[int(rnd.integers(0, 40)) : 110] + say(30) for _ in range(60)]
    texts += ["a" * int(n) for n in rnd.integers(90, 300, 20)] + [("ab" * 150)[: int(n)] for n in rnd.integers(90, 300, 20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected = Counter((i, *x) for i, x in enumerate(brute_removal([t.encode() for t in texts], 100)))
    assert multiset(suffixes.remove_digests(docs, 100, range_rows).collect()) == expected


def test_packing_places_every_piece_once(spark, awkward, tokenizer):
    expected = Counter()
    for r in awkward.collect():
        ids = [*ids_of(tokenizer, r.text), 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start : start + 4096]
            expected[(r.doc_id, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes()))] += 1
    got = packing.pack(awkward, word_vocabulary()).collect()
    assert Counter(tuple(r)[:5] for r in got) == expected
    bins: dict = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert bins.get(r.sequence_id, 0) == r.offset
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096
    assert len(bins) <= 1.1 * sum(bins.values()) / 4096 + 1


@pytest.mark.parametrize("counts", [{}, {1: 5}, {4096: 3, 1: 1}, {2048: 5}, {1366: 7, 1365: 7}, {3000: 4, 1000: 5, 96: 9, 5: 400}])
def test_plans_place_all_lengths(counts):
    segments, sequences = packing.plan(counts, 4096)
    held = Counter()
    used: dict = {}
    for length, first, number, sequence, offset in segments.tolist():
        assert held[length] == first
        held[length] += number
        for k in range(number):
            used.setdefault(sequence + k, []).append((offset, length))
    assert held == Counter(counts) and len(used) == sequences
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def simhash_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("split_above", [2048, 1])
def test_simhash_components(spark, awkward, monkeypatch, split_above):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.MOST_BITS, split_above))
    rows = [(r.doc_id, simhash_of(r.text)) for r in awkward.collect()]
    fps = sorted({fp for _, fp in rows})
    rnd = np.random.default_rng(1)
    root = {fp: fp for fp in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    names: dict = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            names[find(fp)] = min(names.get(find(fp), doc_id), doc_id)
    assert multiset(simhash.near_duplicates(awkward).collect()) == Counter((i, f"{fp:016x}", names.get(find(fp))) for i, fp in rows)
    assert rnd is not None


def test_links_of_chains_and_hot_keys(spark, monkeypatch):
    """Fingerprints in chains of two-bit steps, and many that share a key."""
    base = 0x0123456789ABCDEF
    chain, at = [base], base
    for i in range(0, 40, 2):
        at ^= 3 << i
        chain.append(at)
    near = [(base ^ (1 << 63) ^ (1 << i)) for i in range(20)]
    fps = sorted({x - (x >> 63 << 64) for x in chain + near})
    table = spark.createDataFrame([(x,) for x in fps], "fp long")
    found = simhash.components(simhash.links(table, split_above=3)).collect()
    expected = {x: x for x in fps}

    def find(x):
        while expected[x] != x:
            x = expected[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                expected[max(find(a), find(b))] = min(find(a), find(b))
    linked = {x for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for x in (a, b)}
    assert {(r.node, r.root) for r in found} == {(x, find(x)) for x in linked}


def test_shards_are_even_and_keep_groups(spark, awkward):
    got = sharding.shard(awkward, 5).collect()
    expected = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in awkward.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == expected
    shards: dict = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and set(shards) <= set(range(5))
    assert len({r.shard for r in got if r.doc_id in (3, 105, 106)}) == 1


def test_water_level():
    assert sharding.water_level([5, 0, 3], 4) == [0, 4, 0]
    assert sharding.water_level([5, 0, 3], 10) == [1, 6, 3]
    assert sum(sharding.water_level([1, 1, 1], 5)) == 5


def test_licence_places(spark, awkward):
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for r, got in zip(awkward.orderBy("doc_id", "text").collect(), licences.scan(awkward).orderBy("doc_id", "n_words").collect(), strict=True):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), r.text or ""))
        places = sorted((i, label) for label, p in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        if r.doc_id is None:
            continue
        assert (got.doc_id, got.n_words, got.n_base) == (r.doc_id, len(words), len(places))
        assert (got.first_word, got.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got.base_labels == ",".join(sorted({x for _, x in places}))
    by = {r.doc_id: r for r in licences.scan(awkward).collect()}
    assert by[110].labels == "gpl" and 0 < by[110].score < 1 and by[109].score == 1.0 and by[0].score == 0.0


@pytest.mark.parametrize("name", ["encode", "imatch", "suffix", "pack", "simhash", "shard", "licence"])
def test_empty_tables(spark, nothing, name):
    run = {
        "encode": lambda d: encoding.encode_digests(d, word_vocabulary()), "imatch": imatch.fingerprints, "suffix": suffixes.remove_digests, "pack": lambda d: packing.pack(d, word_vocabulary()),
        "simhash": simhash.near_duplicates, "shard": sharding.shard, "licence": licences.scan,
    }[name]
    assert run(nothing).collect() == []
