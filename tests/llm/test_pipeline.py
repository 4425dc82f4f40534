"""The kept rows and texts of each stage against brute force, given the models; nulls, repeated rows, empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from test_near_copies import sets_of
from test_text_operators import brute_removal

import corpus_pipeline as pipeline
from hustings.llm import language, suffixes, toxicity
from hustings.llm.common import table

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def mixed(spark, awkward):
    """The awkward rows beside real documents, and near copies of some."""
    real = table(spark, FOLDER, "documents").where("doc_id < 150").select(*pipeline.COLUMNS)
    again = real.where("doc_id < 40").selectExpr("doc_id + 5000", "concat(text, ' and a few words more')", "lang", "source", "n_chars")
    return awkward.select(*pipeline.COLUMNS).union(real).union(again).repartition(3).persist()


def rows_of(docs):
    return Counter(map(tuple, docs.select(*pipeline.COLUMNS).collect()))


def test_language_stage(spark, mixed):
    model = language.train(mixed.where(~language.held_out(mixed.doc_id, 5, 0)))
    memo = language.Memo(len(model.languages))

    def stays(text):
        told, score = model.predict(text or "", memo)
        return told != language.UNKNOWN and score >= pipeline.LEAST_LANGUAGE_SCORE

    assert rows_of(pipeline.language_stage(spark, mixed, FOLDER)) == Counter({r: n for r, n in rows_of(mixed).items() if stays(r[1])})


def test_toxicity_stage(spark, mixed):
    model = toxicity.train(mixed, table(spark, FOLDER, "labels"))
    kept = Counter({r: n for r, n in rows_of(mixed).items() if model.score(r[1] or "", {}) < toxicity.PREDICT_AT})
    assert rows_of(pipeline.toxicity_stage(spark, mixed, FOLDER)) == kept


def test_near_duplicate_stage(spark, mixed):
    rows = [tuple(r) for r in mixed.collect()]
    sets, root = [sets_of(r[1]) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups: dict = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    got = rows_of(pipeline.near_duplicate_stage(spark, mixed, FOLDER))
    assert sum(got.values()) == len(groups) < len(rows)
    for members in groups.values():
        stays = min((r[0] is None, r[0] or 0) for r in members)
        assert sum(got[r] for r in set(members)) == 1 and any(got[r] for r in members if (r[0] is None, r[0] or 0) == stays)


def test_suffix_stage(spark, mixed):
    rows = [tuple(r) for r in mixed.collect()]
    texts = [(r[1] or "").encode() for r in rows]
    assert max(map(len, texts)) > pipeline.PASSAGE_BYTES
    seen = Counter(t[i : i + pipeline.PASSAGE_BYTES] for t in texts for i in range(len(t) - pipeline.PASSAGE_BYTES + 1))
    expected: Counter = Counter()
    for r, t in zip(rows, texts, strict=True):
        spans = [(i, i + pipeline.PASSAGE_BYTES) for i in range(len(t) - pipeline.PASSAGE_BYTES + 1) if seen[t[i : i + pipeline.PASSAGE_BYTES]] > 1]
        text = r[1] if r[1] is None else suffixes.cut_out(t, spans)[0].decode(errors="ignore")
        expected[(*r[:1], text, *r[2:4], None if text is None else len(text))] += 1
    assert rows_of(pipeline.suffix_stage(spark, mixed, FOLDER)) == expected
    assert sum(x[1] for x in brute_removal(texts, pipeline.PASSAGE_BYTES)) > 0


def test_stages_of_an_empty_table(spark, nothing):
    docs = nothing.select(*pipeline.COLUMNS)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, FOLDER).collect() == []
