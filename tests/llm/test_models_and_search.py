"""Language, toxicity, nearest neighbours, components and the pipeline."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hustings.llm import language, neighbours, toxicity
from hustings.llm.common import table
from hustings.llm.components import components

FOLDER = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = table(spark, FOLDER, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = language.identify(docs).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.97 * len(out)


def test_language_of_awkward_texts(spark, awkward, nothing):
    got = language.identify(awkward).collect()
    assert len(got) == awkward.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0.0
    assert language.identify(nothing).collect() == []


def test_unseen_words_back_off_to_shorter_grams(spark):
    rows = [(i, t, lang, None, 0) for i, (t, lang) in enumerate([("der die das und nicht", "de"), ("the and that with", "en")] * 20)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    memo = language.Memo(2)
    assert model.predict("nichtund", memo)[0] == "de" and model.predict("withthat", memo)[0] == "en"
    assert model.predict("123 !!", memo) == ("und", 0.0) and model.predict("½ ² Ⅷ", memo) == ("und", 0.0)
    assert model.predict("½und", memo) == model.predict("und", memo)


def test_scores_are_those_of_the_formula(spark):
    """Against counting by hand: means of log frequencies, of known words and of the longest known n-grams."""
    texts = [("der der die und", "de"), ("the the and of", "en"), ("die der und", "de"), ("of the and", "en")]
    model = language.train(spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string"))
    tongues = ["de", "en"]

    def table(units, least):
        counts = {x: Counter(u for t, lang in texts if lang == x for w in t.split() for u in units(w)) for x in tongues}
        kept = [u for u in set().union(*counts.values()) if sum(c[u] for c in counts.values()) >= least]
        return {u: [math.log((counts[x][u] + 1) / (sum(counts[x].values()) + max(1, len(kept)))) for x in tongues] for u in kept}

    words = table(lambda w: [w], language.LEAST_WORD)
    grams = {n: table(lambda w, n=n: [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)], language.LEAST_GRAM) for n in range(1, 5)}

    def row(word):
        if word in words:
            return words[word]
        marked, rows = f"<{word}>", []
        for i in range(len(marked) - 1):
            rows.append(next((grams[n][marked[i : i + n]] for n in (4, 3, 2, 1) if len(marked[i : i + n]) == n and marked[i : i + n] in grams[n]), [model.floor] * 2))
        return np.mean(rows, axis=0)

    for text in ["der the", "derthe odd", "und", "xq of", "and die und zz"]:
        mean = np.mean([row(w) for w in text.split()], axis=0)
        weight = np.exp((mean - mean.max()) * min(len(text.split()), language.EVIDENCE_WORDS))
        assert model.predict(text, language.Memo(2, most=1)) == (tongues[int(mean.argmax())], pytest.approx(weight.max() / weight.sum()))


def test_toxicity_of_held_out_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.score(docs, labels).collect()
    out = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    right, caught, real = sum(p and t for p, t in out), sum(p for p, _ in out), sum(t for _, t in out)
    # A fifth of the label 1 documents there have no word that tells them from label 0 ones.
    assert right >= 0.85 * caught and right >= 0.6 * real


@pytest.fixture(scope="module")
def model():
    found = toxicity.Model({"idiot": 0.95, "moron": 0.95, "lowe*": 0.9})
    for word in ["idiot"] * 50 + ["moron"] * 50 + ["that", "those", "morning", "radio", "a"] * 10:
        marked = f"^^{word}$"
        for i in range(len(marked) - 2):
            a, b, c = marked[i : i + 3]
            for key in (a + b + c, b + c, c, a + b + "_", b + "_", ""):
                found.grams[key] = found.grams.get(key, 0) + 1
    return found


@pytest.mark.parametrize("text", ["idiot", "1d10t", "i d i o t", "i.d.i.o.t", "idiooot", "what an 1di0t!", "IDIOT,", "m0r0n", "you are a i d i o t", "t h a t i d i o t", "i d i o t t h a t m o r o n"])
def test_hidden_words_are_found(model, text):
    assert model.score(text, {}) > 0.7


@pytest.mark.parametrize("text", ["", "radio that", "12 34", "a@b.c", "x" * 5000, "1 2 3 4 5"])
def test_clean_texts_stay_clean(model, text):
    assert model.score(text, {}) < 0.1


def test_beginnings_give_way_to_what_is_more_specific():
    units = {"lose*": (0.8, 50), "loser": (0.9, 48), "loser*": (0.9, 48), "vequ*": (0.9, 50), "vequa*": (0.9, 20), "vequa": (0.9, 10)}
    assert set(toxicity.specific(units)) == {"loser", "vequ*", "vequa*", "vequa"}


def test_toxicity_without_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (5555, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(round(r.score, 9), r.predicted) for r in toxicity.score(awkward, labels).collect()} == {(toxicity.PRIOR, 0)}
    assert toxicity.score(nothing, labels).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, v int, part string"


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rnd = np.random.default_rng(3)
    v = rnd.standard_normal((1500, 24)).astype("f4")
    v[100:160] = v[100]  # equal vectors: ties
    rows = [(i, x.tolist(), 0, 1, "p") for i, x in enumerate(v)]
    rows += [(2000, None, 0, 1, "p"), (2020, [0.0] * 24, 0, 1, "p"), (2040, [float("nan")] + [1.0] * 23, 0, 1, "p"), (2060, [float("inf")] + [1.0] * 23, 0, 1, "p"), (2080, [None] + [1.0] * 23, 0, 1, "p"), (None, [1.0] * 24, 0, 1, "p")]
    found: dict = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, VECTORS)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 1500, 20))
    wide, hit = v.astype("f8"), 0
    for q, got in found.items():
        score = (wide * wide[q]).sum(axis=1)
        best = [i for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]
        got = sorted(got)
        assert [x[0] for x in got] == list(range(1, 21)) and all(x[2] == pytest.approx(score[x[1]], abs=1e-9) for x in got)
        hit += len({x[1] for x in got} & set(best))
    assert hit >= 0.9 * 20 * len(found)
    assert [x[1] for x in sorted(found[100])] == list(range(101, 121))


def test_recall_of_the_lists_alone(spark):
    """No references here, so all answers come from probed lists, by the scan; vectors of another length take no part."""
    rnd = np.random.default_rng(4)
    middles = rnd.standard_normal((40, 32)) * 1.5
    v = (middles[rnd.integers(0, 40, 24_000)] + rnd.standard_normal((24_000, 32))).astype("f4")
    v[1000:4000] = v[1000]  # one vector in an eighth of all rows
    rows = [(i, x.tolist(), 0, 1, "p") for i, x in enumerate(v)] + [(100_000 + i, [9.0] * (31 - i % 2), 0, 1, "p") for i in range(60)]
    got = neighbours.nearest(spark.createDataFrame(rows, VECTORS).repartition(8), references=0).toPandas()
    asked = np.arange(0, 24_000, 20)
    assert set(got.query_id) == set(asked.tolist()) and got.vec_id.max() < 24_000
    wide = v.astype("f8")
    score = wide[asked] @ wide.T
    score[np.arange(len(asked)), asked] = -np.inf
    worst = np.partition(-score, 19, axis=1)[:, 19]
    near = -got.score.to_numpy() <= worst[got.query_id.to_numpy() // 20] + 1e-9
    assert near.sum() >= 0.9 * 20 * len(asked)


def test_neighbours_of_few_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 1, "p"), (1, [0.5, 0.5], 0, 1, "p"), (20, [2.0, 0.0], 0, 1, "p")], VECTORS)
    assert sorted(tuple(r) for r in neighbours.nearest(few).collect()) == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (20, 1, 0, 2.0), (20, 2, 1, 1.0)]
    assert neighbours.nearest(spark.createDataFrame([], VECTORS)).collect() == []


def test_components_of_random_graphs(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (500, 500)]
    root: dict = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def test_pipeline_stages(spark, awkward):
    import corpus_pipeline as pipeline

    docs = table(spark, FOLDER, "documents")
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    left = {}
    for name, stage in pipeline.STAGES[:4]:
        docs = pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == list(pipeline.COLUMNS)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left[name] <= seen
        seen = left[name]
    assert left["suffixes"] == left["near_duplicates"] and len(left["language"]) >= 990
    packed = pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == seen


def test_suffix_stage_keeps_whole_characters(spark):
    import corpus_pipeline as pipeline

    part = "ßé" * 150
    rows = [(1, "a" + part + "zz", "de", None, 3), (2, "b" + part + "yy", "de", None, 3), (3, None, "de", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.suffix_stage(spark, docs, FOLDER).collect()}
    assert got == {1: ("azz", 3), 2: ("byy", 3), 3: (None, None)}


def test_languages_are_learnt_from_all_documents(spark):
    """More documents of a language than any bound that a sample had; every place counts."""
    rows = [(i, f"the {'rare' if i % 1000 == 0 else 'and'}", "en") for i in range(6000)] + [(6000 + i, "der und", "de") for i in range(10)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert model.languages == ["de", "en"]
    de, en = model.words.get("the")
    assert (de, en) == pytest.approx((math.log(1 / (20 + 5)), math.log(6001 / (12_000 + 5))))
    assert model.words.get("rare")[1] == pytest.approx(math.log(7 / 12_005)) and model.words.get("unseen") is None
