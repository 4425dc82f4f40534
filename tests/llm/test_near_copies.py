"""Near copies against all pairs."""

from __future__ import annotations

import random

import pytest

from hustings.llm import components, nearcopies, simhash

FOLDER = "/root/testdata/sf0.01"


def sets_of(text):
    words = (text or "").lower().encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def edited(rnd, text, share):
    return " ".join("new" + str(rnd.randrange(10**6)) if rnd.random() < share else w for w in text.split())


@pytest.mark.parametrize("common_in", [3, 10**6])
def test_near_copies_are_all_pairs_at_the_bound(spark, awkward, monkeypatch, common_in):
    monkeypatch.setattr(nearcopies, "COMMON_IN", common_in)
    rnd = random.Random(11)
    say = lambda n: " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(300)) for _ in range(n))
    line = say(12)
    bases = [say(rnd.choice([4, 6, 9, 30, 80, 300])) for _ in range(30)]
    texts = bases + [edited(rnd, b, rnd.choice([0.01, 0.02, 0.03, 0.05])) for b in bases for _ in range(4)] + [f"{line} {say(20)}" for _ in range(20)] + [f"{b} {say(1 + len(b) // 40)}" for b in bases]
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + [(r.doc_id, r.text) for r in awkward.collect()]
    rnd.shuffle(rows)
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names: dict = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[find(i)] = min(names.get(find(i), doc_id), doc_id)
    expected = sorted(((d, names.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, least=0.8).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == expected


def test_rounds_of_components_write_few_files_where_partitions_stay_apart(spark, monkeypatch):
    files, write = [], components.written

    def seen(*given):
        table = write(*given)
        files.append(len(table.inputFiles()))
        return table

    monkeypatch.setattr(components, "written", seen)
    apart = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in apart}
    for k, v in apart.items():
        spark.conf.set(k, v)
    try:
        edges = spark.range(300).selectExpr("id * 7919 % 301 as u", "(id + 1) * 7919 % 301 as v")
        found = {(r.node, r.root) for r in components.components(edges).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == {(i, 0) for i in range(301)}
    assert len(files) > 3 and set(files[1:]) == {1}


def test_near_copies_of_nothing(spark, nothing):
    assert nearcopies.near_copies(nothing).collect() == []


def test_near_duplicate_stage_drops_texts_with_a_few_other_words(spark):
    import corpus_pipeline as pipeline

    words = [f"w{i}" for i in range(200)]
    other = [*words[:60], "x", *words[61:140], "y", *words[141:]]
    rows = [(1, " ".join(words), "en", None, 1), (2, " ".join(other), "en", None, 1), (3, " ".join(reversed(words)), "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()) == [1, 3]
