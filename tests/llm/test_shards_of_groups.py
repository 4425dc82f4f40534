"""Groups of equal texts that fit a shard end whole, beside very large ones and where all shards start full."""

from __future__ import annotations

import pytest

from hustings.llm import sharding


@pytest.mark.parametrize("groups", [[2] * 1200, [1500, *[10] * 100, *[60] * 15, *[1] * 1000]])
def test_groups_that_fit_a_shard_stay_whole(spark, groups):
    texts = [f"text number {g:08d}" for g, n in enumerate(groups) for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shards: dict = {}
    loads = [0] * 8
    for r in sharding.shard(docs, 8).collect():
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
        loads[r.shard] += r["size"]
    share = sum(loads) // 8
    size = len(texts[0]) + 16
    assert [g for g, n in enumerate(groups) if n * size <= share and len(shards[f"text number {g:08d}"]) > 1] == []
    assert max(loads) - min(loads) <= 0.05 * share


def test_circulation():
    assert sharding.circulation([[0, 5], [3, 0]], [0, 0]) == [[0, 3], [3, 0]]
    assert sharding.circulation([[0, 5], [0, 0]], [0, 2]) == [[0, 2], [0, 0]]
    assert sharding.circulation([[0, 5], [3, 0]], [-3, 9]) == [[0, 5], [2, 0]]
