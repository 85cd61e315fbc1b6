"""Spanning forests of op4: tiles and clusters in blocks against all pairs."""

import random

import numpy as np
import pytest

from harborlight.llm import jaccard_join as J
from harborlight.llm.common import prepare, whole_groups


def labels(count, pairs):
    label = list(range(count))
    for i, j in pairs:
        a, b = sorted((label[i], label[j]))
        label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("seed", range(6))
def test_spanning_connects_what_all_pairs_connect(seed):
    rnd = np.random.default_rng(seed)
    part = np.sort(rnd.integers(0, 5, 60))
    n = rnd.integers(20, 60, 60)
    order = np.lexsort((n, part))
    part, n = part[order], n[order]
    side, split = rnd.integers(0, 2, 60), part == 2
    linked = rnd.random((60, 60)) < 0.05
    calls = []

    def close(i, j):
        calls.extend(zip(i.tolist(), j.tolist()))
        return linked[i, j]

    a, b = J.spanning(part, n, side, split, 75, close)
    can = [(i, j) for i in range(60) for j in range(i + 1, 60) if part[i] == part[j] and 75 * n[j] <= 100 * n[i] and not (split[i] and side[i] == side[j])]
    assert labels(60, [(i, j) for i, j in can if linked[i, j]]) == labels(60, list(zip(a, b)))
    assert set(calls) <= set(can) and len(calls) == len(set(calls)) and all(linked[i, j] for i, j in zip(a, b))
    assert len(a) <= 60 - len(set(part.tolist()))


def test_overlaps_are_exact():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 300, k)).astype(np.uint64) for k in (1, 50, 200, 90, 3)]
    i, j = np.array([0, 0, 1, 2, 2]), np.array([1, 4, 3, 3, 4])
    assert J.overlaps(sets, i, j).tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(i, j)]
    assert len(J.overlaps(sets, i[:0], j[:0])) == 0


def test_blocks_lose_no_link(spark, monkeypatch):
    """Two families of near copies, larger than a block, and many that almost link."""
    monkeypatch.setattr(J, "BLOCK", 4)
    prepare(spark)
    rnd, vocabulary = random.Random(3), [f"v{i}" for i in range(5000)]
    bases = [rnd.sample(vocabulary, 90) for _ in range(2)]
    texts = []
    for k in range(70):
        words = list(bases[k % 2])
        for _ in range(rnd.choice((1, 2, 3, 4))):
            words[rnd.randrange(90)] = rnd.choice(vocabulary)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in J.jaccard_groups(docs).collect()}
    sets = [{tuple(t.split(" ")[i : i + 5]) for i in range(86)} for t in texts]
    pairs = [(i, j) for i in range(70) for j in range(i + 1, 70) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    assert got == dict(enumerate(labels(70, pairs)))
    assert len(set(got.values())) > 2


def test_forest_is_linear_in_the_members(spark):
    prepare(spark)
    rnd, vocabulary = random.Random(4), [f"v{i}" for i in range(5000)]
    base = rnd.sample(vocabulary, 60)
    rows = [(i, " ".join([*base[:40], *rnd.sample(vocabulary, 20)])) for i in range(200)]  # alike, never linked
    out = J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.doc_id == r.component_id for r in out) and len(out) == 200


def test_whole_groups_never_cut_a_group():
    import pyarrow as pa

    keys = sorted(random.Random(1).choices(range(30), k=500))
    table = pa.table({"k": keys, "v": list(range(500))})
    out = list(whole_groups(iter(table.to_batches(max_chunksize=7)), 0, limit=200))
    assert len(out) > 3 and pa.concat_tables(out).column("v").to_pylist() == list(range(500))
    sets = [set(t.column("k").to_pylist()) for t in out]
    assert sum(map(len, sets)) == len(set(keys))
    assert list(whole_groups(iter([]), 0)) == []
