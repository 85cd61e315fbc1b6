"""Operator 12 against complete scores of every document, on random and awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from harborlight.llm import ranked_search
from harborlight.llm.common import prepare


def terms(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, q in asked.items():
        scored = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def table(spark, rows, name):
    prepare(spark)
    return spark.createDataFrame([(i, t, "x", 3, 4) for i, t in rows], f"{name} long, text string, terms string, shard int, score int")


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def corpus(seed, n=400):
    rnd = random.Random(seed)
    vocabulary = [f"t{int(rnd.expovariate(0.05))}" for _ in range(3000)]
    docs = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 5, 60, 200))))) for i in range(n)]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice((1, 3, 12))))) for i in range(30)]
    return docs, items


@pytest.mark.parametrize("seed,shard,at_once,few", [(1, 1 << 22, 4096, 64), (2, 1000, 7, 0), (3, 5000, 4096, 5)])
def test_same_ranks_as_all_scores(spark, monkeypatch, seed, shard, at_once, few):
    docs, items = corpus(seed)
    docs += docs[:30]
    monkeypatch.setattr(ranked_search, "FEW", few)
    assert got(ranked_search.ranked(table(spark, docs, "doc_id"), table(spark, items, "item_id"), shard=shard, queries_at_once=at_once)) == plain(docs, items)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "?!, --"), (4, "Alpha beta"), (5, "alpha BETA"), (5, "alpha BETA"), (None, "alpha beta"), (6, "é日本　x alpha"), (7, "gamma " * 5000), (8, "beta a_b a-b 1é2")]
    items = [(1, "ALPHA, alpha beta"), (2, None), (3, "..."), (4, "é日本　x"), (5, "nothing"), (None, "gamma"), (6, "b"), (1, "gamma")]
    d, i = table(spark, docs, "doc_id"), table(spark, items, "item_id")
    assert got(ranked_search.ranked(d, i)) == plain(docs, items)
    assert got(ranked_search.ranked(d.limit(0), i)) == [] == got(ranked_search.ranked(d, i.limit(0)))


def test_bounds_stop_early_and_change_nothing():
    """Few documents hold a rare term often; a frequent term's postings are then mostly left alone."""
    rnd = random.Random(5)
    docs, tf = 20000, np.array([rnd.choice((1, 1, 1, 2)) for _ in range(20000)])
    rare = np.array(rnd.sample(range(docs), 40))
    key = np.sort(rare)
    term, doc = np.concatenate((np.zeros(docs, int), np.ones(40, int))), np.concatenate((np.arange(docs), key))
    counts = np.concatenate((tf, np.full(40, 9)))
    packed = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((term, "<i4"), (doc, "<i4"), (counts, "<i8"))]
    lists = [pa.array([x]) for x in (np.arange(docs), np.full(docs, 100), ["the", "rare"])]
    shard = ranked_search.Shard(pa.table([*lists, *packed], ["docs", "lengths", "terms", "term", "doc", "tf"]), docs, 100 * docs)
    place, score = shard.search(["the", "rare"], np.array([5, 6000]), 10)
    assert shard.read < 0.3 * len(term)
    assert (score == shard.complete(place, np.array([0, 1]), np.array([5, 6000]))).all()
    every = shard.complete(np.arange(docs), np.array([0, 1]), np.array([5, 6000]))
    assert sorted(score)[-10:] == sorted(every)[-10:]
