"""The block-max index against complete scores, and how little of it a search reads."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborlight.operators import inverted


def corpus(seed, n=300):
    rnd = random.Random(seed)
    word = lambda: f"t{int(rnd.expovariate(0.03))}"
    docs = [(i, " ".join(word() for _ in range(rnd.choice((0, 3, 40, 120))))) for i in range(n)]
    queries = [(i, " ".join(word() for _ in range(rnd.choice((1, 4, 20))))) for i in range(25)] + [(90, ""), (91, "unheard"), (92, None)]
    return docs + [(n + i, t) for i, t in docs[:20]], queries


def scores(docs, queries):
    words = {i: Counter((t or "").lower().split()) for i, t in docs}
    df = Counter(t for c in words.values() for t in c)
    mean, out = sum(sum(c.values()) for c in words.values()) / len(words), {}
    for q, text in queries:
        for i, c in words.items():
            s = sum(max(0.0, math.log((len(words) - df[t] + 0.5) / (df[t] + 0.5))) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean)) for t in set((text or "").lower().split()) if t in c)
            if s > 0:
                out.setdefault(q, []).append((-round(s, 6), i, s))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("seed,range_docs,at_once", [(1, 1 << 16, 4096), (2, 64, 5)])
def test_best_and_near_best(spark, seed, range_docs, at_once):
    docs, queries = corpus(seed)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")
    index, want = inverted.build(d.repartition(7), chunk=64, window=4), scores(docs, queries)
    got = {}
    for r in inverted.best(q, index, 6, range_docs=range_docs, at_once=at_once).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    assert got == {k: [(i, round(s, 9)) for _, i, s in v[:6]] for k, v in want.items()}
    near = {}
    for r in inverted.near_best(q, index, 0.7, range_docs=range_docs, at_once=at_once).collect():
        near.setdefault(r.query_id, set()).add(r.doc_id)
    assert near == {k: {i for _, i, s in v if s >= 0.7 * max(x[2] for x in v) - 1e-9} for k, v in want.items()}


def test_searches_leave_most_postings_unread(spark):
    """200 queries for passages: of what their terms hold, most blocks are never opened."""
    rnd = random.Random(3)
    word = lambda: f"t{int(rnd.expovariate(0.002))}"
    passages = [" ".join(word() for _ in range(25)) for _ in range(200)]
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(6000)]
    for k, p in enumerate(passages):
        docs[rnd.randrange(6000)] = (6000 + k, docs[k][1] + " " + p)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(passages)), "query_id long, text string")
    index = inverted.build(d.coalesce(2))
    rows = inverted.search(q, index, top=1)
    seen, held = rows.agg(F.sum("seen"), F.sum("held")).first()
    assert 0 < seen < 0.25 * held
    assert rows.where("doc_id is not null").count() < 200 * 10  # no table of pairs


def test_a_frequent_term_is_many_rows(spark):
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("hot"), F.when(F.col("id") < 9000, F.lit("half")), F.col("id").cast("string")).alias("text"))
    index = inverted.build(d.coalesce(1))
    sizes = [r.holders for r in index.rows.where("term = 'hot'").collect()]
    assert sum(sizes) == 20000 and max(sizes) <= inverted.CHUNK
    q = spark.createDataFrame([(1, "hot half 8123")], "query_id long, text string")
    assert [r.doc_id for r in inverted.best(q, index, 2).orderBy("place").collect()] == [8123, 0]


def test_empty_tables(spark):
    d, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert inverted.best(q, inverted.build(d), 3).count() == 0
    some = spark.createDataFrame([(1, None), (2, "b c"), (None, "a")], "doc_id long, text string")
    assert inverted.best(q, inverted.build(some), 3).count() == 0
    assert inverted.best(q.limit(0), inverted.build(some), 3).count() == 0


def test_chunks_and_ranges_bound_a_worker(spark):
    """No row of the index has over 1024 documents, and no task's range over 16 such chunks on average."""
    d = spark.createDataFrame([(i, f"common w{i % 97}") for i in range(3000)], "doc_id long, text string").coalesce(1)
    index = inverted.build(d)
    sizes = [r.holders for r in index.rows.where("term = 'common'").collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 1024 and inverted.RANGE <= 16 * 1024


def test_a_range_has_4096_documents_on_average(spark):
    """Queries meet the postings of at most so many documents at once; each range tells what it held."""
    d = spark.range(20000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("hot"), F.when(F.col("id") % 3 == 0, F.lit("third")), F.col("id").cast("string")).alias("text"))
    q = spark.createDataFrame([(1, "third 8124"), (2, "unheard"), (3, "17 third")], "query_id long, text string")
    index = inverted.build(d)
    rows = inverted.search(q, index, top=2).where("doc_id is null").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum("held").alias("held")).collect()
    assert {r.query_id: r.n for r in rows} == {1: 5, 3: 5}
    assert {r.query_id: r.held for r in rows} == {1: 6668, 3: 6668}
    assert {(r.query_id, r.doc_id) for r in inverted.best(q, index, 2).collect()} == {(1, 8124), (1, 0), (3, 17), (3, 0)}
