"""Nearest vectors by cells against all pairs, on data that cells suit and data that they do not."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harborlight.operators import neighbours


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, embedding array<float>")


def plain(x, q, k):
    x, q = x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    out = {}
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(1))
        out[i] = [(int(j), round(float(d[j]), 9)) for j in np.lexsort((np.arange(len(x)), d))[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.id, round(r.distance, 9)))
    return out


def clusters(rnd, n, dim, groups):
    return rnd.normal(size=(groups, dim))[rnd.integers(0, groups, n)] * 40 + rnd.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "line", "one"])
@pytest.mark.parametrize("k,slice_rows", [(1, 50_000), (10, 37)])
def test_equal_to_all_pairs(spark, kind, k, slice_rows):
    rnd = np.random.default_rng(7)
    x = {
        "clusters": lambda: clusters(rnd, 3000, 8, 30), "noise": lambda: rnd.normal(size=(2000, 16)), "copies": lambda: np.vstack([np.ones((900, 4)), rnd.normal(size=(300, 4))]),
        "line": lambda: np.arange(1500.0)[:, None] * np.ones((1, 3)), "one": lambda: rnd.normal(size=(1, 5)),
    }[kind]()
    q = np.vstack([x[: 12], x[:8] + rnd.normal(size=x[:8].shape), x[:1] * 0 + 1000])
    assert got(neighbours.nearest(frame(spark, q, "query_id"), frame(spark, x), k, slice_rows)) == plain(x, q, k)


def test_clustered_queries_visit_few_rows(spark):
    rnd = np.random.default_rng(8)
    x = clusters(rnd, 20000, 8, 40)
    cells = neighbours.Cells(frame(spark, x))
    queries = frame(spark, x[:200], "query_id")
    assert got(cells.nearest(queries, 5)) == plain(x, x[:200], 5)
    rows = {i: int(n) for i, n in enumerate(cells.rings.rows)}
    first = neighbours.visits(queries, cells.rings, 5).collect()
    near = neighbours.ranked(neighbours.compared(cells.rows, neighbours.visits(queries, cells.rings, 5), 5), 5)
    reach = near.groupBy("query_id").agg(F.max("distance").alias("reach"))
    more = neighbours.visits(queries.join(reach, "query_id"), cells.rings, 5).collect()
    assert sum(rows[r.ring] for r in first + more) < 0.2 * 200 * len(x)
    assert not {(r.id, r.ring) for r in first} & {(r.id, r.ring) for r in more}


def test_a_large_ring_is_several_tasks(spark):
    cells = neighbours.Cells(frame(spark, np.ones((500, 3))), slice_rows=50)
    sizes = [r["count"] for r in cells.rows.groupBy("ring", "task").count().collect()]
    assert sum(sizes) == 500 and max(sizes) < 100


def test_no_rows_and_nulls(spark):
    none = spark.createDataFrame([], "id long, embedding array<float>")
    some = spark.createDataFrame([(1, None), (2, [0.0, 1.0]), (3, [5.0, 1.0])], "id long, embedding array<float>")
    asked = some.withColumnRenamed("id", "query_id")
    assert neighbours.nearest(asked, none, 3).count() == 0
    assert got(neighbours.nearest(asked, some, 3)) == {2: [(2, 0.0), (3, 5.0)], 3: [(3, 0.0), (2, 5.0)]}
    assert neighbours.nearest(asked.limit(0), some, 3).count() == 0


class Local:
    """Stands for a DataFrame whose steps do not matter; mapInArrow hands its function back."""

    columns = ["query_id", "embedding", "reach"]
    select = unionByName = repartition = sortWithinPartitions = lambda self, *a: self

    def mapInArrow(self, run, schema):
        return run


def batch(ids, x, **more):
    values = pa.array(x.astype(np.float32).ravel())
    return pa.RecordBatch.from_pydict({**more, "id": pa.array(ids, pa.int64()), "embedding": pa.ListArray.from_arrays(np.arange(len(x) + 1) * x.shape[1], values)})


def test_a_query_that_visits_all_rings_stays_in_small_batches(spark):
    rnd, cells = np.random.default_rng(9), 700
    rows = [{"cell": c, "ring": r, "least": r / 8, "most": (r + 1) / 8, "n": 100} for c in range(cells) for r in range(8)]
    rings = neighbours.Rings(SimpleNamespace(collect=lambda: rows), rnd.normal(size=(cells, 4)), 50_000)
    asked = batch(range(60), rnd.normal(size=(60, 4))).append_column("reach", pa.array(np.full(60, np.inf)))
    found = list(neighbours.visits(Local(), rings, 10)([asked]))
    seen = [(i, r) for b in found for i, r in zip(b.column(0).to_pylist(), b.column(2).to_pylist())]
    # all rings but the one that holds the first ten rows, each once
    assert len(seen) == len(set(seen)) == 60 * (8 * cells - 1)
    assert max(b.num_rows for b in found) <= 4096


def test_distances_are_made_in_small_matrices(spark, monkeypatch):
    rnd, sizes, plain_squares = np.random.default_rng(10), [], neighbours.squares
    monkeypatch.setattr(neighbours, "squares", lambda x, y: sizes.append(len(x) * len(y)) or plain_squares(x, y))
    x, q = rnd.normal(size=(9000, 3)), rnd.normal(size=(200, 3))
    key = lambda n, kind: {"ring": pa.array([0] * n, pa.int32()), "task": pa.array([0] * n, pa.int32()), "kind": pa.array([kind] * n, pa.int32())}
    out = neighbours.compared(Local(), Local(), 5)([batch(range(9000), x, **key(9000, 0)), batch(range(200), q, **key(200, 1))])
    have = {}
    for b in out:
        for i, j, d in zip(*(c.to_pylist() for c in b.columns)):
            have.setdefault(i, []).append((j, round(d, 9)))
    assert have == plain(x, q, 5)
    assert max(sizes) <= 1 << 19
    assert neighbours.SLICE <= 16_384
