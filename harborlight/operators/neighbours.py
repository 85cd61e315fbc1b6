"""Exact nearest vectors (L2) through cells: the triangle inequality says which ones a query visits.

Centres are fitted on a bounded sample (SAMPLE rows by hash of the id); every row then belongs to
the cell of its nearest centre and, by its distance from that, to one of RINGS rings. A ring knows
its least and largest distance, so for a query at distance c from the centre no row of it is nearer
than c - largest or least - c. A query first visits the rings that may hold the nearest rows, until
they hold k; its k-th distance there bounds the answer, and only rings whose bound is not beyond it
are visited, too. The result is that of all pairs, whatever the data; what the data decides is how
many rings are left out. A ring of more than `slice_rows` rows is dealt to several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.sources.batches import small_batches
from harborlight.sources.folders import written

#: Rows that centres are fitted on, centres at most, rings of a cell, rows a task holds, queries in
#: one matrix product. The driver and each task know at most CENTRES * RINGS rings.
SAMPLE, CENTRES, RINGS, SLICE, QUERY_BLOCK = 8192, 1024, 8, 16_384, 256
#: Numbers of one matrix of distances or bounds, and visits (with the query's vector each) of one batch.
NUMBERS, VISITS = 1 << 19, 4096
STEPS = 8


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, by one product; rounding may leave them slightly off."""
    out = x @ y.T
    out *= -2
    out += norms(x)[:, None]
    out += norms(y)
    return np.maximum(out, 0, out=out)


def norms(x: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows."""
    return np.einsum("ij,ij->i", x, x)


def block_of(columns: int, most: int = QUERY_BLOCK) -> int:
    """How many rows of a matrix with so many columns are made at once."""
    return max(1, min(most, NUMBERS // max(1, columns)))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of paired rows, from their differences."""
    return np.sqrt(((x - y) ** 2).sum(1))


def centres(vectors: DataFrame) -> np.ndarray:
    """About a quarter of the root of the row count, by Lloyd steps on the sample."""
    rows = vectors.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # at most SAMPLE rows
    if not rows.num_rows:
        return np.zeros((0, 0))
    x = matrix(rows.column("embedding").combine_chunks())
    total = len(x) if len(x) < SAMPLE else vectors.count()
    n = min(CENTRES, len(x), max(1, int(total**0.5 / 4)))
    c = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(STEPS):
        near = squares(x, c).argmin(1)
        size = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return c


def celled(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """id, embedding, cell, radius of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1))
                step = block_of(len(c), len(x))
                cell = np.concatenate([squares(x[at : at + step], c).argmin(1) for at in range(0, len(x), step)])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distances(x, c[cell]))], ["id", "embedding", "cell", "radius"])

    return vectors.select("id", "embedding").mapInArrow(run, "id long, embedding array<float>, cell int, radius double")


class Rings:
    """cell, least and largest radius, rows and tasks of each ring; its number is its place."""

    def __init__(self, table: DataFrame, c: np.ndarray, slice_rows: int):
        rows = sorted(table.collect(), key=lambda r: (r["cell"], r["ring"]))  # at most CENTRES * RINGS rows
        self.c = c
        self.cell = np.array([r["cell"] for r in rows], np.int64)
        self.ring = np.array([r["ring"] for r in rows], np.int64)
        self.least, self.most = (np.array([r[x] for r in rows], float) for x in ("least", "most"))
        self.rows = np.array([r["n"] for r in rows], np.int64)
        self.tasks = -(-self.rows // slice_rows)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and ring, what no row of the ring is nearer than (a little less, for rounding)."""
        d = np.sqrt(squares(q, self.c))[:, self.cell]
        # the product's error in a squared distance, carried over to the distance
        slack = np.sqrt(1e-12 * (norms(q)[:, None] + norms(self.c)[self.cell] + 1))
        return np.maximum(np.maximum(d - self.most, self.least - d) - slack, 0)

    def first(self, bound: np.ndarray, k: int) -> np.ndarray:
        """Which rings each query visits first: by their bounds, until they hold k rows."""
        order = np.argsort(bound, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(bound.shape, bool)
        np.put_along_axis(out, order, held < k, axis=1)
        return out


def visits(queries: DataFrame, rings: Rings, k: int) -> DataFrame:
    """id, embedding, ring, task of the rings that the queries visit: first if there is no column
    `reach`, then those within reach that were not among the first. A query may visit all rings, so
    bounds and visits are made a few queries and VISITS rows at a time."""
    second = "reach" in queries.columns
    step = block_of(len(rings.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                bound = rings.bounds(matrix(piece.column(1)))
                go = rings.first(bound, k)
                if second:
                    go = ~go & (bound <= piece.column(2).to_numpy()[:, None])
                query, ring = np.nonzero(go)
                task = rings.tasks[ring]
                query, ring = np.repeat(query, task), np.repeat(ring, task)
                nth = np.arange(len(ring)) - np.repeat(np.cumsum(task) - task, task)
                for a in range(0, len(query), VISITS):
                    part = slice(a, a + VISITS)
                    yield pa.RecordBatch.from_arrays([*(piece.column(i).take(pa.array(query[part])) for i in (0, 1)), pa.array(ring[part].astype(np.int32)), pa.array(nth[part].astype(np.int32))], ["id", "embedding", "ring", "task"])

    columns = ["query_id", "embedding", *(["reach"] if second else [])]
    return queries.select(*columns).mapInArrow(run, "id long, embedding array<float>, ring int, task int")


def compared(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, id, distance of the k nearest rows of each visited (ring, task).

    A task holds its rows and streams the queries past them in blocks, one matrix product of at most
    NUMBERS distances each.
    The product only selects: candidates' distances are computed from the differences.
    """

    def best(ids: np.ndarray, x: np.ndarray, asked_ids: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        near = squares(q, x)
        keep = min(k, len(ids))
        limit = np.partition(near, keep - 1, axis=1)[:, keep - 1] + 1e-9 * (1 + norms(q) + norms(x).max())
        out = []
        for i in range(len(q)):
            at = np.flatnonzero(near[i] <= limit[i])
            distance = distances(x[at], q[i])
            order = np.lexsort((ids[at], distance))[:keep]
            out.append((np.full(len(order), asked_ids[i]), ids[at][order], distance[order]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []
        for batch in batches:
            ring, task, kind = (batch.column(i).to_numpy() for i in range(3))
            key = ring.astype(np.int64) << 32 | task
            edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]))) if batch.num_rows else []
            for a, b in zip(edges, [*edges[1:], batch.num_rows]):
                if key[a] != at:
                    at, ids, held = key[a], [], []
                part_ids, part = batch.column(3).slice(a, b - a).to_numpy(), matrix(batch.column(4).slice(a, b - a))
                if kind[a] == 0:
                    ids.append(part_ids)
                    held.append(part)
                elif held:
                    if len(held) > 1:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    step = block_of(len(ids[0]))
                    for i in range(0, len(part), step):
                        yield best(ids[0], held[0], part_ids[i : i + step], part[i : i + step])

    both = rows.select("ring", "task", F.lit(0).alias("kind"), "id", "embedding").unionByName(asked.select("ring", "task", F.lit(1).alias("kind"), "id", "embedding"))
    both = both.repartition("ring", "task").sortWithinPartitions("ring", "task", "kind", "id")
    return both.mapInArrow(run, "query_id long, id long, distance double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Cells:
    """The vectors (id, embedding) by ring, written once for any number of searches. Null vectors are
    left out; all others have one length."""

    def __init__(self, vectors: DataFrame, slice_rows: int = SLICE):
        small_batches(vectors.sparkSession)
        vectors = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
        c = centres(vectors)
        self.empty = not len(c)
        if self.empty:
            return
        rows = written(celled(vectors, c), "cells")
        reach = rows.groupBy("cell").agg(F.min("radius").alias("a"), F.max("radius").alias("b"))
        spans = {r["cell"]: (r["a"], r["b"]) for r in reach.collect()}  # at most CENTRES rows
        low, width = (F.create_map(*[F.lit(x) for cell, (a, b) in spans.items() for x in (cell, a if k == 0 else max(b - a, 1e-300))]) for k in (0, 1))
        ring = F.least(((F.col("radius") - low[F.col("cell")]) / width[F.col("cell")] * RINGS).cast("int"), F.lit(RINGS - 1))
        rows = rows.withColumn("in_cell", ring)
        sizes = rows.groupBy("cell", F.col("in_cell").alias("ring")).agg(F.min("radius").alias("least"), F.max("radius").alias("most"), F.count(F.lit(1)).alias("n"))
        self.rings = Rings(sizes, c, slice_rows)
        number = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(zip(self.rings.cell.tolist(), self.rings.ring.tolist())) for x in (a * RINGS + b, i)])
        tasks = F.array(*map(F.lit, self.rings.tasks.tolist()))
        rows = rows.withColumn("ring", number[F.col("cell") * RINGS + F.col("in_cell")])
        self.rows = rows.withColumn("task", F.pmod(F.xxhash64("id"), tasks[F.col("ring")]).cast("int")).select("id", "embedding", "ring", "task")

    def nearest(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id, distance, rank: the k nearest vectors of each query, ties to the smaller id."""
        queries = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
        if self.empty:
            return queries.sparkSession.createDataFrame([], "query_id long, id long, distance double, rank int")
        near = written(ranked(compared(self.rows, visits(queries, self.rings, k), k), k), "nearest")
        reach = near.groupBy("query_id").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n"))
        reach = reach.select("query_id", F.when(F.col("n") >= k, F.col("d")).otherwise(F.lit(float("inf"))).alias("reach"))
        more = compared(self.rows, visits(queries.join(reach, "query_id"), self.rings, k), k)
        return ranked(near.drop("rank").unionByName(more), k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, slice_rows: int = SLICE) -> DataFrame:
    """query_id, id, distance, rank: the k nearest vectors (id, embedding) of each query."""
    return Cells(vectors, slice_rows).nearest(queries, k)
