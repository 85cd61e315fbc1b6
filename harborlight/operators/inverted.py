"""An inverted index in document ranges with block maxima, and exact best documents over it.

`build` writes postings in chunks of CHUNK documents: a row holds one term's postings in a chunk, with
each one's share of a BM25 score (all of it but the term's idf), cut into blocks of WINDOW
neighbouring documents, and the largest share of each block. So a frequent term is many rows and
no task holds it whole.

A search deals chunks and queries to ranges of documents. There a query adds up, for each window,
its terms' idf times the blocks' maxima: no document of the window can score more. Windows are
scored from the highest bound down, and the rest is left unread once the next bound is below what a
document needs (the k-th score so far, or a share of the best). Each range sends its best
documents on; there is no table of (query, document) pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.sources.batches import small_batches
from harborlight.sources.folders import written

#: Documents of a chunk and of a window, documents of a range (on average), queries that it takes at
#: once, and queries whose terms are Python strings at once.
CHUNK, WINDOW, RANGE, QUERIES, READ = 1024, 4, 1 << 12, 4096, 64
#: Parts that the rows of a term are dealt to when unasked terms are left out.
SALTS = 16
ROWS = "chunk long, term string, holders long, ids binary, places binary, units binary, windows binary, tops binary, sizes binary"
FOUND = "query_id long, doc_id long, score double, seen long, held long"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


@dataclass(frozen=True)
class Index:
    rows: DataFrame
    docs: int
    chunk: int
    window: int


def packed(values: np.ndarray, edge: np.ndarray, kind: str) -> pa.Array:
    """One binary value for each stretch of values between two edges."""
    values = np.ascontiguousarray(values.astype(kind))
    return pa.Array.from_buffers(pa.large_binary(), len(edge) - 1, [None, pa.py_buffer(edge * values.itemsize), pa.py_buffer(values)]).cast(pa.binary())


def build(docs: DataFrame, k1: float = 1.5, b: float = 0.75, chunk: int = CHUNK, window: int = WINDOW) -> Index:
    """The index of docs (doc_id, text): Okapi BM25 with the lengths and the mean length of docs."""
    size = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"))).alias("terms")).first()  # two numbers
    mean = (size["terms"] or 0) / max(1, size["docs"]) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, chunk):
                piece, number = batch.slice(at, chunk), number + 1
                ids, lists = piece.column(0).to_numpy(), piece.column(1)
                coded = lists.flatten().dictionary_encode()
                lengths = np.diff(lists.offsets.to_numpy())
                doc = np.repeat(np.arange(len(ids)), lengths)
                key, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + doc, return_counts=True)
                if not len(key):
                    continue
                term, doc = np.divmod(key, len(ids))
                unit = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / mean))
                edge = np.searchsorted(term, np.arange(len(coded.dictionary) + 1))
                block = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (doc[1:] // window != doc[:-1] // window)))
                block_edge = np.searchsorted(block, edge)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(coded.dictionary), number)), coded.dictionary, pa.array(np.diff(edge)), packed(ids[doc], edge, "<i8"), packed(doc, edge, "<i4"), packed(unit, edge, "<f8"),
                        packed(doc[block] // window, block_edge, "<i4"), packed(np.maximum.reduceat(unit, block), block_edge, "<f8"), packed(np.diff(np.append(block, len(term))), block_edge, "<i4"),
                    ],
                    [c.split()[0] for c in ROWS.split(", ")],
                )

    small_batches(docs.sparkSession)
    held = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), terms(F.coalesce("text", F.lit(""))).alias("terms"))
    return Index(written(held.mapInArrow(run, ROWS), "postings"), size["docs"], chunk, window)


class Range:
    """The asked postings of a range of documents, by term and window."""

    def __init__(self, table: pa.Table, chunk_docs: int, window: int):
        held = table.column("term").combine_chunks().dictionary_encode()
        self.names = {w: i for i, w in enumerate(held.dictionary.to_pylist())}
        code = held.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, chunk = np.unique(table.column("chunk").to_numpy(), return_inverse=True)
        order = np.lexsort((chunk, code))
        chunk = chunk[order]

        def joined(name: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
            column = table.column(name).cast(pa.large_binary()).combine_chunks().take(pa.array(order))
            edge = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            values = np.frombuffer(column.buffers()[2], np.uint8)[edge[0] : edge[-1]] if len(column) else np.zeros(0, np.uint8)
            return values.view(kind), np.diff(edge) // np.dtype(kind).itemsize

        ids, count = joined("ids", "<i8")
        places, _ = joined("places", "<i4")
        self.units, _ = joined("units", "<f8")
        self.places = places + np.repeat(chunk * chunk_docs, count)
        self.ids = np.zeros((int(chunk.max()) + 1) * chunk_docs if len(chunk) else 0, np.int64)
        self.ids[self.places] = ids
        windows, blocks = joined("windows", "<i4")
        self.windows = windows + np.repeat(chunk * (chunk_docs // window), blocks)
        self.tops, _ = joined("tops", "<f8")
        sizes, _ = joined("sizes", "<i4")
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.edge = np.searchsorted(np.repeat(code[order], blocks), np.arange(len(self.names) + 1))
        self.n_windows = len(self.ids) // window

    def search(self, names: list[str], idf: list[float], top: int | None, share: float) -> tuple[np.ndarray, np.ndarray, int, int]:
        """ids and scores of the documents that may be of the `top` best and reach `share` of the
        best score (all with a score, if neither is asked), and how many postings were seen, of how many."""
        own = [(self.names[t], w) for t, w in zip(names, idf) if t in self.names]
        none = np.zeros(0, np.int64), np.zeros(0), 0, 0
        if not own:
            return none
        code, weight = np.array([c for c, _ in own]), np.array([w for _, w in own])
        low, n = self.edge[code], self.edge[code + 1] - self.edge[code]
        block = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)
        factor = np.repeat(weight, n)
        bound = np.bincount(self.windows[block], factor * self.tops[block], self.n_windows)
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound))]
        turn = np.full(self.n_windows, len(order))
        turn[order] = np.arange(len(order))
        by_turn = np.argsort(turn[self.windows[block]], kind="stable")
        block, factor = block[by_turn], factor[by_turn]
        until = np.searchsorted(turn[self.windows[block]], np.arange(len(order) + 1))
        held = int((self.ends[block] - self.starts[block]).sum())
        docs, scores, seen, at, step, need = [], [], 0, 0, 4, -np.inf
        while at < len(order) and bound[order[at]] > need - 2e-6:
            to = min(len(order), at + step)
            part, gain = block[until[at] : until[to]], factor[until[at] : until[to]]
            size = self.ends[part] - self.starts[part]
            posting = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.starts[part], size)
            place, where = np.unique(self.places[posting], return_inverse=True)
            docs.append(place)
            scores.append(np.bincount(where, np.repeat(gain, size) * self.units[posting]))
            seen, at, step = seen + len(posting), to, 2 * step
            if top or share:
                found = np.concatenate(scores)
                kth = np.partition(found, -top)[-top] if top and len(found) >= top else -np.inf
                need = max(kth, share * found.max() if share else -np.inf)
        place, score = np.concatenate(docs), np.concatenate(scores)
        stay = (score > 0) & (score >= need - 2e-6)
        place, score = place[stay], score[stay]
        if top and len(place) > top:
            order = np.lexsort((self.ids[place], -np.round(score, 6)))[: 2 * top]
            near = np.flatnonzero(score >= score[order[top - 1]] - 2e-6)  # what rounding may tie stays for the last sort
            place, score = place[near], score[near]
        return self.ids[place], score, seen, held


def search(queries: DataFrame, index: Index, top: int | None = None, share: float = 0.0, range_docs: int = RANGE, at_once: int = QUERIES) -> DataFrame:
    """FOUND: candidates of every range, a superset of the answer, and a row a query and range
    with the postings seen and held. queries: query_id, text."""
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    df = index.rows.groupBy("term").agg(F.sum("holders").alias("df")).where(2 * F.col("df") < index.docs)
    weighed = asked.join(df, "term").withColumn("idf", F.log((index.docs - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weighed = written(weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "idf")).alias("t")), "asked")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    known = weighed.select(F.explode("t.term").alias("term")).distinct().select("term", salts)
    kept = index.rows.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int")).join(known, ["term", "salt"], "left_semi")
    ranges, blocks = -(-index.docs // range_docs) or 1, -(-weighed.count() // at_once) or 1
    left = kept.withColumn("range", F.pmod(F.xxhash64("chunk"), F.lit(ranges))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = weighed.withColumn("range", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))

    chunk_docs, window = index.chunk, index.window

    def run(held: pa.Table, asked: pa.Table) -> pa.Table:
        own, found, counts = Range(held, chunk_docs, window), [], []
        for at in range(0, asked.num_rows, READ):
            piece = asked.slice(at, READ)
            for query, t in zip(piece.column("query_id").to_pylist(), piece.column("t").to_pylist()):
                ids, score, seen, all_ = own.search([x["term"] for x in t], [x["idf"] for x in t], top, share)
                found.append((np.full(len(ids), query), ids, score))
                counts.append((query, seen, all_))
        hits, n = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in range(3)], len(counts)
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        empty = [pa.nulls(len(hits[0]), pa.int64())] * 2
        columns = [
            [*(pa.array(x, k) for x, k in zip(hits, kinds)), *empty],
            [pa.array([x[0] for x in counts], pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), *(pa.array([x[k] for x in counts], pa.int64()) for k in (1, 2))],
        ]
        return pa.table([pa.chunked_array(c, k) for *c, k in zip(*columns, kinds)], [c.split()[0] for c in FOUND.split(", ")])

    left, right = left.drop("salt", "holders").withColumn("range", F.col("range").cast("long")), right.withColumn("range", F.col("range").cast("long"))
    return left.groupBy("range", "block").cogroup(right.groupBy("range", "block")).applyInArrow(run, FOUND)


def best(queries: DataFrame, index: Index, top: int, **how) -> DataFrame:
    """query_id, doc_id, score, place of the `top` best documents of a query, by score (rounded to
    six places) and doc_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    rows = search(queries, index, top, **how).where("doc_id is not null").select("query_id", "doc_id", "score")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def near_best(queries: DataFrame, index: Index, share: float, **how) -> DataFrame:
    """query_id, doc_id, score of the documents that reach `share` of the query's best score."""
    rows = written(search(queries, index, share=share, **how).where("doc_id is not null").select("query_id", "doc_id", "score"), "near-best")
    top = rows.groupBy("query_id").agg(F.max("score").alias("top"))
    return rows.join(top, "query_id").where(F.col("score") >= share * F.col("top") - 1e-9).drop("top")
