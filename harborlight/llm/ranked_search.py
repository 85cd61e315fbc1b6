"""Operator 12: ranked lexical search over impact-ordered postings, a score at a time.

One pass over the texts writes an index: for each slice of documents its lengths and, of the terms
that queries ask for, the postings (a bitmap of fixed size lets the others go early; what it lets
through in error is dropped when weights are joined). Document frequencies and the corpus totals
come from that table.

The index is dealt to shards of SHARD terms of text, about, and so are the queries, each to every
shard; a hot term is in every shard and whole in none. In its shard a term's postings are grouped by their
exact impact, the term's share of a score. A query takes the groups of all its terms in descending
order of impact and adds them up. What a document can still gain is bounded by the terms' next
impacts. Once that proves that all but a few documents are below the k-th score, the few are
scored completely, and the best of them are the shard's answer. A shard sends its k best a query
on; the best of those by score and doc_id are the result.

Defined results: null, empty and term-free texts have no terms, are not counted in N and never
found; very long texts are one document whole; repeated rows are documents of their own; a null
doc_id ranks behind its equals in score; items without terms or hits have no rows; rows of one
item_id are one item with the terms of all; a null item_id is an item; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.llm.common import prepare, slices, whole_text, written
from harborlight.llm.kernels import IS_TERM, interned, utf8

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Terms of a shard's documents, about, and queries that a shard takes at once.
SHARD, QUERIES = 4 << 20, 4096
#: Bits of the bitmap of asked terms: 64 KB go to each task, however many queries there are.
ASKED_BITS = 1 << 19
#: Documents that are scored completely once the bounds have left no more.
FEW = 64
INDEX = "slice long, docs array<long>, lengths array<long>, terms array<string>, holders array<long>, term binary, doc binary, tf binary"
HITS = "item_id long, doc_id long, score long"


def terms_of(text: Column) -> Column:
    """Distinct search terms of a text."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_distinct(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))


def asked_bits(queries: DataFrame) -> np.ndarray:
    """The bitmap of the queries' terms; the driver gets at most ASKED_BITS / 64 rows of two numbers."""
    at = queries.select(F.pmod(F.xxhash64("term"), F.lit(ASKED_BITS)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
    out = np.zeros(ASKED_BITS // 64, np.int64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def index(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """INDEX: a row per slice of documents; postings are sorted by term and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for piece in slices(batch):
                code, row, _, dictionary = interned(*utf8(piece.column(1)), IS_TERM)
                words = dictionary.to_pylist()
                wanted = np.array([asked[xxh64_intdigest(w, 42) % ASKED_BITS] for w in words], bool)
                place = np.cumsum(wanted) - 1
                hit = wanted[code] if len(code) else np.zeros(0, bool)
                key, tf = np.unique(place[code[hit]] * piece.num_rows + row[hit], return_counts=True)
                term, doc = np.divmod(key, piece.num_rows)
                kept = [w.decode() for w, k in zip(words, wanted) if k]
                holders = np.bincount(term.astype(np.int64), minlength=len(kept))
                lengths = np.bincount(row, minlength=piece.num_rows)
                one = (pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((term, "<i4"), (doc, "<i4"), (tf, "<i8")))
                name = xxh64_intdigest(key.tobytes() + lengths.tobytes() + str(piece.column(0)[0]).encode()) >> 1
                lists = (pa.array([x], pa.list_(t)) for x, t in ((piece.column(0), pa.int64()), (lengths, pa.int64()), (kept, pa.string()), (holders, pa.int64())))
                yield pa.RecordBatch.from_arrays([pa.array([name]), *lists, *one], [x.split()[0] for x in INDEX.split(", ")])

    return docs.mapInArrow(run, INDEX)


class Shard:
    """The postings of some documents, by term and descending impact."""

    def __init__(self, table: pa.Table, n: int, total: int):
        """table: INDEX rows; n, total: documents with terms, and terms, of the corpus."""
        docs, lengths, terms, term, doc, tf = (table.column(c).combine_chunks() for c in ("docs", "lengths", "terms", "term", "doc", "tf"))
        self.doc_ids = docs.flatten()
        lengths, held = lengths.flatten().to_numpy(), terms.flatten().dictionary_encode()
        first_doc = np.cumsum([0, *(len(x) for x in docs)])
        first_term = np.cumsum([0, *(len(x) for x in terms)])
        names = held.indices.to_numpy(zero_copy_only=False)
        parts = []
        for k in range(table.num_rows):
            t, d, f = (np.frombuffer(c[k].as_buffer(), x) for c, x in ((term, "<i4"), (doc, "<i4"), (tf, "<i8")))
            parts.append((names[first_term[k] + t].astype(np.int64), d + first_doc[k], f))
        none = np.zeros(0, np.int64)
        term, doc, tf = (np.concatenate([none, *x]) for x in zip(*parts)) if parts else (none,) * 3
        m = 10 + 90 * lengths * n // max(total, 1)
        unit = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
        self.names = {w: i for i, w in enumerate(held.dictionary.to_pylist())}
        self.size = len(self.doc_ids)
        # for completing a score: units by term and document
        by_doc = np.argsort(term * self.size + doc, kind="stable")
        self.keys, self.units = (term * self.size + doc)[by_doc], unit[by_doc]
        # for searching: groups of equal units, descending in each term
        order = np.lexsort((doc, -unit, term))
        self.doc, unit, term = doc[order], unit[order], term[order]
        new = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (unit[1:] != unit[:-1]))[: len(term)])
        self.group_at, self.group_unit = np.append(new, len(term)), unit[new]
        self.groups = np.searchsorted(term[new], np.arange(len(self.names) + 1))
        self.read = 0  # postings added up so far

    def complete(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t, w in zip(terms, weights):
            at = np.searchsorted(self.keys, t * self.size + docs)
            at = np.minimum(at, len(self.keys) - 1)
            out += np.where(self.keys[at] == t * self.size + docs, w * self.units[at], 0)
        return out

    def search(self, terms: list[str], weights: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (places) and scores that the `top` best of the shard are among, all above 0."""
        known = [i for i, t in enumerate(terms) if t in self.names and weights[i] > 0]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own, weight = np.array([self.names[terms[i]] for i in known]), weights[known]
        lo, hi = self.groups[own], self.groups[own + 1]
        of = np.repeat(np.arange(len(own)), hi - lo)
        group = np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo) - lo, hi - lo)
        impact = weight[of] * self.group_unit[group]
        order = np.argsort(-impact, kind="stable")
        of, group, impact = of[order], group[order], impact[order]
        count = self.group_at[group + 1] - self.group_at[group]
        until = np.cumsum(count)
        score = np.zeros(self.size, np.int64)
        done, goal = np.zeros(len(own), np.int64), 1024
        at = 0
        while True:
            # the groups up to `goal` postings, and all of the last one's impact
            to = min(len(of), int(np.searchsorted(until, goal)) + 1)
            to = int(np.searchsorted(-impact, -impact[to - 1], side="right"))
            n = count[at:to]
            posting = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.group_at[group[at:to]], n)
            np.add.at(score, self.doc[posting], np.repeat(impact[at:to], n))
            self.read += len(posting)
            done += np.bincount(of[at:to], minlength=len(own))
            at, goal = to, 2 * int(until[to - 1])
            open_ = lo + done < hi
            rest = int(np.sum(weight[open_] * self.group_unit[(lo + done)[open_]]))
            if not rest:
                found = np.flatnonzero(score)
                if len(found) > top:
                    found = found[score[found] >= np.partition(score[found], -top)[-top]]
                return found, score[found]
            if self.size > top and (least := int(np.partition(score, -top)[-top])) > rest:
                # no document below least - rest can reach the k-th score, which is least at least
                few = np.flatnonzero(score >= least - rest)
                if len(few) <= max(FEW, 2 * top):
                    return few, self.complete(few, own, weight)


def best(docs: pa.Array, place: np.ndarray, score: np.ndarray, top: int) -> tuple[pa.Array, np.ndarray]:
    ids = docs.take(pa.array(place))
    order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), -score))[:top]
    return ids.take(pa.array(order)), score[order]


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, shard: int = SHARD, queries_at_once: int = QUERIES) -> DataFrame:
    """item_id, rank, doc_id, score of the `top` documents of every item (item_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    asked = written(asked, "asked")
    held = written(index(docs, asked_bits(asked)), "index")
    sizes = held.select(F.filter("lengths", lambda x: x > 0).alias("n"))
    total = sizes.select(F.coalesce(F.sum(F.size("n")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("l")).first()  # two numbers
    n, tokens = int(total["n"]), int(total["l"])
    count = asked.agg(F.count_distinct("item_id").alias("n")).first()["n"]  # one number
    shards, blocks = max(1, -(-tokens // shard)), max(1, -(-count // queries_at_once))
    df = held.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.holders").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weighted = asked.join(df, "term").withColumn("weight", weight).where("weight > 0")
    queries = weighted.groupBy("item_id").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item_id", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    parts = held.withColumn("shard", F.pmod("slice", F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index, out = Shard(left, n, tokens), []
        for item, terms, weights in zip(*(right.column(c).to_pylist() for c in ("item_id", "terms", "weights"))):
            ids, score = best(index.doc_ids, *index.search(terms, np.array(weights, np.int64), top), top)
            out.append(pa.table([pa.array([item] * len(ids), pa.int64()), ids.cast(pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 3, ["item_id", "doc_id", "score"])

    hits = parts.drop("slice", "holders").groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInArrow(run, HITS)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return ranked(docs, items)


SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM n),
w AS (SELECT term, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, c.n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
m AS (SELECT doc_id, 10 + ((90 * n.n * c.n) // c.l) AS m FROM n, c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
