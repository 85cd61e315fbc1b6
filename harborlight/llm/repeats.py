"""Operator 7: removal of long repeated byte strings through a run-length index.

A byte goes if it lies in a string of LENGTH bytes that also starts earlier (smaller doc_id, or
the same document further left). Matches never cross documents and are judged on the input.

1. Every window of LENGTH bytes has an anchor: of its GRAM-byte strings, the leftmost with the
   least hash. Equal windows have equal anchors, so windows are dealt by anchor and nothing else
   needs to meet. Neighbouring windows with one anchor at one place form a segment.
2. Equal segments of an anchor are folded, first inside each slice of the map side, then across
   slices: all but the earliest copy are repeated as a whole, so an anchor that a third of all
   documents hold reaches its task as one entry a slice.
3. What folding leaves are the anchors with several different segments (text around a passage
   or an edit). Their bytes, a copy of each, are dealt by anchor and indexed: a run-compressed
   Burrows-Wheeler transform with sampled run ends, through which all segments are streamed.
   Matching statistics of LENGTH or more name the earliest equal window. A group larger than
   BLOCK bytes is indexed block by block, each block streamed against the earlier ones.
4. Marked windows are joined to their documents; documents without any pass by without Python.

Defined results: null and empty texts and texts under LENGTH bytes keep all bytes; very long
texts are one numpy pass; a null doc_id takes no part and keeps its text; rows repeated with
doc_id and text are one document and all lose the same bytes; different texts under one doc_id
are documents of their own, in the order of their SHA-256; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.llm.common import dealt, documents, maybe_in, prefilter, slices, trim, whole_groups, whole_text, written
from harborlight.llm.kernels import U64, gram_hashes, mix, powers, sliding_min, utf8
from harborlight.llm.runindex import RunIndex

LENGTH, GRAM = 100, 32
#: Bytes of segments in one index, and of texts in one numpy pass.
BLOCK, SLICE = 1 << 20, 2 << 20
#: Segments of an anchor beyond which it is dealt in blocks, and bytes of text for each bucket.
SHARED, BUCKET = 2048, 16 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_PLACE = U64((1 << 36) - 1)


def segments(raw: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start, windows, anchor, digest) of every segment of every row, in order."""
    rows = np.flatnonzero(np.diff(off) >= length)
    if not len(rows):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U64, U64))
    grams = mix(gram_hashes(raw, GRAM))
    row, start, windows, anchor = [], [], [], []
    for r in rows:
        own = grams[off[r] : off[r + 1] - GRAM + 1]
        # 28 bits of the hash, then the position: the leftmost least one, alike in equal windows
        least = sliding_min((own & ~_PLACE) | np.arange(len(own), dtype=U64), length - GRAM + 1)
        at = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        row.append(np.full(len(at), r))
        start.append(at)
        windows.append(np.diff(np.append(at, len(least))))
        anchor.append(own[(least[at] & _PLACE).astype(np.int64)])
    row, start, windows, anchor = map(np.concatenate, (row, start, windows, anchor))
    # a segment's digest is taken from the mixed hashes of its grams, which no two byte strings
    # share by their algebra alone
    sums = np.zeros(len(grams) + 1, U64)
    np.cumsum(grams * powers(_BASE, len(grams)), out=sums[1:])
    a = off[row] + start
    digest = mix((sums[a + windows + length - GRAM] - sums[a]) * powers(_BACK, len(grams))[a] + windows.astype(U64) * U64(0xD6E8FEB86659FD93))
    return row, start, windows, anchor, digest


def entries(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """Earliest copy of each segment of a slice, packed by bucket of the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                ids = piece.column(0).to_numpy()
                row, start, windows, anchor, digest = segments(*utf8(piece.column(1)), length)
                if not len(row):
                    continue
                bucket = (mix(anchor) % U64(buckets)).astype(np.int64)
                order = np.lexsort((start, ids[row], digest, anchor, bucket))
                first = order[fresh(anchor[order], digest[order])]
                bucket = bucket[first]
                edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
                stop = np.append(edge[1:], len(bucket))
                columns = (anchor[first], digest[first], ids[row[first]], start[first].astype(np.int32), windows[first].astype(np.int16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[edge].astype(np.int32)), *(pa.array([c[a:b].tobytes() for a, b in zip(edge, stop)], pa.binary()) for c in columns)],
                    ["bucket", "anchors", "digests", "ids", "starts", "windows"],
                )

    return docs.mapInArrow(run, "bucket int, anchors binary, digests binary, ids binary, starts binary, windows binary")


def later_copies(docs: DataFrame, length: int) -> DataFrame:
    """Marks of the segments that repeat inside one slice, all but each one's earliest copy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                ids = piece.column(0).to_numpy()
                row, start, windows, anchor, digest = segments(*utf8(piece.column(1)), length)
                order = np.lexsort((start, ids[row], digest, anchor))
                new = fresh(anchor[order], digest[order])
                head = order[new][np.cumsum(new) - 1] if len(order) else order
                rest = ~new & ((ids[row[order]] != ids[row[head]]) | (start[order] != start[head]))
                yield marks(ids[row[order[rest]]], start[order[rest]], windows[order[rest]])

    return docs.mapInArrow(run, MARKS)


MARKS = "doc_id long, start int, windows int"


def marks(doc: np.ndarray, start: np.ndarray, windows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32))], ["doc_id", "start", "windows"])


def fresh(*columns: np.ndarray) -> np.ndarray:
    """True where any of the sorted columns differs from the row before."""
    out = np.ones(len(columns[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def fold(packed: DataFrame) -> DataFrame:
    """MARKS with anchor: null for later copies of a segment; set for the earliest copies of the
    different segments of an anchor (members of them), which the index has to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 0):
            anchor, digest, ids, start, windows = (np.frombuffer(b"".join(c.to_pylist()), t) for c, t in zip(held.columns[1:], ("<u8", "<u8", "<i8", "<i4", "<i2")))
            order = np.lexsort((start, ids, digest, anchor))
            anchor, digest, ids, start, windows = (x[order] for x in (anchor, digest, ids, start, windows))
            new = fresh(anchor, digest)
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            copy = ~new & ((ids != ids[head]) | (start != start[head]))
            group = np.cumsum(fresh(anchor)) - 1
            members = np.bincount(group, weights=new)[group].astype(np.int64)
            for keep, named in ((copy, False), (new & (members >= 2), True)):
                at = np.flatnonzero(keep)
                for i in range(0, len(at), 1 << 17):
                    part = at[i : i + (1 << 17)]
                    key = pa.array(anchor[part].view(np.int64)) if named else pa.nulls(len(part), pa.int64())
                    yield pa.RecordBatch.from_arrays([*marks(ids[part], start[part], windows[part]).columns, key, pa.array(members[part])], ["doc_id", "start", "windows", "anchor", "members"])

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, MARKS + ", anchor long, members long")


def texts_of(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """anchor, members, doc_id, start, bytes of every asked segment."""
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "members")).alias("segments"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text = batch.column(0)[i].as_py(), batch.column(1)[i].as_py().encode()
                rows = batch.column(2)[i].values
                anchor, start, windows, members = (rows.field(k) for k in range(4))
                cut = [text[a : a + w + length - 1] for a, w in zip(start.to_pylist(), windows.to_pylist())]
                yield pa.RecordBatch.from_arrays([anchor, members, pa.array([doc] * len(cut), pa.int64()), start, pa.array(cut, pa.binary())], ["anchor", "members", "doc_id", "start", "bytes"])

    rows = prefilter(docs, asked, "doc_id").join(wanted.hint("merge"), "doc_id").dropDuplicates(["doc_id"])
    return rows.select("doc_id", "text", "segments").mapInArrow(run, "anchor long, members long, doc_id long, start int, bytes binary")


def compare(rows: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Marks of the windows of the asked segments that start earlier in another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 0):
            part, doc, start = (table.column(k).to_numpy() for k in range(3))
            _, place = np.unique(doc, return_inverse=True)
            key = (place.astype(np.int64) << 32) + start
            size = np.cumsum([0, *(len(x.as_py()) for x in table.column(3))])
            edge = np.append(np.flatnonzero(fresh(part)), len(part))
            at = 0
            while at < len(edge) - 1:
                to = max(at + 1, int(np.searchsorted(size[edge], size[edge[at]] + block, side="right")) - 1)
                a, b, at = edge[at], edge[to], to
                cuts = [a]  # one run of parts, or one part in several blocks
                while cuts[-1] < b:
                    cuts.append(min(b, max(cuts[-1] + 1, int(np.searchsorted(size, size[cuts[-1]] + block, side="right")) - 1)))
                for i, j in zip(cuts, cuts[1:]):
                    index = RunIndex(table.column(3).slice(i, j - i).to_pylist(), key[i:j], length)
                    for m, n in [(i, j)] + [(m, n) for m, n in zip(cuts, cuts[1:]) if m > i]:
                        pattern, offset, earliest = index.stream(table.column(3).slice(m, n - m).to_pylist())
                        later = earliest < key[m + pattern] + offset
                        pattern, offset = pattern[later] + m, offset[later]
                        order = np.lexsort((offset, pattern))
                        pattern, offset = pattern[order], offset[order]
                        new = np.flatnonzero(fresh(pattern, offset - np.arange(len(offset))))
                        if len(new):
                            yield marks(doc[pattern[new]], start[pattern[new]] + offset[new], np.diff(np.append(new, len(offset))))
                    del index
                    trim()

    rows = dealt(rows.withColumn("place", F.xxhash64("doc_id", "start")), "anchor", "place", SHARED)
    return rows.select("part", "doc_id", "start", "bytes").repartition("part").sortWithinPartitions("part", "doc_id", "start").mapInArrow(run, MARKS)


def marked_windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """MARKS of all windows that start earlier, too. docs: doc_id (unique, not null) and text."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]  # one number
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET + 1)
    found = written(fold(entries(docs, length, buckets)), "folded")
    asked = found.where("anchor is not null")
    edges = written(compare(texts_of(docs, asked, length), length), "compared")
    copies = found.where("anchor is null").select("doc_id", "start", "windows")
    return copies.unionByName(later_copies(docs, length)).unionByName(edges)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def kept_bytes(text: bytes, spans, length: int) -> tuple[bytes, int, int]:
    """The bytes outside all marked windows, how many are inside, and in how many runs."""
    raw, spans = np.frombuffer(text, np.uint8), np.array([*map(tuple, spans)], np.int64).reshape(-1, 2)
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, spans[:, 0], 1)
    np.add.at(step, spans[:, 0] + spans[:, 1] + length - 1, -1)
    gone = np.cumsum(step[:-1]) > 0
    return raw[~gone].tobytes(), int(gone.sum()), int(np.sum(gone & ~np.append(False, gone[:-1])))


def cut(rows: DataFrame, length: int) -> DataFrame:
    """rows: doc_id, text, marks (start, windows). Whole documents in, RESULT out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, marked = batch.column(1)[i].as_py().encode(), batch.column(2)[i].values
                kept, removed, runs = kept_bytes(text, zip(marked.field(0).to_pylist(), marked.field(1).to_pylist()), length)
                out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [x.split()[0] for x in RESULT.split(", ")])

    return rows.select("doc_id", "text", "marks").mapInArrow(run, RESULT)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, digest, place of every distinct text of every doc_id, places in that order.

    Rows are dealt by range and counted in their task; the totals, a row a task, get a prefix sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            local = np.arange(before, before + batch.num_rows)
            before += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(local)], ["doc_id", "digest", "part", "local"])

    rows = docs.select("doc_id", F.sha2("text", 256).alias("digest")).distinct()
    rows = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    rows = written(rows.mapInArrow(run, "doc_id long, digest string, part int, local long"), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", "digest", (F.col("base") + F.col("local")).alias("place"))


def placed(docs: DataFrame) -> DataFrame:
    """docs with `place`: the doc_id, or a number in the order of doc_id and digest if several texts share one."""
    ids = docs.select("doc_id", F.sha2("text", 256).alias("digest")).groupBy("doc_id")
    if ids.agg(F.min("digest").alias("least"), F.max("digest").alias("most")).where("least <> most").isEmpty():
        return docs.withColumn("place", F.col("doc_id"))
    places = written(numbered(docs), "places")
    return docs.withColumn("digest", F.sha2("text", 256)).join(places, ["doc_id", "digest"]).select(*docs.columns, "place")


def with_marks(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """docs (with all its columns) in two parts: rows with `marks`, and rows that stay whole."""
    active, idle = placed(docs.where("doc_id is not null")), docs.where("doc_id is null")
    found = marked_windows(active.select(F.col("place").alias("doc_id"), "text"), length).withColumnRenamed("doc_id", "place")
    held = written(found.groupBy("place").agg(F.collect_list(F.struct("start", "windows")).alias("marks")), "marks")
    probe = maybe_in(active, held, "place")
    rows = probe.where("maybe").drop("maybe").join(held.hint("merge"), "place", "left").select(*docs.columns, "marks")
    whole = rows.where("marks is null").drop("marks").unionByName(probe.where("not maybe").select(*docs.columns)).unionByName(idle)
    return rows.where("marks is not null"), whole


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """RESULT for every row of docs (doc_id, text): the bytes left and what was removed."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    marked, whole = with_marks(docs, length)
    same = whole.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"),
    )
    return cut(marked, length).unionByName(same)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (doc_id, text, more columns of any name) with the repeated bytes cut out of text.

    Characters that lose some of their bytes go whole, and n_chars counts what is left. Rows
    without repeats stay as they are, null texts included.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text")]
    row = F.struct(F.col("text").isNull().alias("no_text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(others)])
    marked, whole = with_marks(docs.select("doc_id", whole_text().alias("text"), row.alias("row")), length)

    @F.pandas_udf("string")
    def rest(text: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series([kept_bytes(t.encode(), m, length)[0].decode(errors="ignore") for t, m in zip(text, marks)], dtype=object)

    def columns(n_chars: Column | None) -> list[Column]:
        held = {"doc_id": F.col("doc_id"), "text": F.when(~F.col("row.no_text"), F.col("text"))}
        held |= {c: F.col(f"row.c{i}") for i, c in enumerate(others)}
        if n_chars is not None and "n_chars" in held:
            held["n_chars"] = n_chars
        return [held[c].alias(c) for c in names]

    changed = marked.select("doc_id", "row", rest("text", F.transform("marks", lambda m: F.array(m["start"], m["windows"]))).alias("text"))
    return changed.select(*columns(F.length("text").cast("long"))).unionByName(whole.select(*columns(None)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")


#: For unique doc_ids: every window's first place by its digest, and the bytes outside all later ones.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substring(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
b AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS new FROM m),
n AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
s AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY doc_id, span),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d),
k AS (SELECT doc_id, a, b, coalesce(max(b) OVER (PARTITION BY doc_id ORDER BY a, b NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
t AS (SELECT k.doc_id, string_agg(substring(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a, b NULLS LAST) AS kept, sum(coalesce(b - a, 0))::BIGINT AS n_removed, count(b) AS n_spans FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN d ON d.doc_id = t.doc_id
"""
