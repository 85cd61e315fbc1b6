"""Operator 10: concatenate and cut.

Pass one tokenises every document once and writes its ids with the running token offset inside
its task. Per-task totals (one row per task) get a prefix sum, which makes every local offset
global. Pass two cuts the global token stream at multiples of the sequence length, row by row:
each document yields one boundary record per window it touches. No shuffle moves ids.

Null texts count as empty (one closing id); empty tables give no rows; a null doc_id stays null;
repeated rows are packed once each; extra columns are ignored; a text of any length becomes as
many pieces as windows it spans.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harborlight.llm.common import documents, written
from harborlight.llm.tokens import tokenise

LENGTH = 1024
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def global_offsets(tokens: DataFrame) -> DataFrame:
    """tokens plus global_start: ids before the row in the order (part, local_start).

    The prefix sum runs over one row per task of pass one, so the single window partition and
    the broadcast hold as many rows as there were input splits, whatever their size.
    """
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(base), "part").withColumn("global_start", F.col("base") + F.col("local_start"))


def cut(tokens: DataFrame, length: int = LENGTH) -> DataFrame:
    """Boundary records: one row per document and window of `length` ids it touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, n, ids, g = (batch.column(i) for i in range(4))
            n, g = n.to_numpy(), g.to_numpy()
            first = g // length
            count = (g + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(g[row], (first[row] + nth) * length)
            end = np.minimum(g[row] + n[row], (first[row] + nth + 1) * length)
            start, size = begin - g[row], end - begin
            out, crc, held, raw = [], [], -1, None
            for r, s, m in zip(row, start, size):
                if r != held:
                    raw, held = np.frombuffer(ids[int(r)].as_py(), "<u2"), r
                part = raw[s : s + m]
                crc.append(zlib.crc32(part.astype("<u4").tobytes()))
                out.append(part.tobytes())
            columns = [doc.take(pa.array(row)), start, size, np.array(crc, np.int64), n[row], first[row] + nth, begin % length, pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

    return tokens.select("doc_id", "n_tokens", "ids", "global_start").mapInArrow(run, PIECES)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, encode_special_tokens: bool = False) -> DataFrame:
    """Pieces with their ids. Sequences are gapless from offset 0; only the last is not full."""
    return cut(global_offsets(written(tokenise(docs, vocabulary, encode_special_tokens=encode_special_tokens), "tokens", "zstd")), length)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).drop("ids")
