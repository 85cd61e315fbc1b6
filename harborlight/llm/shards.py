"""Operator 5: token ids as binary shards in training order.

Packed sequences get a global slot each: a keyed Feistel network over the next power of four,
walked along its cycles until it lands below the number of sequences, is a permutation that any
task can compute for itself. Sequences are dealt to contiguous slot ranges and written as shards
of fixed-stride records, so that slot s lies at byte (s mod per_shard) * stride of shard
s div per_shard: readers go through shards in order and resume at any slot without an index.

Null texts count as empty (one closing id); empty tables give no shard; a null doc_id stays null
in the lists of documents; repeated rows are separate documents; a text of any length spans as
many sequences as it needs; extra columns are ignored. Only the last sequence is padded (id 0).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import documents, work_path, written
from harborlight.llm.kernels import U64, mix
from harborlight.llm.packing import LENGTH, cut, global_offsets
from harborlight.llm.tokens import tokenise

KEY, ROUNDS, PER_SHARD = 20240229, 4, 256


def feistel(x: np.ndarray, size: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, or its inverse."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = U64((1 << half) - 1)
    keys = [mix(np.array([key * ROUNDS + i + 1], U64))[0] for i in range(ROUNDS)]
    out = np.asarray(x).astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> U64(half), out[todo] & mask
        for k in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        out[todo] = left << U64(half) | right
        todo = todo[out[todo] >= U64(size)]
    return out.astype(np.int64)


SHARD = "shard long, first_slot long, stride int, payload binary, crc32 long, records array<struct<slot: long, sequence_id: long, n_tokens: int, doc_ids: array<long>>>"


def write_shards(pieces: DataFrame, sequences: int, path: str, length: int = LENGTH, key: int = KEY, per_shard: int = PER_SHARD, compression: str = "zstd") -> DataFrame:
    """Write the shards of packed pieces as a table under path: one row a shard.

    compression: of the table's files; with "none" a shard's bytes lie in its file as they are.
    """

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = feistel(batch.column(1).to_numpy(), sequences, key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot)], [*batch.schema.names, "slot"])

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, payload, records = None, bytearray(), []

        def done() -> pa.RecordBatch:
            payload.extend(bytes(len(records) * length * 2 - len(payload)))
            row = {"shard": at, "first_slot": at * per_shard, "stride": length * 2, "payload": bytes(payload), "crc32": zlib.crc32(payload), "records": list(records)}
            payload.clear()
            records.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            doc, sequence, slot, ids = (c.to_pylist() for c in batch.columns)
            for d, q, s, x in zip(doc, sequence, slot, ids):
                if at is not None and s // per_shard != at:
                    yield done()
                at = s // per_shard
                if not records or records[-1]["slot"] != s:
                    payload.extend(bytes(len(records) * length * 2 - len(payload)))
                    records.append({"slot": s, "sequence_id": q, "n_tokens": 0, "doc_ids": []})
                records[-1]["n_tokens"] += len(x) // 2
                records[-1]["doc_ids"].append(d)
                payload.extend(x)
        if records:
            yield done()

    record = pa.struct([("slot", pa.int64()), ("sequence_id", pa.int64()), ("n_tokens", pa.int32()), ("doc_ids", pa.list_(pa.int64()))])
    schema = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("stride", pa.int32()), ("payload", pa.binary()), ("crc32", pa.int64()), ("records", pa.list_(record))])
    shards = -(-sequences // per_shard)
    parts = max(1, min(shards, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = -(-max(shards, 1) // parts) * per_shard
    placed = pieces.select("doc_id", "sequence_id", "offset", "ids").mapInArrow(slots, "doc_id long, sequence_id long, offset long, ids binary, slot long")
    dealt = placed.repartitionById(parts, F.expr(f"cast(slot div {each} as int)")).sortWithinPartitions("slot", "offset")
    out = dealt.select("doc_id", "sequence_id", "slot", "ids").mapInArrow(assemble, SHARD)
    out.write.option("compression", compression).parquet(path)
    return pieces.sparkSession.read.schema(SHARD).parquet(path)


def read_slots(shards: DataFrame, first: int = 0) -> DataFrame:
    """slot, sequence_id, shard, byte_offset, n_tokens, ids_crc32, doc_ids from slot `first` on,
    out of the stored bytes; earlier shards are skipped in the scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, stride, payload, crc, records in zip(*(c.to_pylist() for c in batch.columns)):
                if zlib.crc32(payload) != crc:
                    raise ValueError(f"shard {shard} is damaged")
                rows = []
                for i, r in enumerate(records):
                    ids = np.frombuffer(payload, "<u2", r["n_tokens"], i * stride)
                    rows.append(r | {"shard": shard, "byte_offset": i * stride, "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("slot", pa.int64()), ("sequence_id", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("n_tokens", pa.int32()), ("ids_crc32", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
    rows = shards.where(F.col("first_slot") + F.size("records") > first).select("shard", "stride", "payload", "crc32", "records")
    return rows.mapInArrow(run, "slot long, sequence_id long, shard long, byte_offset long, n_tokens int, ids_crc32 long, doc_ids array<long>").where(F.col("slot") >= first)


def materialise(docs: DataFrame, length: int = LENGTH, key: int = KEY, vocabulary: str | None = None, encode_special_tokens: bool = False, per_shard: int = PER_SHARD) -> DataFrame:
    """The written shards of docs (doc_id, text), a row each."""
    tokens = written(tokenise(docs, vocabulary, encode_special_tokens=encode_special_tokens), "tokens", "zstd")
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]  # one number
    return write_shards(cut(global_offsets(tokens), length), -(-total // length), work_path(docs.sparkSession, "shards"), length, key, per_shard)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_slots(materialise(documents(spark, sf_dir)))
