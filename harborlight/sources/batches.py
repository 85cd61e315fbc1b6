"""Arrow batches of sorted rows, cut between groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of sorted rows that a task gathers before it works on them, unless one group is larger.
GROUP_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and about so many bytes, whatever the length of texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def whole_groups(batches: Iterator[pa.RecordBatch], key: int, limit: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by column `key`: memory holds about `limit`
    bytes, or one group if that is larger, and never a whole partition."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if size >= limit:
            values = batch.column(key).to_numpy()
            other = np.flatnonzero(values != held[-1].column(key)[-1].as_py())
            if len(other):
                yield pa.Table.from_batches([*held, batch.slice(0, other[0])]).combine_chunks()
                held, batch, size = [], batch.slice(other[0]), 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
