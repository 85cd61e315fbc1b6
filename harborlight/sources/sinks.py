"""Sinks: daily JSON lines in batch and stream, CSV with a byte order mark, upserts by key, namespace
resets, aligned outputs, dual writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those that share its key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def write_daily_json(rows: DataFrame, path: str, ts: str = "ts") -> None:
    """Append rows as JSON lines, a folder a day."""
    rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("day").json(path)


def stream_daily_json(rows: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """The same for a stream: takes all that is there now and returns the finished query. The sink's
    log keeps a batch that runs again from appending twice."""
    days = rows.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    run = days.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def reset_namespace(rows: DataFrame, path: str, namespace: str = "namespace") -> None:
    """Replace the rows of the namespaces that `rows` has; others stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(namespace).parquet(path)


def write_aligned(rows: DataFrame, path: str, sample: list[str], provenance: list[str], rejected: str) -> None:
    """samples, provenance and rejected as JSON lines under path, of rows with an id column. `rejected`
    is a condition; the first two have the same ids, the third all others."""
    bad = F.coalesce(F.expr(rejected), F.lit(False))
    kept = rows.where(~bad)
    for name, part in (("samples", kept.select("id", *sample)), ("provenance", kept.select("id", *provenance)), ("rejected", rows.where(bad).select("id", *sample, *provenance))):
        part.write.mode("overwrite").json(f"{path}/{name}")


def write_report_csv(rows: DataFrame, path: str) -> None:
    """CSV whose header starts with a byte order mark, for spreadsheet programs."""
    first, *rest = rows.columns
    rows.select(F.col(f"`{first}`").alias(f"﻿{first}"), *rest).write.mode("overwrite").option("header", True).csv(path)


def dual_sink(json_path: str, table_path: str):
    """A foreachBatch function: each batch as JSON lines and as a table, both by batch number, so
    a replayed batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{json_path}/batch={number}")
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return write
