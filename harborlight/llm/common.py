"""Shared plumbing of the corpus operators: work tables, batch slicing, deals and prefilters."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.sources.batches import whole_groups
from harborlight.sources.folders import shared_dir, work_path, written

__all__ = ["dealt", "discard", "documents", "maybe_in", "prefilter", "prepare", "shared_dir", "slices", "trim", "whole_groups", "whole_text", "without", "work_path", "written"]

#: Bytes of text that one numpy pass takes at most, unless a single text is longer.
SLICE_BYTES = 4 << 20


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` once what was made from them is written, too."""
    for table in tables:
        spark = table.sparkSession
        folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for folder in folders:
            if "/harborlight/" not in folder:
                raise ValueError(f"{folder} is not a work folder")
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def prepare(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Settings that the operators' Python workers need.

    Arrow batches stay small, so that long texts fit in memory. Workers of a local session find
    this package where the driver found it (on a cluster, ship it with --py-files).
    """
    top = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if top not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([top, *filter(None, paths)])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def trim() -> None:
    """Give memory that numpy has freed back to the system (glibc keeps it otherwise)."""
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch with at most `limit` bytes of text, or one row, each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            trim()
            start, held = i, 0
        held += int(n)
    if start < len(sizes):
        yield batch.slice(start)
        trim()


def dealt(rows: DataFrame, key: str, by: str, block: int) -> DataFrame:
    """rows (`key`, members, more columns) with part, side and split: the comparison each takes part in.

    Up to `block` members of a key meet in one task. More are dealt to blocks by hash of `by`, and
    each pair of blocks is a task. Blocks grow with the root of the members up to 8 times `block`
    and no further: from there on the pairs of blocks grow alone, so a task has a bound.
    """
    several = F.greatest(2 * F.ceil(F.sqrt(F.col("members") / block)), F.ceil(F.col("members") / (8 * block)))
    blocks = F.when(F.col("members") > block, several).otherwise(1).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("side", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.xxhash64(key, "members", F.least("side", "other"), F.greatest("side", "other"))
    return rows.withColumn("part", part).withColumn("split", F.col("side") != F.col("other"))


#: Words of 64 bits in a prefilter: at most 2 ** 20 rows of 16 bytes are broadcast, at any scale.
PREFILTER_WORDS = 1 << 20


def maybe_in(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows plus `maybe`: false where `column` is surely not in keys, by a one-hash bitmap.

    The bitmap has a fixed size. It keeps wide rows (texts) that nothing asks for out of a
    later join's shuffle; with keys beyond its 67 million bits it lets more and more through
    and is merely useless, never wrong.
    """
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(PREFILTER_WORDS * 64))
    bit = F.expr("shiftleft(1L, cast(pmod(prefilter_at, 64) as int))")
    word = F.shiftright("prefilter_at", 6).alias("prefilter_word")
    words = keys.select(at.alias("prefilter_at")).select(word, bit.alias("b")).groupBy("prefilter_word").agg(F.bit_or("b").alias("prefilter_bits"))
    probe = rows.withColumn("prefilter_at", at).withColumn("prefilter_word", word)
    probe = probe.join(F.broadcast(words), "prefilter_word", "left")
    return probe.select(*rows.columns, F.coalesce(F.col("prefilter_bits").bitwiseAND(bit) != 0, F.lit(False)).alias("maybe"))


def prefilter(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` may be in keys; an exact join has to follow."""
    return maybe_in(rows, keys, column).where("maybe").drop("maybe")


def without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose `column` is not in keys (null never is); only likely ones are shuffled."""
    probe = maybe_in(rows, keys, column)
    likely = probe.where("maybe").select(*rows.columns).join(keys.select(column).distinct().hint("merge"), column, "left_anti")
    return probe.where("not maybe").select(*rows.columns).unionByName(likely)
