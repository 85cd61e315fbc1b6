"""Bounded training samples: labelled rows of the learning folds joined with their texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.llm.common import whole_text, written


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; a null doc_id falls in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, target: str, learn: Column, per_class: dict[int, int], name: str) -> DataFrame:
    """text, y, weight of at most per_class[y] labelled rows of each class, distinct by text.

    Rows are picked by the hash of their doc_id, so any order or partitioning gives the same
    sample. weight restores the classes' shares. The picked labels are at most
    sum(per_class) rows of two numbers each, which bounds the broadcast. Rows with null doc_id,
    null label or a label other than the given classes are not learnt from.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isin(*per_class) & learn).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = written(known, f"{name}-labels")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per class
    picked = []
    for y, most in per_class.items():
        rows = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked.append(rows.withColumn("weight", F.lit(max(1.0, totals.get(y, 0) / most))))
    chosen = reduce(DataFrame.unionByName, picked)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out = texts.join(F.broadcast(chosen), "doc_id").select("text", "y", "weight")
    return written(out.dropDuplicates(["text"]), name)
