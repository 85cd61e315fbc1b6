"""Retrieval: BM25 over an inverted index, vector distances, fusion, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators import inverted
from harborlight.operators.neighbours import nearest

__all__ = ["bm25", "first_per_source", "fuse", "nearest", "strongest"]


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score of every document with a score: Okapi BM25 with idf
    ln((N - n + 0.5) / (n + 0.5)), floored at 0. For the best ones alone ask `inverted.best`."""
    rows = inverted.search(queries, inverted.build(docs, k1, b))
    return rows.where("doc_id is not null").select("query_id", "doc_id", "score")


def strongest(scores: DataFrame, most: int, share: float = 0.7) -> DataFrame:
    """query_id, id, score: the `most` best hits of each query, down to a share of its best score."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "doc_id")
    rows = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    top = F.max("score").over(Window.partitionBy("query_id"))
    return rows.withColumn("top", top).where(F.col("score") >= share * F.col("top") - 1e-9).select("query_id", F.col("doc_id").alias("id"), "score")


def fuse(vector: DataFrame, lexical: DataFrame, threshold: float, gain: float = 0.03, boost: float = 0.05) -> DataFrame:
    """query_id, id, distance, origin of vector hits (query_id, id, distance, boosted) and strong
    lexical hits (query_id, id): what both found comes nearer by `gain`, vector hits with a
    boosting word by `boost`; lexical hits alone enter just inside the threshold."""
    rows = vector.join(lexical.select("query_id", "id", F.lit(True).alias("lexical")), ["query_id", "id"], "full_outer")
    alone, both = F.col("distance").isNull(), F.col("lexical").isNotNull()
    nearer = F.col("distance") - F.when(both, gain).otherwise(0.0) - F.when(F.col("boosted"), boost).otherwise(0.0)
    distance = F.when(alone, threshold - gain).otherwise(nearer)
    origin = F.when(alone, "lexical").when(both, "both").otherwise("vector")
    return rows.select("query_id", "id", distance.alias("distance"), origin.alias("origin"))


def first_per_source(hits: DataFrame, threshold: float, k: int) -> DataFrame:
    """query_id, id, source, distance, place: hits inside the threshold, the first of each source,
    the k best."""
    near = hits.where(F.col("distance") <= threshold)
    order = [F.asc("distance"), F.asc("id")]
    one = near.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy(*order))).where("r = 1")
    return one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= k).drop("r")
