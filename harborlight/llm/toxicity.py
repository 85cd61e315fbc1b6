"""Operator 8: toxicity by multiple-instance learning.

A sentence is a bag of words and word prefixes; its probability is a logistic function of the
features it holds. A document is toxic unless none of its sentences is: noisy-or combines the
sentence probabilities. Weights are learnt from document labels alone, by maximising the
likelihood of the noisy-or with an L1 penalty, on a bounded sample (SAMPLE rows per class).
Scoring reads every sentence of every text and also returns the offending sentences' spans.

Defined results: a null or empty text has no sentence and scores 0; very long texts are read
whole, sentence by sentence; repeated rows score alike; a null doc_id stays null; with few toxic
labelled texts a feature needs fewer of them, at least one; where no feature tells the classes
apart, or labels of one class are missing, every score is the share of toxic labels (0 without
labels), no sentence offends, and `flag` keeps all documents; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from harborlight.llm.common import documents, whole_text
from harborlight.llm.labelled import fold, sample

#: Labelled rows learnt from, at most, by class (0: clean, 1: toxic).
SAMPLE = {0: 4000, 1: 3000}
#: Features that may get a weight, and the least number of toxic sample texts that hold one
#: (half of the toxic texts, where that is less).
FEATURES, LEAST_TEXTS = 400, 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"[^\W\d_]+")
SCORED = "doc_id long, score double, sentences array<struct<start: int, end: int, score: double>>"


@dataclass(frozen=True)
class SentenceModel:
    bias: float
    weights: dict[str, float]
    share: float = 0.0  # of toxic labels: the score of all texts if there is no weight

    def features(self, word: str) -> list[str]:
        return [f for f in (word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n)) if f in self.weights]


def softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def candidates(rows: DataFrame) -> list[str]:
    """Features most over-represented in toxic sample texts; at most FEATURES strings."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1)))
    prefix = [F.transform(F.filter("w", lambda x, n=n: F.length(x) >= n), lambda x, n=n: F.concat(F.lit("^"), F.substring(x, 1, n))) for n in PREFIXES]
    bags = rows.select("y", words.alias("w")).select("y", F.explode(F.array_distinct(F.concat("w", *prefix))).alias("feature"))
    size = rows.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()  # one row
    p, n = size["p"] or 0, size["n"] or 0
    if not p or not n:
        return []
    a, b = F.sum("y"), F.sum(1 - F.col("y"))
    counted = bags.groupBy("feature").agg(a.alias("a"), b.alias("b")).where(F.col("a") >= min(LEAST_TEXTS, -(-p // 2)))
    share = (F.col("a") + F.col("b")) / (p + n)
    z = (F.col("a") / p - F.col("b") / n) / F.sqrt(share * (1 - share) * (1 / p + 1 / n) + 1e-9)
    top = counted.withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "feature").limit(FEATURES)
    return [r["feature"] for r in top.select("feature").collect()]


def fit(rows: DataFrame, penalty: float = 0.3, steps: int = 400) -> SentenceModel:
    """Noisy-or likelihood of document labels, maximised by proximal Adam on the driver.

    The driver holds the feature hits of the bounded sample only, never texts: for each text its
    different sets of features and how many sentences hold each, so a long text that says the
    same again costs no more than once.
    """
    classes = rows.groupBy("y").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    classes = {r["y"]: r["w"] for r in classes.collect()}  # a row per class
    share = classes.get(1, 0.0) / sum(classes.values()) if classes else 0.0
    names = candidates(rows)
    if not names:
        return SentenceModel(-30.0, {}, share)
    probe = SentenceModel(0.0, dict.fromkeys(names, 1.0))
    index = {f: i for i, f in enumerate(names)}

    def bags(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text, y, weight in zip(part["text"], part["y"], part["weight"]):
                sets = Counter(tuple(sorted({index[f] for w in set(WORD.findall(m[0].lower())) for f in probe.features(w)})) for m in SENTENCE.finditer(text))
                plain = sets.pop((), 0)
                held = sorted(sets)
                out.append((y, weight, plain, [sets[k] for k in held], [i for i, k in enumerate(held) for _ in k], [f for k in held for f in k]))
            yield pd.DataFrame(out, columns=["y", "weight", "plain", "times", "sentence", "feature"])

    data = rows.mapInPandas(bags, "y int, weight double, plain long, times array<int>, sentence array<int>, feature array<int>").toPandas()
    y, weight, plain = data["y"].to_numpy(float), data["weight"].to_numpy(float), data["plain"].to_numpy(float)
    counts = np.array([len(x) for x in data["times"]], np.int64)
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(data)), counts)
    none = np.zeros(0, np.int64)
    times = np.concatenate([none, *(np.asarray(x, np.int64) for x in data["times"])])
    at = np.concatenate([none, *(np.asarray(x, np.int64) + f for x, f in zip(data["sentence"], first))])
    feature = np.concatenate([none, *(np.asarray(x, np.int64) for x in data["feature"])])
    sentences = plain + np.bincount(owner, times, len(data))
    theta = np.zeros(len(names) + 1)
    theta[-1] = math.log(max(share, 1e-4) * 0.1 / max(1.0, np.mean(sentences)))
    m, v, rate = np.zeros_like(theta), np.zeros_like(theta), 0.05
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(at, theta[feature], len(owner))
        total = plain * softplus(theta[-1]) + np.bincount(owner, times * softplus(z), len(y))
        total = np.maximum(total, 1e-9)
        slope = weight * np.where(y == 1, -np.exp(-total) / -np.expm1(-total), 1.0)
        gz = times * slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feature, gz[at], len(names)), np.sum(gz) + np.sum(slope * plain) / (1 + math.exp(-theta[-1])))
        grad /= len(y)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - rate * penalty / len(y) ** 0.5, 0)
    return SentenceModel(float(theta[-1]), {f: float(w) for f, w in zip(names, theta) if abs(w) > 1e-3}, share)


def sentence_scores(text: str, model: SentenceModel, memo: dict[str, list[str] | None], offending: float) -> tuple[float, list[dict]]:
    """The document's noisy-or score and its sentences that score at least `offending`."""
    if not model.weights:
        return model.share, []
    none, found, base = 0.0, [], math.log1p(math.exp(model.bias))
    for s in SENTENCE.finditer(text):
        held: set[str] = set()
        for w in set(WORD.findall(s[0].lower())):
            hit = memo.get(w, 0)
            if hit == 0:
                if len(memo) > 400_000:
                    memo.clear()
                hit = memo[w] = model.features(w) or None
            if hit:
                held.update(hit)
        if held:
            z = model.bias + sum(model.weights[f] for f in sorted(held))
            none += float(np.logaddexp(0.0, z))
            if (p := 1 / (1 + math.exp(-z))) >= offending:
                found.append({"start": s.start(), "end": s.end(), "score": p})
        else:
            none += base
    return -math.expm1(-none), found


def score(docs: DataFrame, model: SentenceModel, offending: float = THRESHOLD) -> DataFrame:
    """doc_id, score, and the sentences (character spans) that score at least `offending`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str] | None] = {}
        for batch in batches:
            rows = [sentence_scores(t, model, memo, offending) for t in batch.column(1).to_pylist()]
            spans = pa.array([r[1] for r in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), spans], ["doc_id", "score", "sentences"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCORED)


def flag(docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all columns and `toxic` (its own is replaced): the score reaches the threshold and
    rests on some feature. No join is needed."""
    docs = docs.drop("toxic")
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[str] | None] = {}
        for batch in batches:
            toxic = [bool(model.weights) and sentence_scores(t or "", model, memo, 2.0)[0] >= threshold for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(toxic, pa.bool_())], [*batch.schema.names, "toxic"])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField("toxic", BooleanType())]))


def learn(docs: DataFrame, labels: DataFrame) -> SentenceModel:
    return fit(sample(docs, labels, "toxic", fold(4) != 2, SAMPLE, "toxic-sample"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select(
        "doc_id", (fold(4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("sentences").alias("n_offending"), "sentences",
    )
