"""Operator 1: quality by a sparse rule ensemble.

Statistics of each whole text (character classes, words, repetition) are computed in Arrow
batches. Shallow random-forest trees over them are taken apart: every root-to-node path is a
conjunctive rule. A lasso logistic regression weighs the rules, most get weight 0, and the rest
compile into one Spark column expression over the statistics, which scores the table.

Learning uses a bounded sample (SAMPLE rows per class). Defined results: null and empty texts
have all statistics 0 and are scored like any other; very long texts are read whole; repeated
rows score alike; a null doc_id stays null; with labels of fewer than two classes the score is
the share of label 1 (0.5 without labels); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import documents, slices, whole_text, written
from harborlight.llm.kernels import IS_SPACE, utf8, words
from harborlight.llm.labelled import fold, sample

#: Labelled rows learnt from, at most, by class.
SAMPLE = {0: 4000, 1: 6000}
TREES, DEPTH, LASSO = 16, 3, 0.002
THRESHOLD = 0.3
STATISTICS = (
    "bytes_log", "words_log", "word_bytes", "upper", "digits", "symbols", "bangs", "bars", "stops",
    "line_words", "high_bytes", "spaces", "distinct_words", "top_word", "repeated_trigrams", "repeated_lines",
)


def _class(*codes: int | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for c in codes:
        table[list(c) if isinstance(c, range) else c] = True
    return table


UPPER, DIGIT, HIGH = _class(range(65, 91)), _class(range(48, 58)), _class(range(128, 256))
SYMBOL, BANG, BAR, STOP = _class(*map(ord, "#$%&*@^_~<>=+{}[]\\/")), _class(ord("!")), _class(ord("|")), _class(*map(ord, ".,;:?"))


def text_statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of STATISTICS per text."""
    rows, size = len(off) - 1, np.diff(off).astype(float)
    some = np.maximum(size, 1)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=sums[1:])
        return (sums[off[1:]] - sums[off[:-1]]) / some

    code, row, start = words(raw, off)
    n = np.bincount(row, minlength=rows).astype(float)
    spaces, edge = share(IS_SPACE), np.zeros(rows + 1, np.int64)
    np.cumsum(n.astype(np.int64), out=edge[1:])
    lines_at = np.flatnonzero(raw == 10)
    lines = np.bincount(np.searchsorted(off, lines_at, side="right") - 1, minlength=rows)[:rows] + 1.0
    distinct, top, thrice, again = (np.zeros(rows) for _ in range(4))
    for r in range(rows):
        own = code[edge[r] : edge[r + 1]]
        if not len(own):
            continue
        _, counts = np.unique(own, return_counts=True)
        distinct[r], top[r] = len(counts) / len(own), counts.max() / len(own)
        if len(own) > 3:
            tri = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(0x9E3779B97F4A7C15) + (own[2:] ^ np.uint64(0x94D049BB133111EB))
            thrice[r] = 1 - len(np.unique(tri)) / len(tri)
        body = raw[off[r] : off[r + 1]].tobytes().split(b"\n")
        again[r] = 1 - len(set(body)) / len(body)
    word_bytes = np.where(n > 0, (1 - spaces) * size / np.maximum(n, 1), 0)
    columns = [np.log1p(size), np.log1p(n), word_bytes, share(UPPER), share(DIGIT), share(SYMBOL), share(BANG), share(BAR), share(STOP), n / lines, share(HIGH), spaces, distinct, top, thrice, again]
    return np.column_stack(columns)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep` and the statistics of `text` as doubles."""
    table = docs.select(*keep, whole_text().alias("text"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in table.schema.fields[:-1]] + [f"{s} double" for s in STATISTICS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                x = text_statistics(*utf8(piece.column(len(keep))))
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(keep)], *(pa.array(c) for c in np.ascontiguousarray(x.T))], [*keep, *STATISTICS])

    return table.mapInArrow(run, schema)


@dataclass(frozen=True)
class RuleModel:
    """Weighted conjunctions of (statistic, is_above, threshold) and an intercept."""

    bias: float
    rules: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        z = reduce(lambda a, b: a + b, [F.lit(self.bias), *(F.when(condition(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.rules)])
        return 1 / (1 + F.exp(-z))


def condition(rule: tuple[tuple[str, bool, float], ...]) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(s) > t) if above else (F.col(s) <= t) for s, above, t in rule])


def tree_rules(model) -> list[tuple[tuple[str, bool, float], ...]]:
    """Every path from a root to an inner node or leaf, conditions sorted, each rule once."""
    found: dict[tuple, None] = {}

    def walk(node, path: tuple) -> None:
        if path:
            found.setdefault(tuple(sorted(path)))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = STATISTICS[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, False, at)))
            walk(node.rightChild(), (*path, (name, True, at)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def fit(rows: DataFrame) -> RuleModel:
    """rows: statistics, y, weight."""
    total = {r["y"]: r["w"] for r in rows.groupBy("y").agg(F.sum("weight").alias("w")).collect()}  # a row per class
    if len(total) < 2:
        share = min(max(total.get(1, 0.0) / sum(total.values()), 1e-3), 1 - 1e-3) if total else 0.5
        return RuleModel(math.log(share / (1 - share)), ())
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(rows).withColumn("label", F.col("y").cast("double"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="0.5", seed=7).fit(table.select("x", "label", "weight"))
    rules = tree_rules(forest)
    held = F.array(*[condition(r).cast("double") for r in rules])
    binary = table.select(array_to_vector(held).alias("r"), "label", "weight")
    lasso = LogisticRegression(featuresCol="r", labelCol="label", weightCol="weight", regParam=LASSO, elasticNetParam=1.0, maxIter=60, standardization=False).fit(binary)
    return RuleModel(float(lasso.intercept), tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients) if w))


def learn(docs: DataFrame, labels: DataFrame) -> RuleModel:
    texts = sample(docs, labels, "quality", fold(5) != 0, SAMPLE, "quality-sample")
    return fit(written(statistics(texts, ["y", "weight"]), "quality-statistics"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    scored = rows.select("doc_id", (fold(5) == 0).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
