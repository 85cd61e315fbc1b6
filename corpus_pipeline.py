"""Corpus pipeline: five stages over documents, each one a corpus operator.

Every stage reads all rows that the stage before kept and returns the columns of documents; the
last returns packed pieces. Rows with null texts count as empty texts. A stage's decision takes
effect: toxic documents go, of equal texts the largest doc_id stays, of linked near copies the
smallest doc_id, and repeated byte strings leave the texts (n_chars follows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import exact_dedup, jaccard_join, packing, repeats, toxicity
from harborlight.llm.common import discard, prepare, whole_text, without, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold. The model learns from this stage's own input."""
    prepare(spark)
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.flag(docs.select(*COLUMNS), model).where(~F.col("toxic")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; of rows repeated with both, one."""
    prepare(spark)
    found = written(exact_dedup.exact_dedup(docs, in_files=True), "dedup")  # a stage's input is a table
    # a doc_id may be null or shared by several texts, which all stay
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias("key")
    keyed = docs.withColumn("text_sha256", F.sha2(whole_text(), 256)).select(*COLUMNS, key)
    docs = without(keyed, found.where("not kept").select(key), "key")
    again = written(found.where("kept").groupBy(key).count().where("count > 1"), "repeated-rows")
    if again.isEmpty():
        return docs.select(*COLUMNS)
    # rows repeated with doc_id and text
    unsure = docs.join(again, "key", "left_semi").dropDuplicates(["key"])
    sure = docs.join(again, "key", "left_anti")
    return sure.unionByName(unsure).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked documents the one that names it (null and shared doc_ids: the first
    of its rows); documents without words stay."""
    prepare(spark)
    found = written(jaccard_join.jaccard_groups(docs), "groups")
    return without(docs.select(*COLUMNS, jaccard_join.row_key().alias("key")), found.where("not leads"), "key").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that also start earlier. A character that loses some of
    its bytes goes whole."""
    prepare(spark)
    return repeats.without_repeats(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    prepare(spark)
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard", drop_near_copies),
    ("repeats", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
