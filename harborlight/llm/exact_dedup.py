"""Operator 3: exact deduplication as a stateful stream.

A feed of (digest, doc_id, content locator) runs through a streaming aggregation whose keyed
state lives on disk (RocksDB, checkpointed in the shared folder) and never expires: there is no
watermark. Per digest it keeps the document that stays (largest doc_id), the locator of its
content (file and row) and the number of documents. Spark combines the feed by digest in each task before it
is shuffled, so a text that a third of all rows share reaches the state as one row per task. A
digest with one document is that document's result; no join is needed for it.

A state can be fed again: the answer for a later feed counts and keeps over all feeds so far.

Digests only propose hits. Every document whose digest is held by another one is compared with
the kept document's full bytes, which are read through the locator, from an earlier feed's file
too; rows that differ (a collision, in one feed) are regrouped by their text. Texts whose digest is surely single stay out of that join, and the rows
of a digest are dealt to SALTS parts, so no task gets a whole large group.

Defined results: a null text counts as empty; a null doc_id is smaller than any other, and rows
without any doc_id in their group keep each other as null; rows repeated with the same doc_id
and text count separately in group_size and all carry kept = true where that doc_id stays;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import documents, prefilter, whole_text, work_path, written

SALTS = 32
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DigestState:
    """Running state of a digest feed. Feed it again later with the same path: it continues."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def absorb(self, feed: DataFrame) -> None:
        """Take all that `feed` (a streaming DataFrame of digest, doc_id, locator, text_sha256) has now."""
        changed, out = f"{self.path}/changed", feed.groupBy("digest").agg(
            F.max(F.struct("doc_id", "locator", "text_sha256")).alias("kept"), F.count(F.lit(1)).alias("group_size")
        )

        def keep(batch: DataFrame, number: int) -> None:
            # the same batch replayed after a failure overwrites its own folder
            batch.write.mode("overwrite").parquet(f"{changed}/batch={number}")

        conf, key = self.spark.conf, "spark.sql.streaming.stateStore.providerClass"
        before = conf.get(key)
        conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # else each state partition reserves megabytes of disk
        conf.set(key, ROCKSDB)
        try:
            run = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
        finally:
            conf.set(key, before)

    def last_batch(self) -> int:
        """The number of the last batch taken, -1 before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/changed")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), default=-1)

    def groups(self, since: int = -1) -> DataFrame:
        """digest, keep_id, locator, text_sha256, group_size as of the last batch that changed the
        digest, of those that a batch after `since` has changed."""
        schema = "digest string, kept struct<doc_id: long, locator: string, text_sha256: string>, group_size long, batch long"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/changed").parquet(f"{self.path}/changed")
        last = rows.groupBy("digest").agg(F.max_by(F.struct("kept", "group_size"), "batch").alias("s"), F.max("batch").alias("batch")).where(F.col("batch") > since)
        return last.select("digest", F.col("s.kept.doc_id").alias("keep_id"), F.col("s.kept.locator").alias("locator"), F.col("s.kept.text_sha256").alias("text_sha256"), "s.group_size")


def located(docs: DataFrame, in_files: bool) -> DataFrame:
    """doc_id, text (null: empty) and locator, the file and the row in it, of every row of docs.

    in_files: docs are as they lie in files that stay. If not, or if docs are not of files, they are
    written to the shared folder first.
    """
    rows = docs
    try:
        if not in_files:
            raise AnalysisException("not in files")
        where = docs.metadataColumn("_metadata")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", where["file_path"].alias("file"), where["row_index"].alias("row"))
    except AnalysisException:
        held = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "content")
        where = held.metadataColumn("_metadata")
        rows = held.select("doc_id", "text", where["file_path"].alias("file"), where["row_index"].alias("row"))
    return rows.select("doc_id", whole_text().alias("text"), F.concat_ws("#", "file", F.col("row").cast("string")).alias("locator"))


def fetched(groups: DataFrame) -> DataFrame:
    """digest, held: the kept text of every group, read from the files that the locators name."""
    spark = groups.sparkSession
    asked = groups.select("digest", "locator")
    files = [r["file"] for r in asked.select(F.expr("left(locator, length(locator) - length(substring_index(locator, '#', -1)) - 1)").alias("file")).distinct().collect()]  # a row a file
    if not files:
        return asked.select("digest", F.lit("").alias("held")).limit(0)
    # metadata has paths as URLs; readers take them plainly, with glob characters behind a backslash
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for f in sorted(files)]
    texts = spark.read.schema("text string").parquet(*paths)
    where = texts.metadataColumn("_metadata")
    texts = texts.select(whole_text().alias("held"), F.concat_ws("#", where["file_path"], where["row_index"].cast("string")).alias("locator"))
    return prefilter(texts, asked, "locator").join(asked.hint("merge"), "locator").select("digest", "held")


def exact_dedup(docs: DataFrame, digest: Column | None = None, files_per_batch: int | None = None, state: DigestState | None = None, in_files: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs (doc_id, text).

    digest: the state key; by default the text's SHA-256. A weaker one gives the same result for
    one feed. files_per_batch: files of the feed in a micro-batch; by default all that are there.
    state: the state to continue, whose earlier rows count, too; by default a new one.
    """
    spark = docs.sparkSession
    sha = F.sha2(F.col("text"), 256)
    rows = located(docs, in_files).withColumn("text_sha256", sha).withColumn("digest", sha if digest is None else digest.cast("string"))
    state = state or DigestState(spark, work_path(spark, "dedup"))
    before = state.last_batch()
    landed = f"{state.path}/feed"
    rows.select("doc_id", "digest", "text_sha256", "locator").write.mode("append").parquet(landed)
    source = spark.readStream.schema("doc_id long, digest string, text_sha256 string, locator string")
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    state.absorb(source.parquet(landed))
    groups = written(state.groups(before), "groups")
    alone = groups.where("group_size = 1").withColumn("doc_id", F.col("keep_id"))
    return alone.select(*result()).unionByName(resolve(rows.drop("locator"), groups.where("group_size > 1").drop("text_sha256")))


def result() -> list[Column]:
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return [F.col("doc_id"), F.col("keep_id"), F.col("group_size"), kept, F.col("text_sha256")]


def resolve(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Check each hit's full bytes against the kept document's; split collisions by their text."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(SALTS)).cast("int"))
    # whole texts are shuffled once, here; what follows reads the texts of hits alone
    hits = prefilter(salted, groups, "digest").join(groups.select("*", parts).hint("merge"), ["digest", "salt"])
    hits = written(hits, "hit-texts")
    holders = fetched(groups).join(hits.select("digest", "salt").distinct(), "digest")  # to the parts that have rows
    checked = hits.join(holders, ["digest", "salt"]).select("digest", "salt", "doc_id", "text_sha256", "keep_id", "group_size", (F.col("text") == F.col("held")).alias("same"))
    checked = written(checked, "hits")
    mixed = checked.where("not same").select("digest").distinct().select("digest", parts)
    sound = checked.join(mixed, ["digest", "salt"], "left_anti").select(*result())
    apart = hits.select("digest", "salt", "doc_id", "text", "text_sha256").join(mixed, ["digest", "salt"], "left_semi")
    by_text = apart.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return sound.unionByName(apart.join(by_text.select("*", parts), ["text", "salt"]).select(*result()))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), in_files=True)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept,
       sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
