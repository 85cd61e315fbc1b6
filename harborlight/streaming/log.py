"""From logged JSON lines to the weekly report, in one stream.

Lines are read as text, so that each is accounted for: one that does not parse, or has no time, is
bad; one whose time is `lateness` or more behind the latest of the batches before is late. The
rest is added to the report's state, which a batch writes as one row a week, topic and mode, and the first
FIRSTS distances of each week and topic. Every batch writes a folder of its own, under its number, so
a batch that runs again after a failure replaces itself, and the report reads all folders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIRSTS = 5
LINE = "ts timestamp, event_id long, topic string, mode long, distance double, bad string"
MARKS = "lines long, bad long, late long, latest timestamp, batch long"
COUNTS = "week string, topic string, mode long, k long, batch long"
FIRST = "week string, topic string, ts timestamp, event_id long, distance double, batch long"


def iso_week(ts: str) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def mode_counts(rows: DataFrame) -> DataFrame:
    """week, topic, mode, k of rows with a week."""
    return rows.groupBy("week", "topic", "mode").agg(F.count(F.lit(1)).alias("k"))


def firsts(rows: DataFrame) -> DataFrame:
    """The first FIRSTS rows of each week and topic by time; Spark keeps as many a task before it shuffles."""
    order = Window.partitionBy("week", "topic").orderBy("ts", "event_id")
    rows = rows.select("week", "topic", "ts", "event_id", "distance")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= FIRSTS).drop("r")


def report(counts: DataFrame, first: DataFrame, flag_at: int) -> DataFrame:
    """The report's rows from mode counts and first rows, which may come in any number of parts."""
    counts = counts.groupBy("week", "topic", "mode").agg(F.sum("k").alias("k"))
    line = F.transform(F.collect_list(F.struct("mode", "k")), lambda x: F.concat_ws(":", x["mode"].cast("string"), x["k"].cast("string")))
    rows = counts.groupBy("week", "topic").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list("mode")).alias("modes"), F.sort_array(line).alias("frequencies"))
    held = firsts(first).groupBy("week", "topic").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "distance"))).alias("f"))
    rows = rows.join(held, ["week", "topic"])
    return rows.select("week", "topic", "n", (F.col("n") >= flag_at).alias("flagged"), "modes", F.transform("f", lambda x: x["distance"]).alias("firsts"), "frequencies")


def weekly_report(events: DataFrame, flag_at: int) -> DataFrame:
    """The report of a table (ts, event_id, topic, mode, distance)."""
    rows = events.withColumn("week", iso_week("ts"))
    return report(mode_counts(rows), rows, flag_at)


def parsed(lines: DataFrame) -> DataFrame:
    """The lines' fields and is_bad; blank lines are none."""
    rows = lines.where(F.trim("value") != "").select(F.from_json(F.regexp_replace("value", "^\ufeff", ""), LINE, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}).alias("e"))
    is_bad = F.col("e.bad").isNotNull() | F.col("e.ts").isNull()
    return rows.select("e.*", is_bad.alias("is_bad")).drop("bad")


class LogReport:
    """A report that is continued whenever there are new lines. path: a shared folder of its own."""

    def __init__(self, spark: SparkSession, path: str, lateness_days: int = 14):
        self.spark, self.path, self.lateness = spark, path.rstrip("/"), lateness_days

    def _table(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", folder).parquet(folder)

    def _take(self, batch: DataFrame, number: int) -> None:
        before = None
        if number:
            # one row a batch; a batch that runs again does not see its own
            before = self._table("marks", MARKS).where(F.col("batch") < number).agg(F.max("latest").alias("t")).first()["t"]
        is_late = F.lit(False) if before is None else ~F.col("is_bad") & (F.col("ts") <= F.lit(before) - F.make_dt_interval(F.lit(self.lateness)))
        batch = batch.withColumn("is_late", is_late).persist()
        try:
            good = batch.where("not is_bad and not is_late").withColumn("week", iso_week("ts"))
            for name, rows in (("counts", mode_counts(good)), ("firsts", firsts(good))):
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
            marks = batch.agg(F.count(F.lit(1)).alias("lines"), F.count_if("is_bad").alias("bad"), F.count_if("is_late").alias("late"), F.max("ts").alias("latest"))
            marks.write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")
        finally:
            batch.unpersist()

    def absorb(self, lines: DataFrame):
        """Take all lines that the stream (column value) has now; the finished query, whose progress
        has the line counts of each batch as observed metrics."""
        rows = parsed(lines).observe("lines", F.count(F.lit(1)).alias("lines"), F.count_if("is_bad").alias("bad"))
        run = rows.writeStream.foreachBatch(self._take).option("checkpointLocation", f"{self.path}/state").trigger(availableNow=True).start()
        run.awaitTermination()
        return run

    def totals(self) -> DataFrame:
        """lines, bad, late so far."""
        return self._table("marks", MARKS).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines", "bad", "late")])

    def rows(self, flag_at: int) -> DataFrame:
        return report(self._table("counts", COUNTS), self._table("firsts", FIRST), flag_at)
