"""Weekly topic counts of an event stream: state by (week, topic), dropped behind the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.sources.folders import work_path


def weekly_topics(events: DataFrame, lateness: str = "14 days") -> DataFrame:
    """week, topic, n of a stream of (ts, topic). Windows start on Mondays."""
    week = F.window("ts", "7 days", startTime="4 days")
    return events.withWatermark("ts", lateness).groupBy(week.alias("w"), "topic").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week"), "topic", "n")


def run_once(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Take all that the stream has now and return the latest count of every (week, topic)."""
    path = work_path(spark, "topics")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    weekly_topics(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("week timestamp, topic string, n long, batch long").option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.groupBy("week", "topic").agg(F.max_by("n", "batch").alias("n"))
