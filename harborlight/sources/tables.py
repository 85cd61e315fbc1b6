"""Tables of a scale-factor folder, and the domain views that are derived from them.

The views use integer arithmetic alone, so any engine gives the same rows:
students (customer), answers (customer x items of a scale), sessions (orders), records
(lineitem, banded to severities), turns (conversations), requests (events).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """student_no, batch_id, grade, klass (null for every 20th), completed (has an order)."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("completed", F.lit(True))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(done, "c_custkey", "left")
    return rows.select(
        F.col("c_custkey").alias("student_no"), F.col("n_regionkey").alias("batch_id"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("n_name")).alias("grade"),
        F.when(F.col("c_custkey") % 20 != 0, F.col("c_mktsegment")).alias("klass"), F.coalesce("completed", F.lit(False)).alias("completed"),
    )


STUDENTS = """students AS (
  SELECT c_custkey AS student_no, n_regionkey AS batch_id,
    CASE WHEN c_custkey % 10 <> 0 THEN n_name END AS grade, CASE WHEN c_custkey % 20 <> 0 THEN c_mktsegment END AS klass,
    c_custkey IN (SELECT o_custkey FROM orders) AS completed
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

#: scale_id: items, largest option
SCALES = {"phq_a": (9, 3), "scared": (41, 2), "sdq": (25, 2), "mht": (100, 1)}


def answers(spark: SparkSession, sf_dir: str, scale: str) -> DataFrame:
    """student_no, qid, value."""
    n, m = SCALES[scale]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_no"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("qid"))
    value = f"least({m}, ((student_no * 7919 + qid * 104729 + student_no * qid * 31) % 1000) * ((student_no * 611953) % 1000) * {2 * (m + 1)} div 1000000)"
    return rows.withColumn("value", F.expr(value).cast("int"))


def answers_sql(scale: str, name: str = "answers") -> str:
    n, m = SCALES[scale]
    return f"""{name} AS (
  SELECT c_custkey AS student_no, qid,
    least({m}, ((c_custkey * 7919 + qid * 104729 + c_custkey * qid * 31) % 1000) * ((c_custkey * 611953) % 1000) * {2 * (m + 1)} // 1000000)::INTEGER AS value
  FROM customer CROSS JOIN range(1, {n + 1}) AS r(qid))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assessment records: one a line item, with a scale, a total and a severity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("record_no"), F.col("l_shipdate").cast("timestamp").alias("created_at"),
        F.expr("element_at(array('phq_a', 'scared', 'sdq', 'mht'), cast(l_partkey % 4 + 1 as int))").alias("scale_id"),
        F.col("l_quantity").cast("int").alias("total"),
        F.expr("case when l_quantity <= 10 then 'none' when l_quantity <= 20 then 'mild' when l_quantity <= 30 then 'moderate' when l_quantity <= 45 then 'moderately_severe' else 'severe' end").alias("severity"),
        F.expr("case when l_quantity > 48 then 'elevated' else 'safe' end").alias("crisis_level"),
    )


RECORDS = """records AS (
  SELECT l_orderkey AS session_id, l_linenumber AS record_no, l_shipdate AS created_at,
    (['phq_a', 'scared', 'sdq', 'mht'])[l_partkey % 4 + 1] AS scale_id, l_quantity::INTEGER AS total,
    CASE WHEN l_quantity <= 10 THEN 'none' WHEN l_quantity <= 20 THEN 'mild' WHEN l_quantity <= 30 THEN 'moderate'
      WHEN l_quantity <= 45 THEN 'moderately_severe' ELSE 'severe' END AS severity,
    CASE WHEN l_quantity > 48 THEN 'elevated' ELSE 'safe' END AS crisis_level
  FROM lineitem)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, account_id (null for every 7th), created_at."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("account_id"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


SESSIONS = """sessions AS (
  SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS account_id, o_orderdate AS created_at FROM orders)"""

RANK = {"none": 0, "mild": 1, "moderate": 2, "moderately_severe": 3, "severe": 4}
