"""Questionnaire scoring as grouped sums over (student, item, value) rows.

Item roles are small literal sets; every scale is one grouping by student, so a scale of any
length costs one shuffle of partially aggregated sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: items of the scales
PHQ_CRISIS = (9,)
SDQ_REVERSE = (7, 11, 14, 21, 25)
SDQ_FACTORS = {
    "emotional": (3, 8, 13, 16, 24),
    "conduct": (5, 7, 12, 18, 22),
    "hyperactivity": (2, 10, 15, 21, 25),
    "peer": (6, 11, 14, 19, 23),
    "prosocial": (1, 4, 9, 17, 20),
}
MHT_FACTORS = {
    "study": tuple(range(1, 16)),
    "people": tuple(range(16, 26)),
    "lonely": tuple(range(26, 36)),
    "blame": tuple(range(36, 46)),
    "sensitive": tuple(range(46, 56)),
    "body": tuple(range(56, 71)),
    "fear": tuple(range(71, 81)),
    "impulse": (81, 83, 85, 87, 89, 91, 93, 95, 97, 99),
}
MHT_VALIDITY = (82, 84, 86, 88, 90, 92, 94, 96, 98, 100)
MHT_CRISIS = (85, 97)
PHQ_BANDS = ((4, "none"), (9, "mild"), (14, "moderate"), (19, "moderately_severe"), (27, "severe"))
SCARED_BANDS = ((24, "none"), (50, "mild"), (82, "moderate"))
SDQ_BANDS = ((15, "none"), (19, "mild"), (40, "moderate"))


def banded(value: Column, bands: tuple[tuple[int, str], ...]) -> Column:
    """The label of the first band whose upper bound is not below value; the last one beyond."""
    out = None
    for upper, label in bands[:-1]:
        out = F.when(value <= upper, label) if out is None else out.when(value <= upper, label)
    return out.otherwise(bands[-1][1])


def sum_of(items: tuple[int, ...], value: Column | None = None) -> Column:
    return F.sum(F.when(F.col("qid").isin(*items), F.col("value") if value is None else value).otherwise(0))


def validate(answers: DataFrame, items: int, most: int) -> DataFrame:
    """missing, unknown and bad item ids of each record (sorted), and whether it can be scored."""
    known = F.col("qid").between(1, items)
    rows = answers.groupBy("student_no").agg(
        F.sort_array(F.collect_set("qid")).alias("ids"),
        F.sort_array(F.collect_set(F.when(known & ~F.col("value").between(0, most), F.col("qid")))).alias("bad"),
    )
    wanted = F.sequence(F.lit(1).cast("long"), F.lit(items).cast("long"))
    rows = rows.withColumn("missing", F.array_except(wanted, "ids")).withColumn("unknown", F.array_except("ids", wanted))
    return rows.select("student_no", "missing", "unknown", "bad", (F.size("missing") + F.size("unknown") + F.size("bad") == 0).alias("valid"))


def phq(answers: DataFrame) -> DataFrame:
    rows = answers.groupBy("student_no").agg(F.sum("value").alias("total"), sum_of(PHQ_CRISIS).alias("risk"))
    return rows.select("student_no", "total", banded(F.col("total"), PHQ_BANDS).alias("severity"), F.when(F.col("risk") > 0, "elevated").otherwise("safe").alias("crisis_level"))


def scared(answers: DataFrame) -> DataFrame:
    rows = answers.groupBy("student_no").agg(F.sum("value").alias("total"))
    return rows.select("student_no", "total", banded(F.col("total"), SCARED_BANDS).alias("severity"), F.lit("safe").alias("crisis_level"))


def sdq(answers: DataFrame) -> DataFrame:
    value = F.when(F.col("qid").isin(*SDQ_REVERSE), 2 - F.col("value")).otherwise(F.col("value"))
    rows = answers.groupBy("student_no").agg(*[sum_of(i, value).alias(n) for n, i in SDQ_FACTORS.items()])
    rows = rows.withColumn("total", F.expr("emotional + conduct + hyperactivity + peer"))
    return rows.select("student_no", *SDQ_FACTORS, "total", F.expr("emotional + peer").alias("internalising"), F.expr("conduct + hyperactivity").alias("externalising"), banded(F.col("total"), SDQ_BANDS).alias("severity"))


def mht(answers: DataFrame) -> DataFrame:
    rows = answers.groupBy("student_no").agg(*[sum_of(i).alias(n) for n, i in MHT_FACTORS.items()], sum_of(MHT_VALIDITY).alias("validity"), sum_of(MHT_CRISIS).alias("risk"))
    rows = rows.withColumn("total", sum((F.col(n) for n in MHT_FACTORS), F.lit(0))).withColumn("top", F.greatest(*MHT_FACTORS))
    # fixed values: limits of the total and of the highest factor, here and for the validity items below
    level = F.when(F.col("total") >= 65, "severe").when(F.col("top") >= 8, "moderate").when(F.col("top") >= 4, "mild").otherwise("none")
    return rows.select("student_no", *MHT_FACTORS, "validity", "total", level.alias("severity"), (F.col("validity") >= 7).alias("doubtful"), F.when(F.col("risk") > 0, "elevated").otherwise("safe").alias("crisis_level"))


def share_band(share: Column) -> Column:
    """Severity of a sub-dimension by the share of its largest score."""
    # fixed values: limits of the bands
    return F.when(share < 0.30, "none").when(share < 0.50, "mild").when(share < 0.70, "moderate").when(share < 0.85, "moderately_severe").otherwise("severe")


def profile(answers: DataFrame, dimensions: dict[str, tuple[int, ...]], most: int, inverse: tuple[str, ...] = ()) -> DataFrame:
    """student_no, ordinal, dimension, raw, max, pct, severity, level of every sub-dimension."""
    sums = answers.groupBy("student_no").agg(*[sum_of(i).alias(n) for n, i in dimensions.items()])
    cells = [F.struct(F.lit(k).alias("ordinal"), F.lit(n).alias("dimension"), F.col(n).alias("raw"), F.lit(len(i) * most).alias("max"), F.lit(n in inverse).alias("inverse")) for k, (n, i) in enumerate(dimensions.items())]
    rows = sums.select("student_no", F.inline(F.array(*cells)))
    share = F.when(F.col("inverse"), 1 - F.col("raw") / F.col("max")).otherwise(F.col("raw") / F.col("max"))
    rows = rows.withColumn("share", share).withColumn("severity", share_band(F.col("share")))
    level = F.when(F.col("severity") == "none", "low").when(F.col("severity").isin("mild", "moderate"), "mid").otherwise("high")
    return rows.select("student_no", "ordinal", "dimension", "raw", "max", (F.col("share") * 100).cast("int").alias("pct"), "severity", level.alias("level"))
