"""Alert rules over event tables: values at regular times from sliding windows, and how long a
condition has held.

An event at ts counts at every evaluation time t with t - window < ts <= t; times are multiples of
the step, as numbers of steps since 1970. Windows are multiples of the step.

Events are counted once, by the pane (the step) that they fall in; only panes, a row a step and key,
are spread over the evaluation times whose window holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def evaluations(events: DataFrame, window: int, step: int, *keys: str, **values: Column) -> DataFrame:
    """keys, k (evaluation time in steps) and the aggregates `values`, counts or sums; times without
    events have no row. window and step in seconds."""
    first = F.ceil(F.unix_micros("ts") / (step * 1_000_000))
    panes = events.withColumn("pane", first).groupBy(*keys, "pane").agg(*[v.alias(n) for n, v in values.items()])
    spread = panes.withColumn("k", F.explode(F.sequence("pane", F.col("pane") + (window // step - 1))))
    return spread.groupBy(*keys, "k").agg(*[F.sum(n).alias(n) for n in values])


def gap_filled(evaluated: DataFrame, value: str) -> DataFrame:
    """k, value for every time between the first and the last one: 0 where there is no row.

    One row of bounds gives one row a step; the events are not touched.
    """
    bounds = evaluated.agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a is not null")
    every = bounds.select(F.explode(F.sequence("a", "b")).alias("k"))
    return every.join(evaluated.select("k", value), "k", "left").select("k", F.coalesce(value, F.lit(0)).alias(value))


def held(bad: DataFrame, step: int, hold: int, *keys: str) -> DataFrame:
    """keys, start, fires, end of every stretch of consecutive times k in `bad` that lasts `hold`
    seconds or more; fires is when it has lasted that long."""
    island = F.col("k") - F.row_number().over(Window.partitionBy(*keys).orderBy("k"))
    rows = bad.select(*keys, "k").withColumn("island", island).groupBy(*keys, "island").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    time = lambda k: F.timestamp_seconds(k * step).cast("timestamp_ntz")
    return rows.where((F.col("b") - F.col("a")) * step >= hold).select(*keys, time(F.col("a")).alias("start"), time(F.col("a") + hold // step).alias("fires"), time(F.col("b")).alias("end"))


def held_sql(bad: str, step: int, hold: int, keys: str = "") -> str:
    """The same over a DuckDB relation `bad` of (keys, k)."""
    by = f"PARTITION BY {keys} " if keys else ""
    front = f"{keys}, " if keys else ""
    time = lambda k: f"make_timestamp(({k}) * {step} * 1000000)"
    return (
        f"SELECT {front}{time('min(k)')} AS start, {time(f'min(k) + {hold // step}')} AS fires, {time('max(k)')} AS \"end\" "
        f"FROM (SELECT *, k - row_number() OVER ({by}ORDER BY k) AS island FROM {bad}) GROUP BY {front}island HAVING (max(k) - min(k)) * {step} >= {hold}"
    )


def evaluations_sql(window: int, step: int, values: str, keys: str = "", where: str = "true") -> str:
    front = f"{keys}, " if keys else ""
    first = f"ceil(epoch_us(ts) / {step * 1_000_000})::BIGINT"
    return f"SELECT {front}k, {values} FROM (SELECT *, unnest(range({first}, {first} + {window // step})) AS k FROM events WHERE {where}) GROUP BY {front}k"
