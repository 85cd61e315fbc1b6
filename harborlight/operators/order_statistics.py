"""Exact order statistics of groups of any size, by splitters.

A round splits the range that a wanted rank lies in: approximate percentiles of the range, a sketch
that tasks merge, are its splitters; counting the values on and between them says which of them
is the rank's value, or which stretch holds it. A stretch has about a PARTSth of the range's rows, so
a few rounds leave at most `sorted_rows` rows a rank, and only those are sorted. No task sorts a
group, and a value that many rows share is a splitter and costs nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.sources.folders import written

PARTS, SORTED = 64, 1 << 16


def nth_values(rows: DataFrame, group: str, value: str, places: dict[str, str], sorted_rows: int = SORTED) -> DataFrame:
    """group, n (values that are not null), and for each name of `places` the value at that place
    (an SQL expression of n, from 1); null where there is no such place."""
    rows = rows.where(F.col(value).isNotNull()).select(F.struct(F.col(group).alias("x")).alias("g"), F.col(value).cast("double").alias("v"))
    sizes = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    wanted = sizes.select("g", "n", F.explode(F.array(*[F.expr(f"cast({p} AS bigint)") for p in places.values()])).alias("place")).where("place between 1 and n").distinct()
    # a range is (low, high): open at both ends; `below` values lie before it and `size` in it
    inf = F.lit(float("inf"))
    open_ = wanted.select("g", "place", (-inf).alias("low"), inf.alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("size"))
    found, first = [], True
    while True:
        small = open_.where(F.col("size") <= sorted_rows)
        found.append(finished(rows, small, first))
        open_ = written(open_.where(F.col("size") > sorted_rows), "ranges")
        if open_.isEmpty():
            break
        narrowed = written(split(rows, open_, first), "narrowed")
        found.append(narrowed.where("size = 0").select("g", "place", F.col("low").alias("v")))
        open_, first = narrowed.where("size > 0"), False
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    wide = sizes.join(values.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("place", "v"))).alias("at")), "g", "left") if places else sizes
    return wide.select(F.col("g.x").alias(group), "n", *[F.col("at")[F.expr(f"cast({p} AS bigint)")].alias(name) for name, p in places.items()])


def inside(rows: DataFrame, ranges: DataFrame, first: bool) -> DataFrame:
    """g, low, high, v of the rows in each of some ranges (in the first round a range is a group)."""
    ranges = ranges.select("g", "low", "high").distinct()
    held = rows.join(ranges, "g")
    return held if first else held.where((F.col("v") > F.col("low")) & (F.col("v") < F.col("high")))


def finished(rows: DataFrame, small: DataFrame, first: bool) -> DataFrame:
    """g, place, v of the places whose ranges are sorted."""
    order = Window.partitionBy("g", "low", "high").orderBy("v")
    ranked = inside(rows, small, first).withColumn("r", F.row_number().over(order))
    asked = small.select("g", "low", "high", "place", (F.col("place") - F.col("below")).alias("r"))
    return ranked.join(asked, ["g", "low", "high", "r"]).select("g", "place", "v")


def split(rows: DataFrame, ranges: DataFrame, first: bool) -> DataFrame:
    """The ranges narrowed to a stretch between two splitters, or to one (low is the value, size 0)."""
    held = inside(rows, ranges, first)
    cuts = F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)]), F.lit(10 * PARTS)))
    cuts = written(held.groupBy("g", "low", "high").agg(cuts.alias("cuts")), "splitters")
    # of splitters s0 < s1 < ...: 2 i + 1 is on si, 2 i the stretch before it
    below = F.size(F.filter("cuts", lambda s: s < F.col("v")))
    cell = 2 * below + F.array_contains("cuts", F.col("v")).cast("int")
    counts = held.join(cuts, ["g", "low", "high"]).groupBy("g", "low", "high", cell.alias("cell")).agg(F.count(F.lit(1)).alias("k"), F.first("cuts").alias("cuts"))
    before = Window.partitionBy("g", "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("k").over(before), F.lit(0)))
    asked = ranges.select("g", "low", "high", "place", (F.col("place") - F.col("below")).alias("r"), "below")
    hit = asked.join(counts, ["g", "low", "high"]).where("r > earlier and r <= earlier + k")
    i = (F.col("cell") / 2).cast("int")
    on = F.col("cell") % 2 == 1
    low = F.when(on, F.get("cuts", i)).otherwise(F.coalesce(F.get("cuts", i - 1), F.col("low")))
    high = F.when(on, F.get("cuts", i)).otherwise(F.coalesce(F.get("cuts", i), F.col("high")))
    return hit.select("g", "place", low.alias("low"), high.alias("high"), (F.col("below") + F.col("earlier")).alias("below"), F.when(on, 0).otherwise(F.col("k")).cast("long").alias("size"))
