"""Queries over event streams: counters, rates, quantiles, A/B groups and rate limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harborlight.operators import alerts as A
from harborlight.operators.order_statistics import nth_values
from harborlight.plans.registry import query
from harborlight.sources.folders import work_path
from harborlight.sources.tables import table
from harborlight.streaming.limiter import admitted, decided_stream, last_admitted
from harborlight.streaming.log import weekly_report

BUCKETS = (1.0, 2.0, 5.0, 10.0, 20.0, 50.0)


def events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SRC04_event_reader", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-10'")
def src04(spark, d):
    rows = events(spark, d).where("event_type in ('click', 'view') and ts >= timestamp'2024-01-10'")
    return rows.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("FLT05_caller_whitelist", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'signup') GROUP BY 1")
def flt05(spark, d):
    return events(spark, d).where(F.col("event_type").isin("click", "signup")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


_PASSED = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE value < 10 END"


@query("FLT06_weak_signal", f"SELECT event_id FROM events WHERE ({_PASSED}) IS FALSE")
def flt06(spark, d):
    return events(spark, d).withColumn("passed", F.expr(_PASSED)).where("passed <=> false").select("event_id")


@query("FLT07_weak_results", """SELECT event_id FROM (SELECT *, string_split(event_type || CASE WHEN event_id % 3 = 0 THEN ',method' ELSE '' END, ',') AS tags FROM events)
  WHERE value < 10 AND (event_id % 7 = 0 OR NOT list_has_any(tags, ['method', 'skill']))""")
def flt07(spark, d):
    tags = F.split(F.concat("event_type", F.expr("case when event_id % 3 = 0 then ',method' else '' end")), ",")
    rows = events(spark, d).withColumn("tags", tags)
    return rows.where((F.col("value") < 10) & ((F.col("event_id") % 7 == 0) | ~F.arrays_overlap("tags", F.array(F.lit("method"), F.lit("skill"))))).select("event_id")


@query("AGG10_weekly_topics", """SELECT strftime(ts, '%G-W%V') AS week, event_type AS topic, count(*) AS n, count(*) >= 300 AS flagged,
  list_sort(list_distinct(list(user_id % 7))) AS modes, list(round(value, 2) ORDER BY ts, event_id)[:5] AS firsts,
  list_sort(list_transform(map_entries(histogram(user_id % 7)), lambda e: e.key || ':' || e.value)) AS frequencies FROM events GROUP BY ALL""")
def agg10(spark, d):
    """A week's topics with their count, modes and how often each is, and the first five distances in
    the order of their events."""
    return weekly_report(events(spark, d).select("ts", "event_id", F.col("event_type").alias("topic"), F.expr("user_id % 7").alias("mode"), F.round("value", 2).alias("distance")), 300)


@query("AGG12_action_items", "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 5")
def agg12(spark, d):
    return events(spark, d).groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query("AGG22a_percentiles", """SELECT event_type, round(median(value), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type""")
def agg22a(spark, d):
    # the value at (n - 1) q, between its two neighbours; q as twentieths keeps the place exact
    at = {n: (f"{q} * (n - 1) div 20 + 1", f"least(n, {q} * (n - 1) div 20 + 2)", f"({q} * (n - 1) % 20) / 20") for n, q in (("p50", 10), ("p95", 19))}
    rows = nth_values(events(spark, d), "event_type", "value", {f"{n}_{k}": p for n, places in at.items() for k, p in zip(("lo", "hi"), places)})
    return rows.select("event_type", *[F.round(F.expr(f"{n}_lo + ({n}_hi - {n}_lo) * {places[2]}"), 6).alias(n) for n, places in at.items()])


_RANKED = "r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


@query("AGG22b_nearest_rank", f"WITH {_RANKED} SELECT event_type, max(value) FILTER (k = n // 2 + 1) AS p50, max(value) FILTER (k = floor(0.95::DOUBLE * n) + 1) AS p95 FROM r GROUP BY event_type")
def agg22b(spark, d):
    return nth_values(events(spark, d), "event_type", "value", {"p50": "n div 2 + 1", "p95": "floor(0.95D * n) + 1"}).drop("n")


@query("AGG22c_exclusive_quantile", f"""WITH {_RANKED}, q AS (SELECT event_type, any_value(n) AS n, max(value) FILTER (k = 19 * (n + 1) // 20) AS lo, max(value) FILTER (k = 19 * (n + 1) // 20 + 1) AS hi FROM r GROUP BY event_type)
  SELECT event_type, round(lo + (hi - lo) * (19 * (n + 1) % 20) / 20, 6) AS p95 FROM q""")
def agg22c(spark, d):
    rows = nth_values(events(spark, d), "event_type", "value", {"lo": "19 * (n + 1) div 20", "hi": "19 * (n + 1) div 20 + 1"})
    return rows.select("event_type", F.round(F.expr("lo + (hi - lo) * (19 * (n + 1) % 20) / 20"), 6).alias("p95"))


@query("AGG23_throughput", """SELECT user_id % 10 AS host, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type <> 'error') / count(*), 6) AS ok_rate,
  round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 6) AS per_second FROM events GROUP BY 1""")
def agg23(spark, d):
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    n, bad = F.count(F.lit(1)), F.count_if(F.col("event_type") == "error")
    return events(spark, d).groupBy(F.expr("user_id % 10").alias("host")).agg(n.alias("total"), bad.alias("errors"), F.round((n - bad) / n, 6).alias("ok_rate"), F.round(n / span, 6).alias("per_second"))


@query("AGG25_counters", "SELECT event_type, user_id % 3 AS role, count(*) AS n FROM events GROUP BY ALL")
def agg25(spark, d):
    return events(spark, d).groupBy("event_type", F.expr("user_id % 3").alias("role")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows, *keys):
    """Cumulative buckets: one pass of conditional counts, then a row a bucket."""
    counts = rows.groupBy(*keys).agg(*[F.count_if(F.col("value") <= b).alias(f"b{i}") for i, b in enumerate(BUCKETS)], F.count(F.lit(1)).alias("all"))
    cells = [F.struct(F.lit(f"{b:g}").alias("le"), F.lit(b).alias("edge"), F.col(f"b{i}").alias("n")) for i, b in enumerate(BUCKETS)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.lit(None).cast("double").alias("edge"), F.col("all").alias("n")))
    return counts.select(*keys, F.inline(F.array(*cells)))


_HIST = " UNION ALL ".join([f"SELECT event_type, '{b:g}' AS le, {b}::DOUBLE AS edge, count(*) FILTER (value <= {b}) AS n FROM events GROUP BY event_type" for b in BUCKETS] + ["SELECT event_type, '+Inf', NULL, count(*) FROM events GROUP BY event_type"])


@query("AGG26_cumulative_histogram", f"SELECT event_type, le, n FROM ({_HIST})")
def agg26(spark, d):
    return histogram(events(spark, d), "event_type").select("event_type", "le", "n")


def histogram_quantiles(rows, qs, *keys):
    """keys, q, value: quantiles from cumulative buckets, linear inside a bucket; the open bucket
    gives its lower edge."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("edge"))
    cells = histogram(rows, *keys).withColumn("below", F.lag("n", 1, 0).over(w)).withColumn("low", F.lag("edge", 1, 0.0).over(w))
    cells = cells.withColumn("total", F.max("n").over(Window.partitionBy(*keys))).withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    value = F.expr("case when edge is null then low else low + (edge - low) * (q * total - below) / (n - below) end")
    return cells.where("n >= q * total and below < q * total").select(*keys, "q", F.round(value, 6).alias("value"))


def _quantiles_sql(key: str, qs, where: str = "true") -> str:
    hist = " UNION ALL ".join([f"SELECT {key} AS key, {b}::DOUBLE AS edge, count(*) FILTER (value <= {b}) AS n FROM events WHERE {where} GROUP BY 1" for b in BUCKETS] + [f"SELECT {key}, NULL, count(*) FROM events WHERE {where} GROUP BY 1"])
    return f"""(WITH h AS ({hist}), l AS (SELECT *, lag(n, 1, 0) OVER w AS below, lag(edge, 1, 0::DOUBLE) OVER w AS low, max(n) OVER (PARTITION BY key) AS total
    FROM h WINDOW w AS (PARTITION BY key ORDER BY edge NULLS LAST)), x AS (SELECT *, unnest([{', '.join(f'{q}::DOUBLE' for q in qs)}]) AS q FROM l)
  SELECT key, q, round(CASE WHEN edge IS NULL THEN low ELSE low + (edge - low) * (q * total - below) / (n - below) END, 6) AS value FROM x WHERE n >= q * total AND below < q * total)"""


@query("MET03_histogram_quantile", f"SELECT key AS event_type, value AS p95 FROM {_quantiles_sql('event_type', (0.95,))}")
def met03(spark, d):
    return histogram_quantiles(events(spark, d), (0.95,), "event_type").select("event_type", F.col("value").alias("p95"))


def _row_quantile(q: float) -> str:
    """A quantile of the cumulative counts b0, b1 ... n of one row, for both SQL dialects."""
    cases, low, below = [], "cast(0 AS double)", "0"
    for i, edge in enumerate(BUCKETS):
        cases.append(f"WHEN b{i} >= cast({q} AS double) * n THEN {low} + (cast({edge} AS double) - {low}) * (cast({q} AS double) * n - {below}) / (b{i} - {below})")
        low, below = f"cast({edge} AS double)", f"b{i}"
    return f"CASE {' '.join(cases)} ELSE {low} END"


#: Window, limit, hold and events of the latency rule; an hour here is 30 s of the service.
SLOW, TIMED = (10 * 3600, 47.0, 10 * 3600), "event_type = 'view' AND value <= 50"
_SLOW_VALUES = ", ".join(f"count(*) FILTER (value <= {b}) AS b{i}" for i, b in enumerate(BUCKETS)) + ", count(*) AS n"


@query("MET03b_latency_alert", A.held_sql(f"(SELECT k FROM ({A.evaluations_sql(SLOW[0], 3600, _SLOW_VALUES, where=TIMED)}) WHERE {_row_quantile(0.95)} > {SLOW[1]})", 3600, SLOW[2]))
def met03b(spark, d):
    """Stretches in which the 95th percentile of a sliding histogram stays above the limit."""
    counts = {f"b{i}": F.count_if(F.col("value") <= b) for i, b in enumerate(BUCKETS)}
    rows = A.evaluations(events(spark, d).where(TIMED), SLOW[0], 3600, **counts, n=F.count(F.lit(1)))
    return A.held(rows.where(F.expr(_row_quantile(0.95)) > SLOW[1]), 3600, SLOW[2])


@query("MET09_role_quantiles", f"SELECT key AS role, q, value FROM {_quantiles_sql('user_id % 3', (0.5, 0.95))}")
def met09(spark, d):
    """p50 and p95 of the latency by role."""
    return histogram_quantiles(events(spark, d).withColumn("role", F.expr("user_id % 3")), (0.5, 0.95), "role")


@query("MET09b_distance_quantiles", "SELECT q, value FROM " + _quantiles_sql("0", (0.5, 0.95), "event_type = 'view'"))
def met09b(spark, d):
    """p50 and p95 of the distance that searches record."""
    return histogram_quantiles(events(spark, d).where("event_type = 'view'").withColumn("whole", F.lit(0)), (0.5, 0.95), "whole").select("q", "value")


HOUR = 3600


def ratio_alert(spark, d, part: str, window: int, above: float, hold: int, name: str):
    """Stretches in which the share of events that satisfy `part` stays above a limit."""
    rows = A.evaluations(events(spark, d), window, HOUR, part=F.count_if(F.expr(part)), n=F.count(F.lit(1)))
    return A.held(rows.where(f"part > {above}D * n"), HOUR, hold).select(F.lit(name).alias("alert"), "start", "fires", "end")


def _ratio_sql(part: str, window: int, above: float, hold: int, name: str) -> str:
    values = f"count(*) FILTER ({part}) AS part, count(*) AS n"
    bad = f"(SELECT k FROM ({A.evaluations_sql(window, HOUR, values)}) WHERE part > {above}::DOUBLE * n)"
    return f"SELECT '{name}' AS alert, * FROM ({A.held_sql(bad, HOUR, hold)})"


#: condition, window, limit, hold, name: one rule or several a query; an hour here is 30 s of the service.
_RATIOS = {
    "MET02_error_ratio": [("event_type = 'error'", 6 * HOUR, 0.2, 3 * HOUR, "errors")],
    "MET04_model_ratios": [("event_type = 'error'", 6 * HOUR, 0.25, 6 * HOUR, "model errors"), ("event_type = 'signup'", 12 * HOUR, 0.22, 12 * HOUR, "fallback")],
    "MET05_zero_hit_ratio": [("value < 5", 15 * HOUR, 0.1, 15 * HOUR, "zero hits")],
}
for _name, _rules in _RATIOS.items():

    @query(_name, " UNION ALL ".join(_ratio_sql(*r) for r in _rules))
    def ratios(spark, d, rules=_rules):
        out = [ratio_alert(spark, d, *r) for r in rules]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])


@query("MET05b_hit_ratio", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, round(avg((value >= 1)::INTEGER), 6) AS ratio FROM events GROUP BY 1")
def met05b(spark, d):
    return events(spark, d).groupBy(F.window("ts", "1 day")["start"].cast("timestamp_ntz").alias("start")).agg(F.round(F.avg((F.col("value") >= 1).cast("int")), 6).alias("ratio"))


_CRISIS = "event_type = 'error' AND value > 40"


@query("MET06_crisis_increase", f"SELECT make_timestamp(k * {HOUR} * 1000000) AS fires, n FROM ({A.evaluations_sql(10 * HOUR, HOUR, 'count(*) AS n', where=_CRISIS)}) WHERE n > 0")
def met06(spark, d):
    """Evaluation times at which the window of ten steps (five minutes of the service) has seen an
    increase; the rule has no hold."""
    rows = A.evaluations(events(spark, d).where(_CRISIS), 10 * HOUR, HOUR, n=F.count(F.lit(1))).where("n > 0")
    return rows.select(F.timestamp_seconds(F.col("k") * HOUR).cast("timestamp_ntz").alias("fires"), "n")


_TURNS = A.evaluations_sql(2 * HOUR, HOUR, "count(*) FILTER (event_type = 'purchase' AND value > 45) AS n")


@query("MET07_turns_drop", "SELECT * FROM (" + A.held_sql(f"(SELECT g.k FROM (SELECT unnest(range((SELECT min(k) FROM ({_TURNS})), (SELECT max(k) FROM ({_TURNS})) + 1)) AS k) g LEFT JOIN ({_TURNS}) e ON e.k = g.k WHERE coalesce(e.n, 0) < 1)", HOUR, 2 * HOUR) + ")")
def met07(spark, d):
    """Stretches in which hardly any turn is seen; times without any event count as well."""
    rows = A.evaluations(events(spark, d), 2 * HOUR, HOUR, n=F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 45)))
    return A.held(A.gap_filled(rows, "n").where("n < 1"), HOUR, 2 * HOUR)


_PANELS = {"type": "event_type", "role": "(user_id % 3)", "host": "(user_id % 10)", "status": "(CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END)"}


@query("MET08_rates", "SELECT panel, label, start, round(n / 86400, 9) AS per_second, n AS increase FROM (" + " UNION ALL ".join(f"SELECT '{p}' AS panel, {e}::VARCHAR AS label, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM events GROUP BY ALL" for p, e in _PANELS.items()) + ")")
def met08(spark, d):
    """Daily rate and increase of four panels in one pass over the events."""
    labels = F.inline(F.array(*[F.struct(F.lit(p).alias("panel"), F.expr(e).cast("string").alias("label")) for p, e in _PANELS.items()]))
    rows = events(spark, d).select("ts", labels).groupBy("panel", "label", F.window("ts", "1 day")["start"].cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("increase"))
    return rows.select("panel", "label", "start", F.round(F.col("increase") / 86400, 9).alias("per_second"), "increase")


@query("MET01_down_islands", """WITH u AS (SELECT user_id, ts, event_id, event_type = 'error' AS down FROM events), s AS (SELECT *, sum((NOT down)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM u)
  SELECT user_id, min(ts) AS start, count(*) AS samples FROM s WHERE down GROUP BY user_id, island HAVING epoch_us(max(ts)) - epoch_us(min(ts)) >= 21600000000""")
def met01(spark, d):
    """Instances that every sample of six hours or more finds down."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, d).withColumn("down", F.col("event_type") == "error").withColumn("island", F.sum((~F.col("down")).cast("int")).over(w))
    out = rows.where("down").groupBy("user_id", "island").agg(F.min("ts").cast("timestamp_ntz").alias("start"), F.count(F.lit(1)).alias("samples"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("span"))
    return out.where("span >= 21600000000").select("user_id", "start", "samples")


_AB_ID = "CASE WHEN user_id % 11 = 0 THEN '' WHEN user_id % 13 = 0 THEN NULL ELSE user_id::VARCHAR END"


@query("AB01_assignment", f"""WITH u AS (SELECT DISTINCT user_id, {_AB_ID} AS id FROM events), e AS (SELECT unnest(['on', 'off']) AS experiment)
  SELECT experiment, user_id, CASE WHEN experiment = 'off' OR coalesce(id, '') = '' THEN 'control' WHEN ('0x' || right(md5(id), 1))::INTEGER % 2 = 0 THEN 'treatment' ELSE 'control' END AS variant FROM u CROSS JOIN e""")
def ab01(spark, d):
    """Variants of two experiments, of which one is switched off; some users have no id."""
    rows = events(spark, d).select("user_id").distinct()
    rows = rows.withColumn("id", F.expr("case when user_id % 11 = 0 then '' when user_id % 13 = 0 then null else cast(user_id as string) end"))
    each = F.explode(F.create_map(F.lit("on"), F.lit(True), F.lit("off"), F.lit(False))).alias("experiment", "enabled")
    return rows.select("user_id", "id", each).select("experiment", "user_id", variant(F.col("id"), F.col("enabled")).alias("variant"))


def variant(id, enabled):
    """The parity of the id's hash; control without an id and where the experiment is off."""
    even = F.conv(F.right(F.md5(id), F.lit(1)), 16, 10).cast("int") % 2 == 0
    return F.when(enabled & (F.coalesce(id, F.lit("")) != "") & even, "treatment").otherwise("control")


@query("AB02_feedback", """WITH f AS (SELECT CASE WHEN ('0x' || right(md5(user_id::VARCHAR), 1))::INTEGER % 2 = 0 THEN 'treatment' ELSE 'control' END AS variant, (event_id % 5 + 1) AS score FROM events WHERE event_type = 'click')
  SELECT variant, count(*) AS n, round_even(sum(score) / count(*), 2) AS mean, count(*) FILTER (score <= 2) AS low FROM f GROUP BY variant""")
def ab02(spark, d):
    even = F.conv(F.right(F.md5(F.col("user_id").cast("string")), F.lit(1)), 16, 10).cast("int") % 2 == 0
    rows = events(spark, d).where("event_type = 'click'").select(F.when(even, "treatment").otherwise("control").alias("variant"), F.expr("event_id % 5 + 1").alias("score"))
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.bround(F.sum("score") / F.count(F.lit(1)), 2).alias("mean"), F.count_if(F.col("score") <= 2).alias("low"))


@query("AGG24_weighted_score", "SELECT user_id % 4 AS experiment, round_even(sum((event_id % 5 + 1) * k) / sum(k), 2) AS mean FROM (SELECT *, event_id % 3 + 1 AS k FROM events) GROUP BY 1")
def agg24(spark, d):
    return events(spark, d).withColumn("k", F.expr("event_id % 3 + 1")).groupBy(F.expr("user_id % 4").alias("experiment")).agg(F.bround(F.expr("sum((event_id % 5 + 1) * k) / sum(k)"), 2).alias("mean"))


_ADMITTED = """WITH RECURSIVE r AS (SELECT user_id, epoch_us(ts) AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
  s AS (SELECT user_id, k, event_id, [t] AS held, true AS admitted FROM r WHERE k = 1
    UNION ALL SELECT r.user_id, r.k, r.event_id,
      CASE WHEN len(list_filter(s.held, lambda x: r.t - x <= 21600000000)) < 2 THEN list_append(list_filter(s.held, lambda x: r.t - x <= 21600000000), r.t) ELSE list_filter(s.held, lambda x: r.t - x <= 21600000000) END,
      len(list_filter(s.held, lambda x: r.t - x <= 21600000000)) < 2 FROM s JOIN r ON r.user_id = s.user_id AND r.k = s.k + 1)
  """


@query("STR01_rate_limit", f"{_ADMITTED} SELECT event_id, admitted FROM s")
def str01(spark, d):
    return admitted(events(spark, d).select(F.col("user_id").alias("key"), "ts", "event_id"), limit=2, seconds=6 * 3600)


@query("STR01b_limiter_stream", f"{_ADMITTED} SELECT event_id, admitted FROM s")
def str01b(spark, d):
    """The limiter as a stream: the events arrive as files in any order, and a last one, a year on,
    moves the watermark past them all."""
    out = work_path(spark, "limiter")
    rows = events(spark, d).select(F.col("user_id").cast("string").alias("key"), "ts", "event_id")
    rows.write.parquet(f"{out}/in")
    feed = lambda: spark.readStream.schema(rows.schema).parquet(f"{out}/in")
    how = {"limit": 2, "seconds": 6 * 3600, "lateness": "400 days", "shards": int(spark.conf.get("spark.sql.shuffle.partitions")), "tick": 24 * 3600}
    decided_stream(spark, feed(), out, **how)
    rows.agg(F.max("ts").alias("ts")).where("ts is not null").select(F.lit("end").alias("key"), F.expr("ts + interval 1000 days").alias("ts"), F.lit(-1).cast("long").alias("event_id")).write.mode("append").parquet(f"{out}/in")
    return decided_stream(spark, feed(), out, **how).where("event_id >= 0")


@query("STR02_state_cleanup", f"""{_ADMITTED}, l AS (SELECT r.user_id AS key, max(t) AS last FROM s JOIN r ON r.event_id = s.event_id WHERE admitted GROUP BY 1)
  SELECT key, make_timestamp(last) AS last FROM l WHERE (SELECT count(*) FROM l) <= 50 OR (SELECT max(epoch_us(ts)) FROM events) - last <= 21600000000""")
def str02(spark, d):
    """Keys that still have state after the last event: idle ones go once there are over 50."""
    return last_admitted(events(spark, d).select(F.col("user_id").alias("key"), "ts", "event_id"), limit=2, seconds=6 * 3600, most=50)


ORDER = ("signup", "view", "click", "purchase")


@query("STR05_event_sequence", f"""WITH f AS (SELECT user_id, min(ts) AS start, {', '.join(f"min(ts) FILTER (event_type = '{t}') AS {t}" for t in ORDER)}, min(ts) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id)
  SELECT user_id, round(epoch(purchase) - epoch(start), 3) AS seconds, CASE WHEN {' AND '.join(f'{a} <= {b}' for a, b in zip(ORDER, ORDER[1:]))} THEN 'in order' WHEN error = start THEN 'cut short' ELSE 'out of order' END AS sequence FROM f""")
def str05(spark, d):
    """Seconds to the first purchase, and whether the first events of each kind came in order."""
    at = lambda t: F.min(F.when(F.col("event_type") == t, F.unix_micros("ts")))
    rows = events(spark, d).groupBy("user_id").agg(F.min(F.unix_micros("ts")).alias("start"), *[at(t).alias(t) for t in (*ORDER, "error")])
    ordered = F.expr(" and ".join(f"{a} <= {b}" for a, b in zip(ORDER, ORDER[1:])))
    sequence = F.when(ordered, "in order").when(F.col("error") == F.col("start"), "cut short").otherwise("out of order")
    return rows.select("user_id", F.round((F.col("purchase") - F.col("start")) / 1e6, 3).alias("seconds"), sequence.alias("sequence"))


@query("WIN12_increase", "SELECT user_id, round(sum(CASE WHEN value < before THEN value ELSE value - before END), 6) AS increase FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) GROUP BY user_id")
def win12(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events(spark, d).withColumn("before", F.lag("value").over(w))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("value") < F.col("before"), F.col("value")).otherwise(F.col("value") - F.col("before"))), 6).alias("increase"))
