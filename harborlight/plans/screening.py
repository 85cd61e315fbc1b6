"""Queries of the screening domain: scoring, cohorts, sessions and their records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harborlight.operators import scoring as S
from harborlight.plans.registry import query
from harborlight.sources.folders import work_path, written
from harborlight.sources.store import Store
from harborlight.sources.tables import RANK, RECORDS, SCALES, SESSIONS, STUDENTS, answers, answers_sql, records, sessions, students, table


def case(value: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {value} <= {u} THEN '{n}'" for u, n in bands[:-1]) + f" ELSE '{bands[-1][1]}' END"


def items_sum(items, value: str = "value") -> str:
    return f"sum(CASE WHEN qid IN ({', '.join(map(str, items))}) THEN {value} ELSE 0 END)::BIGINT"


PHQ_SQL = f"""phq AS (SELECT student_no, sum(value)::BIGINT AS total, {case('sum(value)', S.PHQ_BANDS)} AS severity,
  CASE WHEN {items_sum(S.PHQ_CRISIS)} > 0 THEN 'elevated' ELSE 'safe' END AS crisis_level FROM answers GROUP BY student_no)"""
RANK_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " ELSE 0 END"


def rank(column: str = "severity"):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in RANK.items() for x in p]), F.col(column)), F.lit(0))


@query("SCO02_phq", f"WITH {answers_sql('phq_a')}, {PHQ_SQL} SELECT * FROM phq")
def sco02(spark, d):
    return S.phq(answers(spark, d, "phq_a"))


@query("SCO03_scared", f"""WITH {answers_sql('scared')} SELECT student_no, sum(value)::BIGINT AS total,
  {case('sum(value)', S.SCARED_BANDS)} AS severity, 'safe' AS crisis_level FROM answers GROUP BY student_no""")
def sco03(spark, d):
    return S.scared(answers(spark, d, "scared"))


_SDQ_VALUE = f"(CASE WHEN qid IN {S.SDQ_REVERSE} THEN 2 - value ELSE value END)"
_SDQ = f"""WITH {answers_sql('sdq')}, f AS (SELECT student_no, {', '.join(f'{items_sum(i, _SDQ_VALUE)} AS {n}' for n, i in S.SDQ_FACTORS.items())}
  FROM answers GROUP BY student_no), t AS (SELECT *, emotional + conduct + hyperactivity + peer AS total FROM f)"""


@query("SCO04_sdq", f"{_SDQ} SELECT *, emotional + peer AS internalising, conduct + hyperactivity AS externalising, {case('total', S.SDQ_BANDS)} AS severity FROM t")
def sco04(spark, d):
    return S.sdq(answers(spark, d, "sdq"))


@query("SCO05_mht", f"""WITH {answers_sql('mht')}, f AS (SELECT student_no, {', '.join(f'{items_sum(i)} AS {n}' for n, i in S.MHT_FACTORS.items())},
  {items_sum(S.MHT_VALIDITY)} AS validity, {items_sum(S.MHT_CRISIS)} AS risk FROM answers GROUP BY student_no)
  SELECT student_no, {', '.join(S.MHT_FACTORS)}, validity, {' + '.join(S.MHT_FACTORS)} AS total,
  CASE WHEN {' + '.join(S.MHT_FACTORS)} >= 65 THEN 'severe' WHEN greatest({', '.join(S.MHT_FACTORS)}) >= 8 THEN 'moderate'
    WHEN greatest({', '.join(S.MHT_FACTORS)}) >= 4 THEN 'mild' ELSE 'none' END AS severity, validity >= 7 AS doubtful,
  CASE WHEN risk > 0 THEN 'elevated' ELSE 'safe' END AS crisis_level FROM f""")
def sco05(spark, d):
    return S.mht(answers(spark, d, "mht"))


_DIRTY = f"""WITH {answers_sql('phq_a', 'clean')}, answers AS (SELECT student_no,
    CASE WHEN student_no % 23 = 0 AND qid = 9 THEN 109 ELSE qid END AS qid, CASE WHEN student_no % 19 = 0 AND qid = 5 THEN 9 ELSE value END AS value
  FROM clean WHERE NOT (student_no % 17 = 0 AND qid = 3))"""


def dirty(spark, d):
    rows = answers(spark, d, "phq_a").where("not (student_no % 17 = 0 and qid = 3)")
    rows = rows.withColumn("value", F.expr("case when student_no % 19 = 0 and qid = 5 then 9 else value end"))
    return rows.withColumn("qid", F.expr("case when student_no % 23 = 0 and qid = 9 then 109L else qid end"))


@query("SCO01_validation", f"""{_DIRTY}, ids AS (SELECT student_no, list(qid) AS ids,
    list_sort(coalesce(list(qid) FILTER (qid BETWEEN 1 AND 9 AND NOT value BETWEEN 0 AND 3), [])) AS bad FROM answers GROUP BY student_no),
  c AS (SELECT student_no, list_sort(list_filter(range(1, 10), lambda x: NOT list_contains(ids, x))) AS missing,
    list_sort(list_filter(ids, lambda x: NOT x BETWEEN 1 AND 9)) AS unknown, bad FROM ids)
  SELECT *, len(missing) + len(unknown) + len(bad) = 0 AS valid FROM c""")
def sco01(spark, d):
    return S.validate(dirty(spark, d), 9, 3)


@query("SET06_missing_and_extra_items", f"""{_DIRTY} SELECT student_no, count(*) FILTER (qid > 9) AS extra, 9 - count(*) FILTER (qid <= 9) AS missing
  FROM answers GROUP BY student_no HAVING count(*) FILTER (qid > 9) > 0 OR count(*) FILTER (qid <= 9) < 9""")
def set06(spark, d):
    rows = S.validate(dirty(spark, d), 9, 3)
    return rows.select("student_no", F.size("unknown").cast("long").alias("extra"), F.size("missing").cast("long").alias("missing")).where("extra > 0 or missing > 0")


@query("SCO06_interpretation", f"""{_SDQ} SELECT student_no, concat(CASE WHEN total <= 15 THEN 'typical' WHEN total <= 19 THEN 'borderline' ELSE 'high' END,
  CASE WHEN emotional > 6 THEN '; emotional' ELSE '' END, CASE WHEN conduct > 4 THEN '; conduct' ELSE '' END, CASE WHEN hyperactivity > 6 THEN '; hyperactivity' ELSE '' END,
  CASE WHEN peer > 4 THEN '; peer' ELSE '' END, CASE WHEN prosocial < 5 THEN '; prosocial' ELSE '' END) AS note FROM t""")
def sco06(spark, d):
    rows = S.sdq(answers(spark, d, "sdq"))
    notes = [F.expr(f"case when {n} {c} then '; {n}' else '' end") for n, c in (("emotional", "> 6"), ("conduct", "> 4"), ("hyperactivity", "> 6"), ("peer", "> 4"), ("prosocial", "< 5"))]
    return rows.select("student_no", F.concat(F.expr("case when total <= 15 then 'typical' when total <= 19 then 'borderline' else 'high' end"), *notes).alias("note"))


PHQ_DIMENSIONS = {"interest": (1, 2), "somatic": (3, 4, 5), "self": (6, 7), "motor": (8, 9)}
_PROFILE = f"""WITH {answers_sql('phq_a')}, d(ordinal, dimension, items) AS (VALUES {', '.join(f"({k}, '{n}', {list(i)})" for k, (n, i) in enumerate(PHQ_DIMENSIONS.items()))}),
  r AS (SELECT student_no, ordinal, dimension, sum(value)::BIGINT AS raw, any_value(len(items) * 3) AS max FROM answers JOIN d ON list_contains(items, qid) GROUP BY ALL),
  s AS (SELECT *, raw / max AS share FROM r),
  p AS (SELECT student_no, ordinal, dimension, raw, max, trunc(share * 100)::INTEGER AS pct,
    CASE WHEN share < 0.3::DOUBLE THEN 'none' WHEN share < 0.5::DOUBLE THEN 'mild' WHEN share < 0.7::DOUBLE THEN 'moderate' WHEN share < 0.85::DOUBLE THEN 'moderately_severe' ELSE 'severe' END AS severity FROM s)"""


@query("SCO07_profile", f"{_PROFILE} SELECT *, CASE WHEN severity = 'none' THEN 'low' WHEN severity IN ('mild', 'moderate') THEN 'mid' ELSE 'high' END AS level FROM p")
def sco07(spark, d):
    return S.profile(answers(spark, d, "phq_a"), PHQ_DIMENSIONS, 3)


@query("AGG06_worst_severity", f"{_PROFILE} SELECT student_no, arg_max(severity, {RANK_SQL}) AS worst FROM p GROUP BY student_no")
def agg06(spark, d):
    return S.profile(answers(spark, d, "phq_a"), PHQ_DIMENSIONS, 3).groupBy("student_no").agg(F.max_by("severity", rank()).alias("worst"))


@query("AGG07_worst_dimension", f"{_PROFILE} SELECT student_no, arg_max(dimension, ({RANK_SQL}) * 10 - ordinal) AS dimension FROM p GROUP BY student_no")
def agg07(spark, d):
    rows = S.profile(answers(spark, d, "phq_a"), PHQ_DIMENSIONS, 3)
    return rows.groupBy("student_no").agg(F.max_by("dimension", rank() * 10 - F.col("ordinal")).alias("dimension"))


@query("SCO08_percent", f"""WITH {answers_sql('phq_a')}, {PHQ_SQL} SELECT student_no, total, 27 AS max_score, least(100, trunc(total * 100 / 27))::INTEGER AS pct FROM phq""")
def sco08(spark, d):
    n, m = SCALES["phq_a"]
    return S.phq(answers(spark, d, "phq_a")).select("student_no", "total", F.lit(n * m).alias("max_score"), F.least(F.lit(100), (F.col("total") * 100 / (n * m)).cast("int")).alias("pct"))


@query("SCO09_radar", f"""{_PROFILE} SELECT student_no, string_agg(round_even(100 + 80 * raw / max * cos(2 * pi() * ordinal / 4 - pi() / 2), 1)::DECIMAL(6,1) || ',' ||
  round_even(100 + 80 * raw / max * sin(2 * pi() * ordinal / 4 - pi() / 2), 1)::DECIMAL(6,1), ' ' ORDER BY ordinal) AS points,
  string_agg(CASE WHEN cos(2 * pi() * ordinal / 4 - pi() / 2) > 0.35 THEN 'start' WHEN cos(2 * pi() * ordinal / 4 - pi() / 2) < -0.35 THEN 'end' ELSE 'middle' END, ' ' ORDER BY ordinal) AS anchors FROM p GROUP BY student_no""")
def sco09(spark, d):
    rows = S.profile(answers(spark, d, "phq_a"), PHQ_DIMENSIONS, 3)
    angle = 2 * F.pi() * F.col("ordinal") / 4 - F.pi() / 2

    def at(turn):
        return F.bround(100 + 80 * F.col("raw") / F.col("max") * turn, 1).cast("decimal(6,1)").cast("string")

    rows = rows.withColumn("point", F.concat_ws(",", at(F.cos(angle)), at(F.sin(angle))))
    rows = rows.withColumn("anchor", F.when(F.cos(angle) > 0.35, "start").when(F.cos(angle) < -0.35, "end").otherwise("middle"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "point", "anchor")))
    return rows.groupBy("student_no").agg(*[F.array_join(ordered[c], " ").alias(f"{c}s") for c in ("point", "anchor")])


@query("SCO10_registry", "SELECT * FROM (VALUES ('phq_a', 9, 3, 27), ('scared', 41, 2, 82), ('sdq', 25, 2, 50), ('mht', 100, 1, 100)) t(scale_id, item_count, max_option, max_score)")
def sco10(spark, d):
    return spark.createDataFrame([(k, n, m, n * m) for k, (n, m) in SCALES.items()], "scale_id string, item_count int, max_option int, max_score int")


@query("SCO12_scenario_matrix", """SELECT 'plain' AS kind, s AS scale_id, v AS severity, i AS ordinal, (['home', 'class', 'peers'])[i % 3 + 1] AS focus
  FROM (SELECT unnest(['phq_a', 'scared', 'sdq', 'mht']) AS s) CROSS JOIN (SELECT unnest(['none', 'mild', 'moderate', 'severe']) AS v) CROSS JOIN range(0, 6) r(i)
  UNION ALL SELECT 'crisis', (['phq_a', 'mht'])[i % 2 + 1], 'severe', i, (['home', 'class', 'peers'])[i % 3 + 1] FROM range(0, 10) r(i)
  UNION ALL SELECT 'combination', a || '+' || b, 'moderate', i, (['home', 'class', 'peers'])[i % 3 + 1] FROM (VALUES ('phq_a', 'scared'), ('phq_a', 'sdq'), ('scared', 'mht')) t(a, b) CROSS JOIN range(0, 4) r(i)""")
def sco12(spark, d):
    # a fixed matrix: 4 scales x 4 severities x 6, 10 crisis cases, 3 combinations x 4
    pick = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    i = F.col("id")
    plain = spark.range(96).select(F.lit("plain").alias("kind"), pick(("phq_a", "scared", "sdq", "mht"), F.floor(i / 24)).alias("scale_id"), pick(("none", "mild", "moderate", "severe"), F.floor(i / 6) % 4).alias("severity"), (i % 6).alias("ordinal"))
    crisis = spark.range(10).select(F.lit("crisis"), pick(("phq_a", "mht"), i % 2), F.lit("severe"), i)
    pairs = spark.range(12).select(F.lit("combination"), pick(("phq_a+scared", "phq_a+sdq", "scared+mht"), F.floor(i / 4)), F.lit("moderate"), i % 4)
    return plain.union(crisis).union(pairs).withColumn("focus", pick(("home", "class", "peers"), F.col("ordinal") % 3))


@query("SCO13_dialog_matrix", """SELECT i AS idx, (['vent', 'method', 'crisis'])[i % 3 + 1] AS kind, (['exam', 'sleep', 'family', 'friends'])[i % 4 + 1] AS theme, i // 4 % 5 AS question FROM range(0, 120) r(i)""")
def sco13(spark, d):
    return spark.range(120).select(F.col("id").alias("idx"), F.expr("element_at(array('vent', 'method', 'crisis'), cast(id % 3 + 1 as int))").alias("kind"), F.expr("element_at(array('exam', 'sleep', 'family', 'friends'), cast(id % 4 + 1 as int))").alias("theme"), F.expr("id div 4 % 5").alias("question"))


_SCORED = f"""{answers_sql('phq_a')}, {answers_sql('scared', 'scared_answers')}, {PHQ_SQL},
  scored AS (SELECT 'phq_a' AS scale_id, student_no, severity FROM phq UNION ALL SELECT 'scared', student_no, {case('sum(value)', S.SCARED_BANDS)} FROM scared_answers GROUP BY student_no)"""


@query("AGG02_severity_distribution", f"""WITH {STUDENTS}, {_SCORED}, bands AS (SELECT unnest({list(RANK)}) AS severity)
  SELECT b.batch_id, c.scale_id, s.severity, count(p.student_no) AS n FROM (SELECT DISTINCT batch_id FROM students) b CROSS JOIN (SELECT unnest(['phq_a', 'scared']) AS scale_id) c CROSS JOIN bands s
  LEFT JOIN (SELECT batch_id, scale_id, student_no, severity FROM students JOIN scored USING (student_no) WHERE completed) p ON p.batch_id = b.batch_id AND p.scale_id = c.scale_id AND p.severity = s.severity GROUP BY ALL""")
def agg02(spark, d):
    who = students(spark, d)
    scored = {"phq_a": S.phq(answers(spark, d, "phq_a")), "scared": S.scared(answers(spark, d, "scared"))}
    phq, scared = (rows.select("student_no", F.lit(scale).alias("scale_id"), "severity") for scale, rows in scored.items())
    counts = phq.unionByName(scared).join(who.where("completed"), "student_no").groupBy("batch_id", "scale_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    frame = who.select("batch_id").distinct().withColumn("scale_id", F.explode(F.array(*map(F.lit, scored)))).withColumn("severity", F.explode(F.array(*map(F.lit, RANK))))
    return frame.join(counts, ["batch_id", "scale_id", "severity"], "left").fillna(0, ["n"])


@query("AGG01_batch_progress", f"WITH {STUDENTS} SELECT batch_id, count(*) AS total, count(*) FILTER (completed) AS completed FROM students GROUP BY batch_id")
def agg01(spark, d):
    return students(spark, d).groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("completed").alias("completed"))


@query("AGG29_percent", f"WITH {STUDENTS} SELECT batch_id, floor(count(*) FILTER (completed) * 100 / count(*) + 0.5)::BIGINT AS pct FROM students GROUP BY batch_id")
def agg29(spark, d):
    return students(spark, d).groupBy("batch_id").agg(F.floor(F.count_if("completed") * 100 / F.count(F.lit(1)) + 0.5).alias("pct"))


@query("AGG30_severity_share", f"WITH {RECORDS} SELECT scale_id, severity, round(count(*) / sum(count(*)) OVER (PARTITION BY scale_id), 6) AS share FROM records GROUP BY scale_id, severity")
def agg30(spark, d):
    rows = records(spark, d).groupBy("scale_id", "severity").count()
    return rows.select("scale_id", "severity", F.round(F.col("count") / F.sum("count").over(Window.partitionBy("scale_id")), 6).alias("share"))


@query("AGG03_crisis_list", f"WITH {RECORDS}, {SESSIONS} SELECT account_id, session_id, record_no, scale_id, total FROM records JOIN sessions USING (session_id) WHERE crisis_level = 'elevated'")
def agg03(spark, d):
    return records(spark, d).where("crisis_level = 'elevated'").join(sessions(spark, d).select("session_id", "account_id"), "session_id").select("account_id", "session_id", "record_no", "scale_id", "total")


@query("AGG04_class_progress", f"""WITH {STUDENTS} SELECT batch_id, coalesce(nullif(concat_ws(' / ', nullif(grade, ''), nullif(klass, '')), ''), 'ungrouped') AS class_key,
  count(*) AS total, count(*) FILTER (completed) AS completed FROM students GROUP BY ALL""")
def agg04(spark, d):
    key = F.expr("coalesce(nullif(concat_ws(' / ', nullif(grade, ''), nullif(klass, '')), ''), 'ungrouped')")
    return students(spark, d).groupBy("batch_id", key.alias("class_key")).agg(F.count(F.lit(1)).alias("total"), F.count_if("completed").alias("completed"))


@query("AGG05_any_crisis", f"WITH {RECORDS} SELECT session_id, bool_or(crisis_level = 'elevated') AS any_crisis FROM records GROUP BY session_id")
def agg05(spark, d):
    return records(spark, d).groupBy("session_id").agg(F.bool_or(F.col("crisis_level") == "elevated").alias("any_crisis"))


@query("AGG08_session_duration", f"""WITH {RECORDS}, {SESSIONS}, t AS (SELECT session_id, (epoch(max(r.created_at)) - epoch(any_value(s.created_at)))::BIGINT AS seconds
    FROM records r JOIN sessions s USING (session_id) GROUP BY session_id)
  SELECT session_id, CASE WHEN seconds < 0 THEN '-' WHEN seconds < 60 THEN seconds || 's' ELSE (seconds // 60) || 'm' || (seconds % 60) || 's' END AS duration FROM t""")
def agg08(spark, d):
    last = records(spark, d).groupBy("session_id").agg(F.max("created_at").alias("last"))
    rows = last.join(sessions(spark, d), "session_id").select("session_id", (F.unix_timestamp("last") - F.unix_timestamp("created_at")).alias("seconds"))
    return rows.select("session_id", F.expr("case when seconds < 0 then '-' when seconds < 60 then concat(seconds, 's') else concat(seconds div 60, 'm', seconds % 60, 's') end").alias("duration"))


@query("AGG09_pivoted_summary", f"""WITH {RECORDS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, scale_id ORDER BY created_at DESC, record_no DESC, total DESC) AS r FROM records) WHERE r = 1)
  SELECT session_id, {', '.join(f"max(total) FILTER (scale_id = '{k}') AS {k}_total, max(severity) FILTER (scale_id = '{k}') AS {k}_severity" for k in SCALES)},
  bool_or(crisis_level = 'elevated') AS any_crisis FROM last GROUP BY session_id""")
def agg09(spark, d):
    rows = records(spark, d).groupBy("session_id", "scale_id").agg(F.max_by(F.struct("total", "severity", "crisis_level"), F.struct("created_at", "record_no", "total")).alias("r"))
    wide = rows.groupBy("session_id").pivot("scale_id", list(SCALES)).agg(F.first("r.total").alias("total"), F.first("r.severity").alias("severity"))
    flags = rows.groupBy("session_id").agg(F.bool_or(F.col("r.crisis_level") == "elevated").alias("any_crisis"))
    return wide.join(flags, "session_id")


@query("JOIN01_account_records", f"WITH {RECORDS}, {SESSIONS} SELECT account_id, count(*) AS records, max(total) AS top FROM records JOIN sessions USING (session_id) WHERE account_id IS NOT NULL GROUP BY account_id")
def join01(spark, d):
    return records(spark, d).join(sessions(spark, d).where("account_id is not null").select("session_id", "account_id"), "session_id").groupBy("account_id").agg(F.count(F.lit(1)).alias("records"), F.max("total").alias("top"))


@query("JOIN02_sessions_with_records", f"WITH {RECORDS}, {SESSIONS} SELECT session_id, account_id FROM sessions WHERE EXISTS (SELECT 1 FROM records r WHERE r.session_id = sessions.session_id AND r.severity = 'severe')")
def join02(spark, d):
    return sessions(spark, d).join(records(spark, d).where("severity = 'severe'"), "session_id", "left_semi").select("session_id", "account_id")


@query("JOIN03_children", f"""WITH {STUDENTS}, {SESSIONS} SELECT student_no, coalesce(list(session_id ORDER BY session_id) FILTER (session_id IS NOT NULL), []) AS sessions
  FROM students LEFT JOIN sessions ON account_id = student_no GROUP BY student_no""")
def join03(spark, d):
    owned = sessions(spark, d).where("account_id is not null").groupBy(F.col("account_id").alias("student_no")).agg(F.sort_array(F.collect_list("session_id")).alias("sessions"))
    return students(spark, d).select("student_no").join(owned, "student_no", "left").withColumn("sessions", F.coalesce("sessions", F.array().cast("array<bigint>")))


@query("JOIN04_two_hop", f"""WITH {STUDENTS}, {RECORDS}, {SESSIONS} SELECT batch_id, count(DISTINCT student_no) AS students, count(DISTINCT s.session_id) AS sessions, count(r.record_no) AS records
  FROM students LEFT JOIN sessions s ON s.account_id = student_no LEFT JOIN records r ON r.session_id = s.session_id GROUP BY batch_id""")
def join04(spark, d):
    per = records(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("records"))
    held = sessions(spark, d).where("account_id is not null").join(per, "session_id", "left").groupBy(F.col("account_id").alias("student_no")).agg(F.count(F.lit(1)).alias("sessions"), F.sum("records").alias("records"))
    rows = students(spark, d).join(held, "student_no", "left").groupBy("batch_id")
    return rows.agg(F.count(F.lit(1)).alias("students"), F.coalesce(F.sum("sessions"), F.lit(0)).alias("sessions"), F.coalesce(F.sum("records"), F.lit(0)).alias("records"))


@query("JOIN05_severity_lookup", f"WITH {RECORDS} SELECT severity, {RANK_SQL} AS rank, count(*) AS n FROM records GROUP BY severity")
def join05(spark, d):
    return records(spark, d).groupBy("severity").agg(F.count(F.lit(1)).alias("n")).select("severity", rank().alias("rank"), "n")


@query("WIN01_latest_record", f"""WITH {RECORDS}, {SESSIONS},
  r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, record_no DESC) AS k FROM records),
  a AS (SELECT account_id, r.session_id, record_no, row_number() OVER (PARTITION BY account_id ORDER BY r.created_at DESC, r.session_id DESC, record_no DESC) AS k FROM r JOIN sessions x ON x.session_id = r.session_id WHERE account_id IS NOT NULL)
  SELECT s.session_id, coalesce(r.session_id, a.session_id) AS record_session, coalesce(r.record_no, a.record_no) AS record_no
  FROM sessions s LEFT JOIN r ON r.session_id = s.session_id AND r.k = 1 LEFT JOIN a ON a.account_id = s.account_id AND a.k = 1""")
def win01(spark, d):
    return latest_records(sessions(spark, d), records(spark, d))


def latest_records(own, rows):
    """The latest record of every session, or else the latest one of its account."""
    own = own.select("session_id", "account_id")
    last = rows.groupBy("session_id").agg(F.max(F.struct("created_at", "session_id", "record_no")).alias("r"))
    by_account = last.join(own.where("account_id is not null"), "session_id").groupBy("account_id").agg(F.max("r").alias("a"))
    out = own.join(last, "session_id", "left").join(by_account, "account_id", "left")
    return out.select("session_id", F.coalesce("r.session_id", "a.session_id").alias("record_session"), F.coalesce("r.record_no", "a.record_no").alias("record_no"))


@query("SRT01_orderings", f"WITH {SESSIONS} SELECT session_id, row_number() OVER (PARTITION BY account_id ORDER BY created_at DESC, session_id) AS place FROM sessions WHERE account_id IS NOT NULL")
def srt01(spark, d):
    w = Window.partitionBy("account_id").orderBy(F.desc("created_at"), "session_id")
    return sessions(spark, d).where("account_id is not null").select("session_id", F.row_number().over(w).alias("place"))


#: Largest page, and the largest one of a visitor without an account.
PAGE, PAGE_ANONYMOUS = 100, 50


def page(rows, asked: int, anonymous: bool):
    """The first `asked` rows (clamped) by created_at and session_id, newest first, with next_cursor:
    the last row's created_at on every row if more follow. One row more than the page is read."""
    size = max(1, min(asked, PAGE_ANONYMOUS if anonymous else PAGE))
    w = Window.orderBy(F.desc("created_at"), F.desc("session_id"))
    top = rows.orderBy(F.desc("created_at"), F.desc("session_id")).limit(size + 1).withColumn("r", F.row_number().over(w))
    shown = top.withColumn("more", F.max("r").over(Window.partitionBy()) > size).where(F.col("r") <= size)
    return shown.withColumn("next_cursor", F.when(F.col("more"), F.min("created_at").over(Window.partitionBy()))).drop("r", "more")


@query("SRT02_keyset_page", f"""WITH {SESSIONS}, t AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, session_id DESC) AS r FROM sessions WHERE account_id IS NULL AND created_at < TIMESTAMP '1999-06-01' ORDER BY r LIMIT 51)
  SELECT session_id, account_id, created_at, CASE WHEN (SELECT count(*) FROM t) > 50 THEN (SELECT min(created_at) FROM t WHERE r <= 50) END AS next_cursor FROM t WHERE r <= 50""")
def srt02(spark, d):
    rows = page(sessions(spark, d).where("account_id is null and created_at < timestamp'1999-06-01'"), 80, anonymous=True)
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("next_cursor", F.col("next_cursor").cast("timestamp_ntz"))


@query("FLT01_owned_batches", f"WITH {STUDENTS} SELECT batch_id, student_no FROM students WHERE batch_id = 2")
def flt01(spark, d):
    return students(spark, d).where("batch_id = 2").select("batch_id", "student_no")


@query("FLT02_scope", f"WITH {SESSIONS} SELECT session_id, 'own' AS scope FROM sessions WHERE account_id = 7 UNION ALL SELECT session_id, 'anonymous' FROM sessions WHERE account_id IS NULL")
def flt02(spark, d):
    rows = sessions(spark, d)
    return rows.where("account_id = 7").select("session_id", F.lit("own").alias("scope")).unionByName(rows.where("account_id is null").select("session_id", F.lit("anonymous").alias("scope")))


@query("FLT03_point_lookup", "SELECT c_custkey, c_name FROM customer WHERE upper(c_name) = upper(trim('  customer#000000042 '))")
def flt03(spark, d):
    return table(spark, d, "customer").where(F.upper("c_name") == F.upper(F.trim(F.lit("  customer#000000042 ")))).select("c_custkey", "c_name")


_ROSTER = f"""{STUDENTS}, r AS (SELECT student_no, batch_id, student_no % 37 AS code, CASE WHEN student_no % 41 = 0 THEN ' ' ELSE grade END AS name FROM students),
  v AS (SELECT batch_id, student_no, 'blank' AS problem FROM (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY student_no) AS k FROM r WHERE nullif(trim(name), '') IS NULL) WHERE k <= 10
    UNION ALL SELECT batch_id, min(student_no), 'duplicate' FROM (SELECT *, row_number() OVER (PARTITION BY batch_id, code ORDER BY student_no) AS k FROM r) WHERE k = 2 GROUP BY batch_id
    UNION ALL SELECT batch_id, NULL, 'too many rows' FROM r GROUP BY batch_id HAVING count(*) > 500)"""


@query("FLT12_roster_validation", f"WITH {_ROSTER} SELECT * FROM v")
def flt12(spark, d):
    rows = students(spark, d).select("student_no", "batch_id", F.expr("student_no % 37").alias("code"), F.expr("case when student_no % 41 = 0 then ' ' else grade end").alias("name"))
    return roster_problems(rows)


def roster_problems(rows):
    """batch_id, student_no, problem of rosters (student_no, batch_id, code, name): the first ten
    blank cells, the first code that occurs again, and rosters of more than 500 rows."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("student_no"))
    blank = rows.where(F.expr("nullif(trim(name), '') is null")).withColumn("k", rank("batch_id")).where("k <= 10")
    again = rows.withColumn("k", rank("batch_id", "code")).where("k = 2").groupBy("batch_id").agg(F.min("student_no").alias("student_no"))
    large = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).where("n > 500").select("batch_id", F.lit(None).cast("long").alias("student_no"))
    found = {"blank": blank, "duplicate": again, "too many rows": large}
    parts = [v.select("batch_id", "student_no", F.lit(k).alias("problem")) for k, v in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("FLT13_scale_set", f"""WITH {RECORDS}, s AS (SELECT session_id, list_distinct(list(scale_id)) AS held FROM records GROUP BY session_id)
  SELECT session_id, list_sort(list_filter(['phq_a', 'scared'], lambda x: NOT list_contains(held, x))) AS missing,
    list_sort(list_filter(held, lambda x: NOT list_contains(['phq_a', 'scared'], x))) AS extra FROM s""")
def flt13(spark, d):
    rows = records(spark, d).groupBy("session_id").agg(F.collect_set("scale_id").alias("held"))
    want = F.array(F.lit("phq_a"), F.lit("scared"))
    return rows.select("session_id", F.sort_array(F.array_except(want, "held")).alias("missing"), F.sort_array(F.array_except("held", want)).alias("extra"))


@query("FLT14_entry_state", f"""WITH {STUDENTS} SELECT q.code, CASE WHEN s.student_no IS NULL THEN 'invalid' WHEN s.batch_id = 4 THEN 'closed' WHEN s.completed THEN 'done' ELSE 'open' END AS state
  FROM (SELECT o_orderkey % 2000 AS code FROM orders GROUP BY 1) q LEFT JOIN students s ON s.student_no = q.code""")
def flt14(spark, d):
    asked = table(spark, d, "orders").select(F.expr("o_orderkey % 2000").alias("code")).distinct()
    who = students(spark, d)
    return asked.join(who, asked.code == who.student_no, "left").select("code", F.expr("case when student_no is null then 'invalid' when batch_id = 4 then 'closed' when completed then 'done' else 'open' end").alias("state"))


@query("DML03_change_batch", f"""WITH {STUDENTS}, b AS (SELECT DISTINCT batch_id, 'batch ' || batch_id AS name, CASE WHEN batch_id % 2 = 0 THEN 'closed' ELSE 'active' END AS status FROM students)
  SELECT batch_id, CASE WHEN batch_id = 1 THEN 'renamed' ELSE name END AS name, CASE WHEN batch_id = 3 THEN 'closed' WHEN batch_id = 2 THEN 'active' ELSE status END AS status FROM b""")
def dml03(spark, d):
    """Close, reopen and rename in a stored table: a commit each, read back."""
    rows = students(spark, d).select("batch_id").distinct()
    rows = rows.select("batch_id", F.concat(F.lit("batch "), F.col("batch_id").cast("string")).alias("name"), F.expr("if(batch_id % 2 = 0, 'closed', 'active')").alias("status"))
    store = Store(spark, work_path(spark, "batches"))
    change = store.change()
    change.create("batches", rows, "batch_id")
    change.commit()
    for batch, column, value in ((3, "status", "closed"), (2, "status", "active"), (1, "name", "renamed")):
        change = store.change()
        change.update("batches", F.col("batch_id") == batch, **{column: F.lit(value)})
        change.commit()
    return store.read("batches")


@query("DML04_delete_batch", f"WITH {STUDENTS}, {SESSIONS} SELECT session_id, account_id, s.batch_id FROM sessions LEFT JOIN (SELECT * FROM students WHERE batch_id <> 1) s ON s.student_no = account_id")
def dml04(spark, d):
    """A batch is deleted: its entries go, the sessions made through it stay without a batch."""
    entries = students(spark, d).select("student_no", "batch_id")
    rows = sessions(spark, d).join(entries, F.col("account_id") == F.col("student_no"), "left").select("session_id", "account_id", "batch_id")
    store = Store(spark, work_path(spark, "cascade"))
    change = store.change()
    change.create("entries", entries, "student_no")
    change.create("sessions", rows, "session_id")
    change.commit()
    change = store.change()
    change.delete("entries", F.col("batch_id") == 1)
    change.update("sessions", F.col("batch_id") == 1, batch_id=F.lit(None))
    change.commit()
    left = store.read("entries").select(F.col("student_no").alias("account_id"), F.lit(True).alias("entered"))
    # what a session names exists
    return store.read("sessions").join(left, "account_id", "left").select("session_id", "account_id", F.when(F.col("entered"), F.col("batch_id")).alias("batch_id"))


@query("DML05_delete_history", "SELECT (SELECT count(*) FROM conversations WHERE conv_id % 4 = 0) AS deleted, (SELECT count(*) FROM conversations WHERE conv_id % 4 <> 0) AS kept")
def dml05(spark, d):
    """A quarter of the conversations is deleted; how many turns went, and how many are left."""
    store = Store(spark, work_path(spark, "history"))
    change = store.change()
    change.create("turns", table(spark, d, "conversations"), "conv_id", "turn")
    change.commit()
    change = store.change()
    deleted = change.delete("turns", F.col("conv_id") % 4 == 0)
    change.commit()
    return store.read("turns").agg(F.lit(deleted).cast("long").alias("deleted"), F.count(F.lit(1)).alias("kept"))


# fixed value: the letters and digits that codes are made of
_CODE = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"


def _code_sql(h: str) -> str:
    return f"array_to_string(list_transform(range(0, 6), lambda i: substr('{_CODE}', ('0x' || substr({h}, (2 * i + 1)::INTEGER, 2))::INTEGER % 32 + 1, 1)), '')"


@query("DML06_entry_codes", f"""WITH RECURSIVE t AS (SELECT c_custkey AS student_no, 0 AS try, {_code_sql("md5(c_custkey::VARCHAR || ':0')")} AS code, false AS done FROM customer
    UNION ALL SELECT student_no, try + 1, CASE WHEN k = 1 THEN code ELSE {_code_sql("md5(student_no::VARCHAR || ':' || (try + 1))")} END, k = 1 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY done DESC, student_no) AS k FROM t) WHERE try < 20)
  SELECT student_no, code FROM t WHERE try = 20""")
def dml06(spark, d):
    return unique_codes(table(spark, d, "customer").select(F.col("c_custkey").alias("student_no")))


def unique_codes(rows, tries: int = 20):
    """student_no, code: six characters from the key's hash. Of rows with one code all but the first
    try the next; codes that stood the round before win. Rounds end when no code is shared, which
    is a count of groups, and after `tries` at the latest."""

    def code(n: int):
        h = F.md5(F.concat(F.col("student_no").cast("string"), F.lit(f":{n}")))
        return F.concat(*[F.substring(F.lit(_CODE), F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") % 32 + 1, F.lit(1)) for i in range(6)])

    held = written(rows.select("student_no", code(0).alias("code"), F.lit(False).alias("done")), "codes")
    for n in range(1, tries + 1):
        if held.groupBy("code").count().where("count > 1").isEmpty():
            break
        first = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("done"), "student_no")) == 1
        held = written(held.withColumn("done", first).select("student_no", F.when(F.col("done"), F.col("code")).otherwise(code(n)).alias("code"), "done"), "codes")
    return held.select("student_no", "code")


@query("DQ01_constraints", """SELECT 'orders_customer_fk' AS name, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'lineitem_orders_fk', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'lineitem_key_unique', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'customer_name_null', count(*) FROM customer WHERE c_name IS NULL""")
def dq01(spark, d):
    o, c, li = (table(spark, d, t) for t in ("orders", "customer", "lineitem"))
    checks = {
        "orders_customer_fk": o.join(c, o.o_custkey == c.c_custkey, "left_anti"),
        "lineitem_orders_fk": li.join(o, li.l_orderkey == o.o_orderkey, "left_anti"),
        "lineitem_key_unique": li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "customer_name_null": c.where("c_name is null"),
    }
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = row if out is None else out.unionByName(row)
    return out
