"""Queries of readers, sinks, mutations, streams and the smaller rule operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import curation as C
from harborlight.plans.dialogue import TURNS, turns
from harborlight.plans import screening  # noqa: F401  (the report is made of one of its queries)
from harborlight.plans.registry import ORACLES, QUERIES, query
from harborlight.sources import readers, sinks
from harborlight.sources.folders import work_path
from harborlight.sources.store import Store
from harborlight.sources.tables import RANK, RECORDS, SESSIONS, records, sessions, table
from harborlight.streaming.log import LogReport
from harborlight.streaming.topics import run_once


@query("SRC01_table_scan", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def src01(spark, d):
    return table(spark, d, "customer").where("c_acctbal > 5000D").select("c_custkey", "c_mktsegment")


@query("SRC02_roster", "SELECT c_custkey::VARCHAR AS student_no, c_name AS student_name, nullif(trim(CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE c_mktsegment END), '') AS grade, NULL::VARCHAR AS klass FROM customer")
def src02(spark, d):
    """A roster file with a byte order mark and odd headers, written and read through the CSV reader."""
    raw = table(spark, d, "customer").selectExpr("concat(' ', c_custkey, ' ') as `﻿学号`", "concat(c_name, '\\t') as `姓名`", "case when c_custkey % 9 = 0 then '  ' else c_mktsegment end as `Grade`")
    out = work_path(spark, "roster")
    raw.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(out)
    return readers.roster_csv(spark, out)


@query("SRC10_fenced_json", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events")
def src10(spark, d):
    rows = table(spark, d, "events").withColumn("reply", F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone.")))
    return rows.select("event_id", F.from_json(readers.outer_json(F.col("reply")), "k bigint")["k"].alias("k"))


@query("SRC11_block_fields", "SELECT c_custkey, c_name AS summary, c_mktsegment AS body FROM customer")
def src11(spark, d):
    text = F.concat(F.lit("intro [summary] "), "c_name", F.lit("\n[body] "), "c_mktsegment", F.lit("\n"))
    f = readers.block_fields(text, ("summary", "body"))
    return table(spark, d, "customer").select("c_custkey", f["summary"].alias("summary"), f["body"].alias("body"))


@query("SRC12_event_stream_blocks", "SELECT event_id, unnest(['agent', event_type]) AS event, unnest([user_id::VARCHAR, props]) AS data FROM events")
def src12(spark, d):
    rows = table(spark, d, "events")
    stream = F.concat(F.lit("event: agent\ndata: "), F.col("user_id").cast("string"), F.lit("\n\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n"))
    return rows.select("event_id", F.inline(readers.sse_blocks(stream)))


@query("SNK01_daily_json", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def snk01(spark, d):
    """Events streamed into daily JSON lines, read back."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    out = work_path(spark, "daily")
    sinks.stream_daily_json(stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), f"{out}/rows", f"{out}/state")
    rows = spark.read.schema("event_id long, ts timestamp, event_type string, day string").option("basePath", f"{out}/rows").json(f"{out}/rows")
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("SNK02_dual_sink", "SELECT copy, event_type, count(*) AS n FROM events, (SELECT unnest(['json', 'table']) AS copy) GROUP BY ALL")
def snk02(spark, d):
    """Every micro-batch as JSON lines and as a table, read back from both."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select("event_id", "event_type")
    out = work_path(spark, "dual")
    stream.writeStream.foreachBatch(sinks.dual_sink(f"{out}/json", f"{out}/table")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    schema = "event_id long, event_type string"
    parts = (("json", spark.read.schema(schema).json(f"{out}/json/*")), ("table", spark.read.schema(schema).parquet(f"{out}/table/*")))
    first, second = (rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("copy"), "event_type", "n") for name, rows in parts)
    return first.unionByName(second)


@query("SNK03_report_csv", f"SELECT session_id::VARCHAR AS session_id, {', '.join(f'{k}_{c}::VARCHAR AS {k}_{c}' for k in ('phq_a', 'scared', 'sdq', 'mht') for c in ('total', 'severity'))}, any_crisis::VARCHAR AS any_crisis FROM ({ORACLES['AGG09_pivoted_summary']})")
def snk03(spark, d):
    """The pivoted summary as CSV with a byte order mark and a header that follows the scales, read
    back as text."""
    out = work_path(spark, "report")
    sinks.write_report_csv(QUERIES["AGG09_pivoted_summary"](spark, d), out)
    rows = spark.read.option("header", True).csv(out)
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns])


@query("SNK04_namespace_reset", "SELECT lang AS namespace, count(*) AS n, max(version) AS version FROM (SELECT lang, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS version, doc_id FROM documents WHERE lang <> 'en' OR doc_id % 2 = 0) GROUP BY lang")
def snk04(spark, d):
    """An index of all namespaces, of which one is built anew."""
    out = work_path(spark, "index")
    rows = table(spark, d, "documents").select(F.col("lang").alias("namespace"), "doc_id")
    sinks.reset_namespace(rows.withColumn("version", F.lit(1)), out)
    sinks.reset_namespace(rows.where("namespace = 'en' and doc_id % 2 = 0").withColumn("version", F.lit(2)), out)
    return spark.read.schema("doc_id long, version int, namespace string").parquet(out).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))


@query("SNK07_aligned_outputs", """SELECT 'samples' AS output, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents WHERE n_chars BETWEEN 50 AND 5000
  UNION ALL SELECT 'provenance', count(*), sum(doc_id)::BIGINT FROM documents WHERE n_chars BETWEEN 50 AND 5000 UNION ALL SELECT 'rejected', count(*), sum(doc_id)::BIGINT FROM documents WHERE NOT n_chars BETWEEN 50 AND 5000""")
def snk07(spark, d):
    out = work_path(spark, "aligned")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source", "n_chars")
    sinks.write_aligned(rows, out, ["text"], ["lang", "source", "n_chars"], "not n_chars between 50 and 5000")
    parts = [spark.read.schema("id long").json(f"{out}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("output"), "n", "ids") for name in ("samples", "provenance", "rejected")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SNK05_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 4 = 1")
def snk05(spark, d):
    """An index table of which a quarter is put in again by id, read back."""
    store = stored(spark, "upsert", customers=(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey"))
    change = store.change()
    change.upsert("customers", store.read("customers").where("c_custkey % 4 = 1").withColumn("c_acctbal", F.col("c_acctbal") + 1))
    change.commit()
    return store.read("customers")


def stored(spark, name, **tables):
    """A store in the shared folder with tables of (rows, key columns), published at once."""
    store = Store(spark, work_path(spark, name))
    change = store.change()
    for table_name, (rows, *key) in tables.items():
        change.create(table_name, rows, *key)
    change.commit()
    return store


@query("SNK08_instruction_export", f"WITH {RECORDS} SELECT session_id, string_agg(scale_id || ': ' || total || ' (' || severity || ')', '; ' ORDER BY record_no, scale_id, total) AS instruction FROM records GROUP BY session_id")
def snk08(spark, d):
    rows = records(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("record_no", "scale_id", "total", "severity"))).alias("r"))
    line = F.transform("r", lambda x: F.concat(x["scale_id"], F.lit(": "), x["total"].cast("string"), F.lit(" ("), x["severity"], F.lit(")")))
    return rows.select("session_id", F.array_join(line, "; ").alias("instruction"))


@query("DML01_insert", f"WITH {SESSIONS} SELECT session_id, account_id FROM sessions UNION ALL SELECT session_id + 10000000, account_id FROM sessions WHERE session_id % 100 = 0")
def dml01(spark, d):
    """New sessions and a line of the audit table for each are inserted together."""
    rows = sessions(spark, d).select("session_id", "account_id")
    audit = rows.select("session_id", F.lit("created").alias("action"))
    store = stored(spark, "insert", sessions=(rows, "session_id"), audit=(audit, "session_id"))
    new, change = rows.where("session_id % 100 = 0").withColumn("session_id", F.col("session_id") + 10000000), store.change()
    change.upsert("sessions", new)
    change.upsert("audit", new.select("session_id", F.lit("created").alias("action")))
    change.commit()
    return store.read("sessions").join(store.read("audit").where("action = 'created'"), "session_id").select("session_id", "account_id")


@query("DML02_submit", f"""WITH {RECORDS}, {SESSIONS}, n AS (SELECT session_id, count(*) AS records FROM records GROUP BY session_id)
  SELECT s.session_id, coalesce(n.records, 0) AS records, CASE WHEN n.records > 0 THEN 'completed' ELSE 'pending' END AS status FROM sessions s LEFT JOIN n ON n.session_id = s.session_id""")
def dml02(spark, d):
    """The records of a submission and the status of its sessions change in one commit."""
    found, open_ = records(spark, d), sessions(spark, d).select("session_id", F.lit("pending").alias("status"))
    key = ("session_id", "record_no")
    store = stored(spark, "submit", sessions=(open_, "session_id"), records=(found.limit(0), *key))
    change = store.change()
    change.upsert("records", found)
    done = found.select("session_id").distinct()
    change.upsert("sessions", change.read("sessions").join(done, "session_id", "left_semi").withColumn("status", F.lit("completed")))
    change.commit()
    n = store.read("records").groupBy("session_id").agg(F.count(F.lit(1)).alias("records"))
    return store.read("sessions").join(n, "session_id", "left").select("session_id", F.coalesce("records", F.lit(0)).alias("records"), "status")


@query("JOIN07_run_alignment", "SELECT c.conv_id, c.turn, c.role AS old_role, n.role AS new_role FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id + 1 AND n.turn = c.turn")
def join07(spark, d):
    old = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("old_role"))
    new = table(spark, d, "conversations").select((F.col("conv_id") - 1).alias("conv_id"), "turn", F.col("role").alias("new_role"))
    return old.join(new, ["conv_id", "turn"])


@query("JOIN08_zip_by_id", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join08(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("AGG11_miss_clusters", "SELECT lang AS topic, doc_id AS missed, count(*) OVER (PARTITION BY lang) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0")
def agg11(spark, d):
    """One row a missed case with the size of its cluster; sizes are counted before the join."""
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 0"), "doc_id")
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(sizes, "lang").select(F.col("lang").alias("topic"), F.col("doc_id").alias("missed"), "n")


_CHECKS = {"has_text": "length(text) > 0", "two_lines": "text like '%' || chr(10) || '%'", "short": "n_chars < 5000", "ends": "text like '%.'"}


@query("AGG17_report_checks", "SELECT lang, name, count(*) FILTER (ok) AS passed, count(*) AS total FROM (" + " UNION ALL ".join(f"SELECT lang, '{k}' AS name, {v} AS ok FROM documents" for k, v in _CHECKS.items()) + ") GROUP BY ALL")
def agg17(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.expr(v)).alias(k) for k, v in _CHECKS.items()])
    return rows.select("lang", "total", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("passed")) for k in _CHECKS])))


_REPORT = _CHECKS | {
    "not_long": "n_chars < 20000", "not_blank": "length(trim(text)) > 0", "starts_upper": "upper(substr(text, 1, 1)) = substr(text, 1, 1)", "no_bars": "not contains(text, '|')", "no_money": "not contains(text, '$')",
    "no_shouting": "not contains(text, '!!')", "has_comma": "contains(text, ',')", "has_stop": "contains(text, '.')", "no_address": "not contains(text, '@')", "no_link": "not contains(text, 'http')", "known_language": "lang in ('en', 'de', 'fr', 'es')",
}


@query("AGG17b_failed_checks", f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS text, lang, n_chars FROM documents), f AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN NOT ({v}) THEN '{k}' END" for k, v in _REPORT.items())}], lambda x: x IS NOT NULL) AS failed FROM r)
  SELECT doc_id, {len(_REPORT)} - len(failed) AS passed, round(({len(_REPORT)} - len(failed)) / {len(_REPORT)}, 4) AS rate, failed FROM f""")
def agg17b(spark, d):
    """Fifteen checks a document: how many pass, and the names of those that fail."""
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    failed = F.array_compact(F.array(*[F.when(~F.expr(v), F.lit(k)) for k, v in _REPORT.items()]))
    passed = (F.lit(len(_REPORT)) - F.size("failed")).cast("long")
    return rows.select("doc_id", failed.alias("failed")).select("doc_id", passed.alias("passed"), F.round(passed / len(_REPORT), 4).alias("rate"), "failed")


@query("FN01_text_keys", f"""SELECT doc_id, md5(regexp_replace(lower(t), '[^0-9a-z\u4e00-\u9fff]', '', 'g')) AS latin_han, md5(translate(t, '.,;:!?', '')) AS unpunctuated,
  md5(regexp_replace(regexp_replace(t, '《[^》]*》', '', 'g'), '[ \\t\\r\\n]+', '', 'g')) AS untitled,
  ('0x' || array_to_string(list_transform([7, 6, 5, 4, 3, 2, 1, 0], lambda i: substr(md5(t), 2 * i + 1, 2)), ''))::UBIGINT::VARCHAR AS hash FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def fn01(spark, d):
    """The other normalisation rules and the digest number."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.md5(T.key_latin_han(t)).alias("latin_han"), F.md5(T.without_punctuation(t)).alias("unpunctuated"), F.md5(T.without_titles(t)).alias("untitled"), T.md5_long(t).alias("hash"))


@query("FN02_times_maps_json", """SELECT event_id, ts + INTERVAL 8 HOUR AS local, ts >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-25' AS recent, date_diff('day', ts::DATE, DATE '2024-02-01') AS days_left,
  json_extract(props, '$.k')::BIGINT + 1 AS shifted, '{"id":' || event_id || ',"type":"' || event_type || '","tags":["a","b"]}' AS line, 3 AS keys FROM events""")
def fn02(spark, d):
    """Time zones, days before an as-of date, maps with cast keys and merges, and JSON both ways."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    numbered = F.map_from_entries(F.transform(F.map_entries(F.create_map(F.lit("1"), F.lit("x"), F.lit("2"), F.lit("y"))), lambda e: F.struct(e["key"].cast("int"), e["value"])))
    merged = F.map_concat(numbered, F.create_map(F.lit(3), F.lit("z")))
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.array(F.lit("a"), F.lit("b")).alias("tags")))
    return rows.select(
        "event_id", F.from_utc_timestamp("ts", "Asia/Shanghai").cast("timestamp_ntz").alias("local"), F.expr("ts >= timestamp'2024-01-25' - interval 7 day and ts < timestamp'2024-01-25'").alias("recent"),
        F.datediff(F.lit("2024-02-01").cast("date"), F.to_date("ts")).cast("long").alias("days_left"), (F.from_json("props", "k bigint")["k"] + 1).alias("shifted"), line.alias("line"), F.size(merged).alias("keys"),
    )


@query("TXT11_label_audit", f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'drop:system' WHEN len(text) < 60 THEN 'drop:short' WHEN regexp_matches(text, '[ß]') AND role = 'user' THEN 'reroute:help' ELSE 'keep' END AS verdict FROM turns""")
def txt11(spark, d):
    v = F.when(F.col("role") == "system", "drop:system").when(F.length("text") < 60, "drop:short").when(F.col("text").rlike("[ß]") & (F.col("role") == "user"), "reroute:help").otherwise("keep")
    return turns(spark, d).select("conv_id", "turn", v.alias("verdict"))


@query("TXT12_persona_lookup", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'companion' ELSE 'default' END AS persona FROM conversations")
def txt12(spark, d):
    names = F.create_map(F.lit("user"), F.lit("student"), F.lit("assistant"), F.lit("companion"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(F.try_element_at(names, F.col("role")), F.lit("default")).alias("persona"))


@query("QC08_dataset_rules", f"""WITH {TURNS}, l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS last FROM turns GROUP BY conv_id)
  SELECT conv_id, count(*) FILTER (role = 'assistant' AND NOT len(text) BETWEEN 50 AND 800) AS bad_length, count(*) FILTER (role = 'assistant' AND regexp_matches(text, '(ant|ist)[.]')) AS closed,
  bool_or(regexp_matches(text, 'lich')) AS banned, bool_or(role = 'user' AND regexp_matches(text, 'tion')) AND NOT regexp_matches(coalesce(any_value(last), ''), 'qu') AS no_help,
  NOT regexp_matches(coalesce(any_value(last), ''), 'la|the|der|de') AS no_warmth, count(*) FILTER (role = 'assistant' AND NOT contains(text, ',')) AS no_source FROM turns JOIN l USING (conv_id) GROUP BY conv_id""")
def qc08(spark, d):
    """Rules over whole conversations: lengths, closed questions, banned wording, the last reply's
    help (where a user's turn asks for it) and warmth, and replies without a source mark."""
    reply, text = F.col("role") == "assistant", F.col("text")
    rows = turns(spark, d).groupBy("conv_id").agg(
        F.count_if(reply & ~F.length(text).between(50, 800)).alias("bad_length"), F.count_if(reply & text.rlike("(ant|ist)[.]")).alias("closed"), F.bool_or(text.rlike("lich")).alias("banned"),
        F.bool_or((F.col("role") == "user") & text.rlike("tion")).alias("asked"), F.coalesce(F.max_by(text, F.when(reply, F.col("turn"))), F.lit("")).alias("last"), F.count_if(reply & ~text.contains(",")).alias("no_source"), F.count_if(reply).alias("replies"),
    )
    last = F.when(F.col("replies") > 0, F.col("last")).otherwise("")
    return rows.select("conv_id", "bad_length", "closed", "banned", (F.col("asked") & ~last.rlike("qu")).alias("no_help"), (~last.rlike("la|the|der|de")).alias("no_warmth"), "no_source")


@query("QC09_side_car", f"""WITH {TURNS}, p AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS reply FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  SELECT conv_id, turn, regexp_matches(reply, 'ention') AS corrected FROM p WHERE role = 'user' AND next_role = 'assistant' AND regexp_matches(text, 'tion') AND NOT regexp_matches(reply, 'thtion')""")
def qc09(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns(spark, d).withColumn("next_role", F.lead("role").over(w)).withColumn("reply", F.lead("text").over(w))
    rows = rows.where((F.col("role") == "user") & (F.col("next_role") == "assistant") & F.col("text").rlike("tion") & ~F.col("reply").rlike("thtion"))
    return rows.select("conv_id", "turn", F.col("reply").rlike("ention").alias("corrected"))


@query("FLT10_non_compliant", "SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND (regexp_matches(text, 'tion the|de la') OR regexp_matches(text, '(ant|ist)[.]'))")
def flt10(spark, d):
    return turns(spark, d).where((F.col("role") == "assistant") & (F.col("text").rlike("tion the|de la") | F.col("text").rlike("(ant|ist)[.]"))).select("conv_id", "turn")


@query("FLT04_keyset", f"WITH {SESSIONS} SELECT session_id FROM sessions WHERE created_at < TIMESTAMP '1996-01-01' AND account_id IS NULL")
def flt04(spark, d):
    return sessions(spark, d).where("created_at < timestamp'1996-01-01' and account_id is null").select("session_id")


_RANKS = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RANK.items()) + " END"


@query("SCO14_narrative_checks", f"""WITH {TURNS}, {RECORDS}, v AS (SELECT session_id, max({_RANKS}) AS rank FROM records GROUP BY session_id), t AS (SELECT turns.*, coalesce(rank, 0) AS rank FROM turns LEFT JOIN v ON session_id = conv_id WHERE role = 'assistant')
  SELECT conv_id, turn, list_filter([CASE WHEN NOT len(text) BETWEEN 300 AND 500 THEN 'length' END, CASE WHEN len(string_split(text, chr(10))) < 2 THEN 'sections' END,
  CASE WHEN NOT regexp_matches(text, 'tion|ung|ción') THEN 'finding' END, CASE WHEN NOT regexp_matches(text, 'que|der|the') THEN 'context' END, CASE WHEN NOT regexp_matches(text, 'en|an') THEN 'outlook' END,
  CASE WHEN NOT regexp_matches(text, 'ment|lich') THEN 'suggestion' END, CASE WHEN rank >= 3 AND NOT regexp_matches(text, 'reau|schei|thion') THEN 'referral' END,
  CASE WHEN rank = 0 AND regexp_matches(text, 'lich|eaux') THEN 'alarming' END], lambda x: x IS NOT NULL) AS failed FROM t""")
def sco14(spark, d):
    """Narratives against their rules; what a severe or an unremarkable result asks for depends on
    the worst severity of the session with the conversation's number."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    worst = records(spark, d).groupBy(F.col("session_id").alias("conv_id")).agg(F.max(rank[F.col("severity")]).alias("rank"))
    rows = turns(spark, d).where("role = 'assistant'").join(worst, "conv_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0)))
    text = F.col("text")
    tests = {
        "length": ~F.length(text).between(300, 500), "sections": F.size(F.split(text, "\n")) < 2, "finding": ~text.rlike("tion|ung|ción"), "context": ~text.rlike("que|der|the"), "outlook": ~text.rlike("en|an"),
        "suggestion": ~text.rlike("ment|lich"), "referral": (F.col("rank") >= 3) & ~text.rlike("reau|schei|thion"), "alarming": (F.col("rank") == 0) & text.rlike("lich|eaux"),
    }
    return rows.select("conv_id", "turn", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).alias("failed"))


@query("DED08_cap_and_mix", """WITH m AS (SELECT doc_id FROM documents WHERE lang <> 'en' ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT 200)
  SELECT doc_id, 'human' AS kind FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'machine' FROM m""")
def ded08(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang")
    machine = rows.where("lang <> 'en'").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(200)
    return rows.where("lang = 'en'").select("doc_id", F.lit("human").alias("kind")).unionByName(machine.select("doc_id", F.lit("machine").alias("kind")))


@query("DED07_merge", """WITH t AS (SELECT item_id - 1000000 AS id, lower(coalesce(text, '')) AS x FROM benchmark UNION ALL SELECT doc_id, lower(coalesce(text, '')) FROM documents),
  s AS (SELECT id, CASE WHEN len(x) >= 4 THEN list_distinct(list_transform(range(1, len(x) - 2), lambda i: substr(x, i, 4))) ELSE [x] END AS g FROM t WHERE x <> ''),
  p AS (SELECT b.id, len(a.g) AS na, len(b.g) AS nb, len(list_intersect(a.g, b.g)) AS k FROM s a JOIN s b ON a.id < b.id AND len(a.g) * 10 >= len(b.g) * 8 AND len(b.g) * 10 >= len(a.g) * 8)
  SELECT id, md5('42:' || id) AS shuffle_key, 'prompt' AS system FROM t WHERE id NOT IN (SELECT id FROM p WHERE k >= 0.8::DOUBLE * (na + nb - k))""")
def ded07(spark, d):
    """Two inputs by priority, near-duplicates out, seeded order, one system prompt for all."""
    a = table(spark, d, "benchmark").select((F.col("item_id") - 1_000_000).alias("id"), "text")
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    rows = a.unionByName(b)
    kept = rows.join(C.near_duplicates(rows.select("id", F.lower("text").alias("text"))), "id", "left_anti")
    return kept.select("id", F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))).alias("shuffle_key"), F.lit("prompt").alias("system"))


@query("STR06_weekly_topics", "SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type AS topic, count(*) AS n FROM events GROUP BY ALL")
def str06(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("topic"))
    return run_once(spark, rows).withColumn("week", F.col("week").cast("timestamp_ntz"))


#: Lines of the log: broken ones, lines without a time, and two files, of which the second one has old lines.
_LOG = """l AS (SELECT *, event_id % 97 = 0 AS broken, event_id % 89 = 0 AS untimed, event_id % 3 = 0 AS second FROM events),
  g AS (SELECT * FROM l WHERE NOT broken AND NOT untimed), f AS (SELECT max(ts) AS latest FROM g WHERE NOT second),
  k AS (SELECT g.*, second AND ts <= latest - INTERVAL 14 DAY AS late FROM g, f)"""
_LOG_REPORT = """SELECT strftime(ts, '%G-W%V') AS week, event_type AS topic, count(*) AS n, count(*) >= 200 AS flagged, list_sort(list_distinct(list(user_id % 7))) AS modes,
  list(round(value, 2) ORDER BY ts, event_id)[:5] AS firsts, list_sort(list_transform(map_entries(histogram(user_id % 7)), lambda e: e.key || ':' || e.value)) AS frequencies FROM k WHERE NOT late GROUP BY ALL"""


def logged(spark, d):
    """The events as two files of JSON lines, streamed into a weekly report one after the other."""
    out, rows = work_path(spark, "log"), table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    time = F.when(F.col("event_id") % 89 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    line = F.when(F.col("event_id") % 97 == 0, F.expr("left(line, 20)")).otherwise(F.col("line"))
    rows = rows.withColumn("line", F.to_json(F.struct(time.alias("ts"), "event_id", F.col("event_type").alias("topic"), F.expr("user_id % 7").alias("mode"), F.round("value", 2).alias("distance"))))
    report = LogReport(spark, f"{out}/report")
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        rows.where(part).select(line.alias("value")).write.mode("append").text(f"{out}/lines")
        report.absorb(spark.readStream.text(f"{out}/lines"))
    return report


@query("STR06b_log_report", f"WITH {_LOG} {_LOG_REPORT}")
def str06b(spark, d):
    """The weekly report of a log that grew between two runs; late lines are left out."""
    return logged(spark, d).rows(200)


@query("SRC04b_log_lines", f"WITH {_LOG} SELECT (SELECT count(*) FROM l) AS lines, (SELECT count(*) FROM l WHERE broken OR untimed) AS bad, (SELECT count(*) FROM k WHERE late) AS late")
def src04b(spark, d):
    """How many lines the log has, and how many of them are bad or late."""
    return logged(spark, d).totals()
