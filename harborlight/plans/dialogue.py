"""Queries over conversations and documents: routing, tagging, windows and reply checks.

The invented texts hold none of the domain's words, so the rules take words that occur in them.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import overlap as O
from harborlight.plans.registry import query
from harborlight.sources import readers
from harborlight.sources.tables import table
from harborlight.streaming.windows import rolling

KEYWORDS, NEGATORS = ("reau", "tion", "thth", "ment"), ("le", "de", "an")
CATEGORIES = {"first": ("thion", "tionth"), "second": ("reau", "eaux"), "third": ("schei", "lich"), "fourth": ("ciónll",)}
_WS = "chr(32) || chr(9) || chr(10) || chr(13)"
TURNS = "turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"


def turns(spark, d):
    return table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))


def _signals_sql() -> str:
    parts = []
    for k in KEYWORDS:
        parts.append(f"""CASE WHEN len(list_filter(range(1, len(low) + 1), lambda i: substr(low, i, {len(k)}) = '{k}'
          AND NOT regexp_matches(substr(low, greatest(1, i - 6), i - greatest(1, i - 6)), '({'|'.join(NEGATORS)})[\\s]*$'))) > 0 THEN '{k}' END""")
    return f"WITH {TURNS}, l AS (SELECT conv_id, turn, lower(text) AS low FROM turns) SELECT conv_id, turn, list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS words FROM l"


@query("TXT01_signal_words", _signals_sql())
def txt01(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.signal_words(F.col("text"), KEYWORDS, NEGATORS).alias("words"))


GREETINGS = ("et", "la", "der", "the", "el", "in", "de la")
COURTESY, PARTICLE = "^(se|un|an|que) ", " (con|mit|for)$"
ROUTES = (("service", "ß|üb"), ("method", "tion[^.]{0,10}(the|de)"), ("knowledge", "(est|ist|is) (la|der|the)"), ("channel", "qu"), ("plea", "ciónes"))
METHOD_LEN, KNOWLEDGE_LEN = 200, 120


def _greeting_sql(t: str) -> str:
    parts = f"list_filter(regexp_split_to_array({t}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    bare = f"regexp_replace({t}, '{COURTESY}', '')"
    return f"(len({t}) BETWEEN 1 AND 30 AND ({t} IN {GREETINGS} OR {bare} IN {GREETINGS} OR regexp_replace({bare}, '{PARTICLE}', '') IN {GREETINGS} OR (len({parts}) > 0 AND len(list_filter({parts}, lambda x: x NOT IN {GREETINGS})) = 0)))"


def greeting(t):
    """Whether a stripped lower-case text is a greeting, one behind a courtesy, one with a particle
    after it, or nothing but greetings' words."""
    bare = F.regexp_replace(t, COURTESY, "")
    parts = F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda x: x != "")
    known = (F.size(parts) > 0) & F.forall(parts, lambda x: x.isin(*GREETINGS))
    return F.length(t).between(1, 30) & (t.isin(*GREETINGS) | bare.isin(*GREETINGS) | F.regexp_replace(bare, PARTICLE, "").isin(*GREETINGS) | known)


@query("TXT02_greeting", f"""WITH {TURNS}, s AS (SELECT conv_id, turn, trim(lower(split_part(text, '.', 1)), {_WS}) AS t FROM turns)
  SELECT conv_id, turn, {_greeting_sql('t')} AS greeting FROM s""")
def txt02(spark, d):
    t = T.strip(F.lower(F.split_part("text", F.lit("."), F.lit(1))))
    return turns(spark, d).select("conv_id", "turn", greeting(t).alias("greeting"))


_ROUTE = " ".join(f"WHEN {'len(t) BETWEEN 1 AND ' + str(m) + ' AND ' if m else ''}regexp_matches(t, '{p}') THEN '{n}'" for (n, p), m in zip(ROUTES, (0, METHOD_LEN, KNOWLEDGE_LEN, 0, 0)))


@query("TXT06_intent", f"""WITH {TURNS}, s AS (SELECT conv_id, turn, trim(lower(text), {_WS}) AS t FROM turns)
  SELECT conv_id, turn, CASE WHEN regexp_matches(t, 'error|worthless') AND NOT regexp_matches(t, '(le|de|an)[ \\t\\n]*(error|worthless)') THEN 'crisis' WHEN {_greeting_sql('t')} THEN 'greeting' {_ROUTE} ELSE 'vent' END AS intent FROM s""")
def txt06(spark, d):
    t = T.strip(F.lower(F.col("text")))
    p = dict(ROUTES)
    rules = (
        ("crisis", t.rlike("error|worthless") & ~t.rlike("(le|de|an)[ \\t\\n]*(error|worthless)")), ("greeting", greeting(t)), ("service", t.rlike(p["service"])), ("method", T.short(t, p["method"], METHOD_LEN)),
        ("knowledge", T.short(t, p["knowledge"], KNOWLEDGE_LEN)), ("channel", t.rlike(p["channel"])), ("plea", t.rlike(p["plea"])),
    )
    return turns(spark, d).select("conv_id", "turn", T.first_match(rules, "vent").alias("intent"))


for _name, _pattern, _most in (("TXT03_method_question", ROUTES[1][1], METHOD_LEN), ("TXT04_knowledge_question", ROUTES[2][1], KNOWLEDGE_LEN)):

    @query(_name, f"WITH {TURNS}, s AS (SELECT conv_id, turn, trim(text, {_WS}) AS t FROM turns) SELECT conv_id, turn FROM s WHERE len(t) BETWEEN 1 AND {_most} AND regexp_matches(t, '{_pattern}')")
    def txt03(spark, d, pattern=_pattern, most=_most):
        return turns(spark, d).where(T.short(F.col("text"), pattern, most)).select("conv_id", "turn")


@query("TXT05_detectors", f"WITH {TURNS} SELECT conv_id, turn, regexp_matches(text, 'ß|üb') AS service, regexp_matches(text, 'ciónes') AS plea, regexp_matches(text, 'qu') AS channel FROM turns")
def txt05(spark, d):
    return turns(spark, d).select("conv_id", "turn", *[F.col("text").rlike(p).alias(n) for n, p in (("service", "ß|üb"), ("plea", "ciónes"), ("channel", "qu"))])


@query("TXT07_graph_route", f"""WITH {TURNS} SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'error|worthless') THEN ['triage', 'escalation'] WHEN len(text) < 40 THEN ['triage', 'end']
  ELSE ['triage', 'assessment', 'intervention'] END AS path FROM turns""")
def txt07(spark, d):
    def path(*steps):
        return F.array(*map(F.lit, steps))

    crisis = F.lower("text").rlike("error|worthless")
    return turns(spark, d).select("conv_id", "turn", F.when(crisis, path("triage", "escalation")).when(F.length("text") < 40, path("triage", "end")).otherwise(path("triage", "assessment", "intervention")).alias("path"))


@query("TXT08_topic", f"""WITH {TURNS} SELECT CASE WHEN regexp_matches(lower(text), 'worthless') THEN 'crisis' WHEN regexp_matches(lower(text), 'thion|tionth') THEN 'exams'
  WHEN regexp_matches(lower(text), 'eaux') THEN 'family' WHEN regexp_matches(lower(text), 'lich') THEN 'sleep' ELSE 'other' END AS topic, count(*) AS n FROM turns GROUP BY 1""")
def txt08(spark, d):
    low = F.lower("text")
    topic = T.first_match((("crisis", low.rlike("worthless")), ("exams", low.rlike("thion|tionth")), ("family", low.rlike("eaux")), ("sleep", low.rlike("lich"))), "other")
    return turns(spark, d).groupBy(topic.alias("topic")).agg(F.count(F.lit(1)).alias("n"))


_CATS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{n}' END" for n, w in CATEGORIES.items()) + "], lambda x: x IS NOT NULL)"


@query("TXT09_categories", f"WITH {TURNS} SELECT conv_id, turn, {_CATS} AS categories FROM turns")
def txt09(spark, d):
    return turns(spark, d).select("conv_id", "turn", T.categories(F.col("text"), CATEGORIES).alias("categories"))


@query("TXT10_clean_text", f"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(text, chr(10), chr(10) || ' '), chr(10)),
  lambda x: trim(x, ' ' || chr(9))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), {_WS})) AS digest FROM documents""")
def txt10(spark, d):
    padded = F.regexp_replace("text", "\n", "\n ")
    return table(spark, d, "documents").select("doc_id", F.md5(T.clean_lines(padded)).alias("digest"))


SURNAMES, TITLES = ("Que", "The", "Der"), (" de", " la", " the", " und")
_NAME = f"({'|'.join(SURNAMES)})[\\p{{L}}]{{1,3}}({'|'.join(TITLES)})"


@query("PRJ01_masking", f"SELECT doc_id, md5(regexp_replace(regexp_replace(coalesce(text, ''), '{_NAME}', '<name>', 'g'), '[0-9]{{6,}}', '<number>', 'g')) AS digest FROM documents")
def prj01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.masked(F.coalesce("text", F.lit("")), SURNAMES, TITLES)).alias("digest"))


@query("PRJ02_question_rewrite", f"""WITH {TURNS} SELECT conv_id, turn, regexp_replace(text, 'tion\\.', (['tion, how?', 'tion, what?', 'tion, where?'])[(conv_id * 31 + turn) % 3 + 1]) AS text FROM turns WHERE contains(text, 'tion.')""")
def prj02(spark, d):
    ending = F.expr("element_at(array('tion, how?', 'tion, what?', 'tion, where?'), cast((conv_id * 31 + turn) % 3 + 1 as int))")
    rows = turns(spark, d).where(F.col("text").contains("tion."))
    at = F.instr("text", "tion.")
    return rows.select("conv_id", "turn", F.concat(F.expr("substring(text, 1, instr(text, 'tion.') - 1)"), ending, F.substring("text", at + 5, F.length("text"))).alias("text"))


@query("PRJ03_truncation", f"WITH {TURNS} SELECT conv_id, turn, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS clipped FROM turns")
def prj03(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("clipped"))


@query("PRJ04_role_clip", f"""WITH {TURNS} SELECT conv_id, list(turn ORDER BY turn) AS kept FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns WHERE role IN ('user', 'assistant')) WHERE k <= 4 GROUP BY conv_id""")
def prj04(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns(spark, d).where(F.col("role").isin("user", "assistant")).withColumn("k", F.row_number().over(w)).where("k <= 4")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("kept"))


@query("WIN02_recent_turns", f"WITH {TURNS} SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM turns) WHERE k <= 4")
def win02(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 4").select("conv_id", "turn")


@query("WIN03_previous_reply", f"""WITH {TURNS} SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN turn END IGNORE NULLS) OVER
  (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM turns""")
def win03(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return turns(spark, d).select("conv_id", "turn", F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(w).alias("previous"))


@query("WIN04_running_history", f"""WITH {TURNS} SELECT conv_id, turn, coalesce(sum(len(text)) FILTER (role = 'user') OVER w, 0)::BIGINT AS user_chars, count(*) FILTER (role = 'assistant') OVER w AS replies FROM turns
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def win04(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).over(w)
    return turns(spark, d).select("conv_id", "turn", F.coalesce(size, F.lit(0)).cast("long").alias("user_chars"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).over(w), F.lit(0)).alias("replies"))


GRAM = 12
_OVERLAP = f"""g AS (SELECT DISTINCT conv_id, turn, role, substr(text, i, {GRAM}) AS gram FROM (SELECT conv_id, turn, role, text, unnest(range(1, len(text) - {GRAM - 2})) AS i FROM turns WHERE role = 'assistant')),
  o AS (SELECT DISTINCT a.conv_id, a.turn FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.gram = b.gram AND b.turn < a.turn)"""


def overlaps(rows):
    """conv_id, turn, overlap: the first longest piece of GRAM characters or more that one earlier
    reply of the conversation has, too."""
    return O.overlaps(rows.where("role = 'assistant'"), GRAM)


def repeated(rows):
    """Replies that share GRAM characters with an earlier reply of their conversation."""
    return overlaps(rows).select("conv_id", "turn")


@query("JOIN10_verbatim_overlap", f"WITH {TURNS}, {_OVERLAP} SELECT * FROM o")
def join10(spark, d):
    return repeated(turns(spark, d))


_CLAIM = r"que ([^,.\s]{4,20})"
_CLAIMS = f"""u AS (SELECT a.conv_id, a.turn, coalesce(string_agg(h.text, ' ' ORDER BY h.turn), '') AS said FROM turns a LEFT JOIN turns h ON h.conv_id = a.conv_id AND h.turn < a.turn AND h.role = 'user' WHERE a.role = 'assistant' GROUP BY ALL),
  c AS (SELECT a.conv_id, a.turn, len(list_filter(regexp_extract_all(a.text, '{_CLAIM}', 1), lambda x: NOT contains(u.said, x) AND len(list_filter(range(1, len(x) - 2), lambda i: contains(u.said, substr(x, i, 4)))) = 0)) AS claims
    FROM turns a JOIN u ON u.conv_id = a.conv_id AND u.turn = a.turn)"""


def claims(rows):
    """conv_id, turn, claims of every reply: phrases behind the claim word of which no four
    characters occur in what the user said before (an equi-join on 4-grams with the first turn
    that has each)."""
    four = lambda x: F.filter(T.shingles(x, 4), lambda g: F.length(g) == 4)
    replies = rows.where("role = 'assistant'").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(_CLAIM), F.lit(1)).alias("found"))
    asked = replies.select("conv_id", "turn", F.posexplode("found").alias("place", "claim"))
    asked = asked.select("conv_id", "turn", "place", F.explode(four(F.col("claim"))).alias("gram"))
    said = rows.where("role = 'user'").select("conv_id", "turn", F.explode(four(F.col("text"))).alias("gram")).groupBy("conv_id", "gram").agg(F.min("turn").alias("first"))
    known = asked.join(said, ["conv_id", "gram"]).where("first < turn").select("conv_id", "turn", "place").distinct().groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("known"))
    return replies.join(known, ["conv_id", "turn"], "left").select("conv_id", "turn", (F.size("found") - F.coalesce("known", F.lit(0))).cast("long").alias("claims"))


@query("QC05_unsupported_claims", f"WITH {TURNS}, {_CLAIMS} SELECT * FROM c")
def qc05(spark, d):
    return claims(turns(spark, d))


_GATE = f"""WITH {TURNS}, {_OVERLAP}, {_CLAIMS}, w AS (SELECT *, {_CATS} AS cats, last_value(CASE WHEN role = 'assistant' THEN {_CATS} END IGNORE NULLS) OVER
    (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns),
  q AS (SELECT w.conv_id, w.turn, list_filter([CASE WHEN trim(text, {_WS}) = '' THEN 'empty' END, CASE WHEN regexp_matches(text, '(ant|ist)[.]') THEN 'closed_question' END,
    CASE WHEN len(text) - len(replace(text, ',', '')) > 9 THEN 'many_questions' END, CASE WHEN len(trim(text, {_WS})) > 600 THEN 'long' END, CASE WHEN len(cats) < 1 THEN 'few_methods' END,
    CASE WHEN len(list_intersect(cats, coalesce(before, []))) > 0 THEN 'same_method' END, CASE WHEN o.turn IS NOT NULL THEN 'verbatim' END,
    CASE WHEN len(trim(text, {_WS})) BETWEEN 1 AND 24 THEN 'short' END, CASE WHEN c.claims > 0 THEN 'unsupported' END], lambda x: x IS NOT NULL) AS issues
  FROM w LEFT JOIN o ON o.conv_id = w.conv_id AND o.turn = w.turn LEFT JOIN c ON c.conv_id = w.conv_id AND c.turn = w.turn WHERE role = 'assistant')"""


def issues(spark, d):
    rows = turns(spark, d).withColumn("cats", T.categories(F.col("text"), CATEGORIES))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last(F.when(F.col("role") == "assistant", F.col("cats")), ignorenulls=True).over(w)).where("role = 'assistant'")
    rows = rows.join(repeated(turns(spark, d)).withColumn("verbatim", F.lit(True)), ["conv_id", "turn"], "left")
    rows = rows.join(claims(turns(spark, d)), ["conv_id", "turn"], "left")
    text = T.strip(F.col("text"))
    tests = {
        "empty": text == "", "closed_question": F.col("text").rlike("(ant|ist)[.]"), "many_questions": F.regexp_count("text", F.lit(",")) > 9,
        "long": F.length(text) > 600, "few_methods": F.size("cats") < 1,
        "same_method": F.size(F.array_intersect("cats", F.coalesce("before", F.array().cast("array<string>")))) > 0, "verbatim": F.col("verbatim"),
        "short": F.length(text).between(1, 24), "unsupported": F.col("claims") > 0,
    }
    return rows.select("conv_id", "turn", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).alias("issues"))


@query("QC02_issues", f"{_GATE} SELECT * FROM q")
def qc02(spark, d):
    return issues(spark, d)


@query("QC01_reply_gate", f"{_GATE} SELECT conv_id, turn, len(issues) = 0 AS passed FROM q")
def qc01(spark, d):
    return issues(spark, d).select("conv_id", "turn", (F.size("issues") == 0).alias("passed"))


@query("AGG16_issue_histogram", f"{_GATE} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM q) GROUP BY issue")
def agg16(spark, d):
    return issues(spark, d).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


_METHODS = f"m AS (SELECT conv_id, bool_and(len(t) BETWEEN 1 AND 200 AND regexp_matches(t, '{ROUTES[1][1]}')) FILTER (role = 'user') AS asked, len(list_distinct(flatten(list({_CATS}) FILTER (role = 'assistant')))) AS methods FROM (SELECT *, trim(text, {_WS}) AS t FROM turns) GROUP BY conv_id)"


@query("AGG15_scenario_pass", f"""{_GATE}, {_METHODS} SELECT q.conv_id, count(*) AS turns, count(*) FILTER (NOT list_contains(issues, 'long')) AS passed,
  bool_and(NOT list_contains(issues, 'long')) AND (any_value(methods) >= 3 OR NOT coalesce(any_value(asked), false)) AS scenario_pass FROM q JOIN m ON m.conv_id = q.conv_id GROUP BY q.conv_id""")
def agg15(spark, d):
    """A scenario passes with all its turns; if every user turn asks for a method, its replies need
    three kinds of them."""
    rows = turns(spark, d).withColumn("cats", T.categories(F.col("text"), CATEGORIES))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    asked = F.bool_and(F.when(user, T.short(F.col("text"), ROUTES[1][1], METHOD_LEN)))
    methods = F.size(F.array_distinct(F.flatten(F.collect_list(F.when(reply, F.col("cats"))))))
    kinds = rows.groupBy("conv_id").agg(F.coalesce(asked, F.lit(False)).alias("asked"), methods.alias("methods"))
    ok = ~F.array_contains("issues", "long")
    out = issues(spark, d).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count_if(ok).alias("passed"), F.bool_and(ok).alias("all")).join(kinds, "conv_id")
    return out.select("conv_id", "turns", "passed", (F.col("all") & ((F.col("methods") >= 3) | ~F.col("asked"))).alias("scenario_pass"))


@query("SET04_scenario_categories", f"WITH {TURNS} SELECT conv_id, list_sort(list_distinct(flatten(list({_CATS})))) AS categories FROM turns GROUP BY conv_id")
def set04(spark, d):
    rows = turns(spark, d).withColumn("c", T.categories(F.col("text"), CATEGORIES))
    return rows.groupBy("conv_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("c")))).alias("categories"))


@query("SET03_shared_categories", f"WITH {TURNS}, a AS (SELECT conv_id, turn, {_CATS} AS c, lag({_CATS}) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM turns) SELECT conv_id, turn, list_sort(list_intersect(c, p)) AS shared FROM a WHERE p IS NOT NULL")
def set03(spark, d):
    rows = turns(spark, d).withColumn("c", T.categories(F.col("text"), CATEGORIES))
    rows = rows.withColumn("p", F.lag("c").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p is not null")
    return rows.select("conv_id", "turn", F.sort_array(F.array_intersect("c", "p")).alias("shared"))


@query("FLT08_shape_filter", "SELECT conv_id, turn FROM conversations WHERE len(text) BETWEEN 8 AND 150 AND regexp_matches(text, '[äöüßéèñ]')")
def flt08(spark, d):
    return turns(spark, d).where(F.length("text").between(8, 150) & F.col("text").rlike("[äöüßéèñ]")).select("conv_id", "turn")


@query("FLT09_template_phrases", "SELECT DISTINCT conv_id FROM conversations EXCEPT SELECT conv_id FROM conversations WHERE role = 'assistant' AND regexp_matches(text, 'tion the|de la|der die|lich')")
def flt09(spark, d):
    bad = turns(spark, d).where((F.col("role") == "assistant") & F.col("text").rlike("tion the|de la|der die|lich"))
    return turns(spark, d).select("conv_id").distinct().join(bad, "conv_id", "left_anti")


@query("SRC05_sample_validation", """SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING count(*) >= 2 AND bool_and(role IN ('user', 'assistant')) AND bool_and(trim(coalesce(text, '')) <> '')""")
def src05(spark, d):
    """Conversations as lines of JSON, read back and validated."""
    turn = F.struct(F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role")).alias("from"), F.col("text").alias("value"))
    rows = turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))).alias("t"))
    lines = rows.select("conv_id", F.to_json(F.transform("t", lambda x: x["t"])).alias("line"))
    return readers.valid_samples(lines, "line").select("conv_id", F.size("sample").cast("long").alias("turns"))


@query("SRC06_alternation", f"""WITH {TURNS}, k AS (SELECT conv_id, list(role ORDER BY turn) AS roles FROM turns WHERE role IN ('user', 'assistant') AND trim(text, {_WS}) <> '' GROUP BY conv_id)
  SELECT conv_id FROM k WHERE len(roles) >= 2 AND len(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0""")
def src06(spark, d):
    """Empty turns and unknown roles are dropped first; what is left has to alternate."""
    rows = turns(spark, d).where(F.col("role").isin("user", "assistant") & (T.strip(F.col("text")) != "")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return rows.where("size(t) >= 2 and forall(sequence(1, size(t)), i -> element_at(t, i).role = if(i % 2 = 1, 'user', 'assistant'))").select("conv_id")


@query("SRC07_first_pair", f"""WITH {TURNS} SELECT u.conv_id, md5(u.text) AS human, md5(a.text) AS reply FROM (SELECT conv_id, arg_min(text, turn) AS text FROM turns WHERE role = 'user' GROUP BY conv_id) u
  JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM turns WHERE role = 'assistant' GROUP BY conv_id) a ON a.conv_id = u.conv_id""")
def src07(spark, d):
    rows = turns(spark, d).groupBy("conv_id").agg(*[F.md5(F.min_by("text", F.when(F.col("role") == r, F.col("turn")))).alias(n) for r, n in (("user", "human"), ("assistant", "reply"))], F.count_if(F.col("role") == "user").alias("u"), F.count_if(F.col("role") == "assistant").alias("a"))
    return rows.where("u > 0 and a > 0").select("conv_id", "human", "reply")


_PLACES = f"""pl AS (SELECT conv_id, turn, i, substr(text, i, {GRAM}) AS gram FROM (SELECT conv_id, turn, text, unnest(range(1, len(text) - {GRAM - 2})) AS i FROM turns WHERE role = 'assistant')),
  d AS (SELECT a.conv_id, a.turn, b.turn AS other, a.i - b.i AS shift, a.i, a.i - row_number() OVER (PARTITION BY a.conv_id, a.turn, b.turn, a.i - b.i ORDER BY a.i) AS run
    FROM pl a JOIN pl b ON a.conv_id = b.conv_id AND a.gram = b.gram AND b.turn < a.turn),
  m AS (SELECT conv_id, turn, min(i) AS start, count(*) + {GRAM - 1} AS size FROM d GROUP BY conv_id, turn, other, shift, run),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY size DESC, start) AS r FROM m) WHERE r = 1)"""


@query("QC03_longest_overlap", f"WITH {TURNS}, {_PLACES} SELECT t.conv_id, t.turn, substr(text, start, size) AS overlap FROM best JOIN turns t ON t.conv_id = best.conv_id AND t.turn = best.turn")
def qc03(spark, d):
    return overlaps(turns(spark, d))


FORMULA = "en[a-z]?tion"
_EXEMPT = f"turns AS (SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '{FORMULA}', '·', 'g') AS text FROM conversations)"


@query("QC04_formula_exemption", f"WITH {_EXEMPT}, {_OVERLAP} SELECT * FROM o")
def qc04(spark, d):
    """Verbatim overlap once an allowed formula is taken out of all replies."""
    return repeated(turns(spark, d).withColumn("text", F.regexp_replace("text", FORMULA, "·")))


LABELS = {"first": "the first kind", "second": "the second kind", "third": "the third kind", "fourth": "the fourth kind"}
HINT = "Please answer again in other words."


@query("QC06_retry_hint", f"""WITH {TURNS}, {_PLACES}, w AS (SELECT *, {_CATS} AS cats, last_value(CASE WHEN role = 'assistant' THEN {_CATS} END IGNORE NULLS) OVER
    (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM turns),
  b AS (SELECT w.conv_id, w.turn, CASE WHEN best.turn IS NOT NULL THEN 'do not repeat "' || substr(w.text, start, least(size, 60)) || '"' END AS verbatim, list_sort(list_intersect(cats, coalesce(before, []))) AS same
    FROM w LEFT JOIN best ON best.conv_id = w.conv_id AND best.turn = w.turn WHERE role = 'assistant')
  SELECT conv_id, turn, '{HINT}' || CASE WHEN verbatim IS NULL AND len(same) = 0 THEN '' ELSE ' Bans: ' || concat_ws('; ', verbatim,
    CASE WHEN len(same) > 0 THEN 'do not suggest ' || array_to_string(list_transform(same, lambda x: 'the ' || x || ' kind'), ', ') || ' again' END) || '.' END AS hint FROM b""")
def qc06(spark, d):
    """The correction that a reply's retry gets: a general hint and what this reply must not do again."""
    rows = turns(spark, d).withColumn("cats", T.categories(F.col("text"), CATEGORIES))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.last(F.when(F.col("role") == "assistant", F.col("cats")), ignorenulls=True).over(w)).where("role = 'assistant'")
    rows = rows.join(overlaps(turns(spark, d)), ["conv_id", "turn"], "left")
    names = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    same = F.sort_array(F.array_intersect("cats", F.coalesce("before", F.array().cast("array<string>"))))
    verbatim = F.concat(F.lit('do not repeat "'), F.substring("overlap", 1, 60), F.lit('"'))
    again = F.when(F.size(same) > 0, F.concat(F.lit("do not suggest "), F.array_join(F.transform(same, lambda x: names[x]), ", "), F.lit(" again")))
    bans = F.concat_ws("; ", verbatim, again)
    return rows.select("conv_id", "turn", F.concat(F.lit(HINT), F.when(bans == "", "").otherwise(F.concat(F.lit(" Bans: "), bans, F.lit(".")))).alias("hint"))


KEEP, EVERY = 4, 2


@query("STR03_rolling_window", f"""WITH {TURNS}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM turns)
  SELECT conv_id, turn, greatest(n - {KEEP}, 0) // {EVERY} * {EVERY} AS summary_upto, n - greatest(n - {KEEP}, 0) // {EVERY} * {EVERY} AS held FROM k""")
def str03(spark, d):
    """How many turns of a conversation its summary covers after each turn, and how many are held
    whole: the last KEEP, and up to EVERY - 1 that wait. The stream form keeps them as state."""
    return rolling(turns(spark, d), KEEP, EVERY)


@query("QC07_turn_judge", f"""WITH {TURNS}, p AS (SELECT *, coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS said FROM turns)
  SELECT conv_id, turn, list_filter([CASE WHEN NOT len(text) BETWEEN 25 AND 600 THEN 'length' END, CASE WHEN regexp_matches(text, '^(The|Der|La|Le) ') THEN 'opening' END,
  CASE WHEN regexp_matches(text, '(ant|ist)[.]') THEN 'closed' END, CASE WHEN regexp_matches(said, 'tion') AND NOT regexp_matches(text, 'the|la') THEN 'crisis' END,
  CASE WHEN regexp_matches(said, 'qu') AND NOT regexp_matches(text, 'qu') THEN 'help_topic' END,
  CASE WHEN len(list_filter(range(1, len(text) - 18), lambda i: contains(said, substr(text, i, 20)))) > 0 THEN 'copy' END], lambda x: x IS NOT NULL) AS failed FROM p WHERE role = 'assistant'""")
def qc07(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.coalesce(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w), F.lit(""))
    twenty = lambda x: F.filter(T.shingles(x, 20), lambda g: F.length(g) == 20)
    copied = F.arrays_overlap(twenty(F.col("text")), twenty(F.col("said")))
    tests = {
        "length": ~F.length("text").between(25, 600), "opening": F.col("text").rlike("^(The|Der|La|Le) "), "closed": F.col("text").rlike("(ant|ist)[.]"),
        "crisis": F.col("said").rlike("tion") & ~F.col("text").rlike("the|la"), "help_topic": F.col("said").rlike("qu") & ~F.col("text").rlike("qu"), "copy": copied,
    }
    rows = turns(spark, d).withColumn("said", said).where("role = 'assistant'")
    return rows.select("conv_id", "turn", F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])).alias("failed"))


@query("QC10_smoke", f"""WITH {TURNS} SELECT conv_id, turn, regexp_matches(text, '(ant|ist)[.]') AS closed, regexp_matches(text, 'que ') AND turn <= 1 AS unsupported FROM turns WHERE role = 'assistant'
  AND (regexp_matches(text, '(ant|ist)[.]') OR (regexp_matches(text, 'que ') AND turn <= 1))""")
def qc10(spark, d):
    closed, claim = F.col("text").rlike("(ant|ist)[.]"), F.col("text").rlike("que ") & (F.col("turn") <= 1)
    return turns(spark, d).where((F.col("role") == "assistant") & (closed | claim)).select("conv_id", "turn", closed.alias("closed"), claim.alias("unsupported"))
