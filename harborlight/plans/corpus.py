"""Queries over documents, vectors and labels: curation, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harborlight.operators import curation as C
from harborlight.operators import inverted as I
from harborlight.operators import retrieval as R
from harborlight.functions import chunks as K
from harborlight.functions import text as T
from harborlight.plans.registry import query
from harborlight.sources import readers
from harborlight.sources.batches import small_batches
from harborlight.sources.tables import table


def docs(spark, d):
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


_KEY = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')"


@query("DED01_exact_key", f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def ded01(spark, d):
    # the first id of each key: grouped by a digest, so that no key is shuffled whole and copies are combined first
    key = F.sha2(T.normal_key(F.col("text")), 256)
    return docs(spark, d).groupBy(key.alias("key")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("WIN07_earlier_duplicate", f"SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) > 1 AS duplicate FROM documents")
def win07(spark, d):
    rows = docs(spark, d).select("doc_id", F.sha2(T.normal_key(F.col("text")), 256).alias("key"))
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "key").select("doc_id", (F.col("doc_id") > F.col("first")).alias("duplicate"))


@query("DED02_prefix_report", f"SELECT lang, count(*) AS n, count(*) - count(DISTINCT left({_KEY}, 60)) AS duplicates FROM documents GROUP BY lang")
def ded02(spark, d):
    return docs(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count_distinct(F.substring(T.normal_key(F.col("text")), 1, 60))).alias("duplicates"))


@query("DED03_shingle_sets", """SELECT conv_id, turn, CASE WHEN len(text) >= 4 THEN len(list_distinct(list_transform(range(1, len(text) - 2), lambda i: substr(text, i, 4)))) WHEN len(text) > 0 THEN 1 ELSE 0 END AS n
  FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)""")
def ded03(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(T.shingles(F.coalesce("text", F.lit("")), 4)).cast("long").alias("n"))


_SETS = """t AS (SELECT doc_id AS id, lower(coalesce(text, '')) AS x FROM documents),
  s AS (SELECT id, CASE WHEN len(x) >= 4 THEN list_distinct(list_transform(range(1, len(x) - 2), lambda i: substr(x, i, 4))) ELSE [x] END AS g FROM t WHERE x <> '')"""


@query("DED06_near_duplicates", f"""WITH {_SETS},
  p AS (SELECT b.id, len(a.g) AS na, len(b.g) AS nb, len(list_intersect(a.g, b.g)) AS k FROM s a JOIN s b ON a.id < b.id AND len(a.g) * 10 >= len(b.g) * 8 AND len(b.g) * 10 >= len(a.g) * 8)
  SELECT DISTINCT id FROM p WHERE k >= 0.8::DOUBLE * (na + nb - k)""")
def ded06(spark, d):
    return C.near_duplicates(docs(spark, d).select(F.col("doc_id").alias("id"), F.lower("text").alias("text")))


def _minhash_sql() -> str:
    """The signatures as rows id, k, v: n-grams as numbers, permuted in wide integers."""
    draws = ", ".join(f"({k}, {a}::HUGEINT, {b}::HUGEINT)" for k, (a, b) in enumerate(zip(*C.DRAW.tolist())))
    number = "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(gram, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: h * 2097152 + c)"
    return f"""{_SETS}, u AS (SELECT id, unnest(g) AS gram FROM s), h AS (SELECT gram, {number} % {C.PRIME} AS h FROM (SELECT DISTINCT gram FROM u)),
  d AS (SELECT * FROM (VALUES {draws}) AS t(k, a, b)), p AS (SELECT gram, k, ((a * h + b) % {C.PRIME})::BIGINT AS v FROM h CROSS JOIN d),
  m AS (SELECT id, k, min(v) AS v FROM u JOIN p USING (gram) GROUP BY id, k)"""


@query("DED04_minhash_signature", f"WITH {_minhash_sql()} SELECT id, any_value(len(g)) AS n, list(v ORDER BY k) AS signature FROM m JOIN s USING (id) GROUP BY id")
def ded04(spark, d):
    """id, n, signature (128 minima) of every text with n-grams."""
    return C.signatures(docs(spark, d).select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))).select("id", F.col("n").cast("long").alias("n"), "signature")


@query("DED05_band_candidates", f"""WITH {_minhash_sql()}, b AS (SELECT id, k // {C.ROWS} AS band, list(v ORDER BY k) AS key FROM m GROUP BY ALL),
  f AS (SELECT id, min(id) OVER (PARTITION BY band, key) AS earlier FROM b) SELECT DISTINCT id, earlier FROM f WHERE earlier < id""")
def ded05(spark, d):
    """id, earlier: for every band of a text the first text that has the band, too, if earlier."""
    return C.band_candidates(C.signatures(docs(spark, d).select(F.col("doc_id").alias("id"), F.lower("text").alias("text"))))


def places(rows, group, digest):
    """rows plus place (1 and on, in the order of a hex digest, then doc_id) and n of their group.

    No group is sorted in one task: rows are counted by the digest's first three digits, which
    cut a group into 4096 equal parts, and ranked inside their part behind the parts before.
    """
    rows = rows.withColumn("order_key", digest).withColumn("digits", F.substring(digest, 1, 3))
    counts = rows.groupBy(group, "digits").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(group)
    upto = w.orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "digits", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("before"), F.sum("k").over(w).alias("n"))
    inside = F.row_number().over(Window.partitionBy(group, "digits").orderBy("order_key", "doc_id"))
    return rows.withColumn("inside", inside).join(counts, [group, "digits"]).withColumn("place", F.col("before") + F.col("inside"))


@query("SMP01_stratified_sample", """SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)
  WHERE r <= least(n, greatest(5, round_even(n * 0.1::DOUBLE, 0)))""")
def smp01(spark, d):
    rows = places(docs(spark, d).select("doc_id", "lang"), "lang", F.md5(F.col("doc_id").cast("string")))
    return rows.where(F.col("place") <= F.least(F.col("n"), F.greatest(F.lit(5), F.bround(F.col("n") * F.lit(0.1), 0)))).select("doc_id")


@query("WIN08_quota_fill", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE n_chars > 500) WHERE r <= 7")
def win08(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return docs(spark, d).where("n_chars > 500").select("doc_id", "source", F.row_number().over(w).alias("r")).where("r <= 7").select("doc_id", "source")


@query("WIN09_round_robin", """SELECT doc_id, row_number() OVER (ORDER BY r, source, lang) AS place FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents)
  ORDER BY r, source, lang LIMIT 60""")
def win09(spark, d):
    # 60 rows need at most 60 of a group, which the rank finds before the shuffle
    rows = docs(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("source", "lang").orderBy("doc_id"))).where("r <= 60")
    top = rows.orderBy("r", "source", "lang").limit(60).select("doc_id", "r", "source", "lang")
    return top.select("doc_id", F.row_number().over(Window.orderBy("r", "source", "lang")).alias("place"))


@query("WIN10_best_of_k", "SELECT source, arg_min(doc_id, (n_chars % 7) * 100000 + doc_id) AS best FROM documents GROUP BY source")
def win10(spark, d):
    return docs(spark, d).groupBy("source").agg(F.min_by("doc_id", F.struct(F.expr("n_chars % 7"), "doc_id")).alias("best"))


@query("SRT07_seeded_shuffle", "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def srt07(spark, d):
    return places(docs(spark, d).select("doc_id", "lang"), "lang", F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))).select("doc_id", "place")


@query("SRT06_most_common", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def srt06(spark, d):
    return docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("AGG21_top_reasons", "SELECT split_part(source || ':' || lang, ':', 2) AS reason, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, reason LIMIT 3")
def agg21(spark, d):
    return docs(spark, d).groupBy(F.split_part(F.concat_ws(":", "source", "lang"), F.lit(":"), F.lit(2)).alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(3)


@query("SET01_concatenation", "SELECT 0 AS priority, doc_id AS id FROM documents UNION ALL SELECT 1, item_id FROM benchmark")
def set01(spark, d):
    return docs(spark, d).select(F.lit(0).alias("priority"), F.col("doc_id").alias("id")).unionByName(table(spark, d, "benchmark").select(F.lit(1).alias("priority"), F.col("item_id").alias("id")))


@query("SET02_uncovered", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set02(spark, d):
    return docs(spark, d).select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("JOIN11_not_labelled", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def join11(spark, d):
    return docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("SET05_union_of_kinds", "SELECT lang AS kind FROM documents UNION SELECT role FROM conversations")
def set05(spark, d):
    return docs(spark, d).select(F.col("lang").alias("kind")).union(table(spark, d, "conversations").select("role")).distinct()


@query("AGG18_pass_rate", """WITH l AS (SELECT lang, quality FROM documents LEFT JOIN labels USING (doc_id))
  SELECT lang, count(*) FILTER (quality = 1) AS kept, count(*) FILTER (quality = 0) AS rejected, round(count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IN (0, 1)), 0), 6) AS rate FROM l GROUP BY lang""")
def agg18(spark, d):
    """All kinds, those without any label, too (rate null)."""
    good, bad = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    rows = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang")
    return rows.agg(good.alias("kept"), bad.alias("rejected"), F.round(good / F.nullif(good + bad, F.lit(0)), 6).alias("rate"))


@query("AGG19_length_summary", "WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, min(n_chars) AS low, max(n_chars) FILTER (k = n // 2 + 1) AS middle, max(n_chars) AS high FROM r GROUP BY lang")
def agg19(spark, d):
    # counts by length first: the window runs over lengths, not documents
    counts = docs(spark, d).groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("lang")
    rows = counts.withColumn("upto", F.sum("c").over(w.orderBy("n_chars"))).withColumn("n", F.sum("c").over(w))
    middle = F.expr("upto - c < n div 2 + 1 and n div 2 + 1 <= upto")
    return rows.groupBy("lang").agg(F.min("n_chars").alias("low"), F.max(F.when(middle, F.col("n_chars"))).alias("middle"), F.max("n_chars").alias("high"))


@query("AGG20_score_histogram", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def agg20(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


_GUESS = "CASE WHEN regexp_matches(text, '[$#%&]{3}|!!| [|] ') THEN 0 ELSE 1 END"


@query("AGG13_accuracy", f"SELECT lang, count(*) AS total, count(*) FILTER (({_GUESS}) = quality) AS correct, round_even(count(*) FILTER (({_GUESS}) = quality) / count(*), 4) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def agg13(spark, d):
    guess = F.when(F.col("text").rlike("[$#%&]{3}|!!| [|] "), 0).otherwise(1)
    rows = docs(spark, d).select("doc_id", "lang", guess.alias("guess")).join(table(spark, d, "labels"), "doc_id").groupBy("lang")
    right = F.count_if(F.col("guess") == F.col("quality"))
    return rows.agg(F.count(F.lit(1)).alias("total"), right.alias("correct"), F.bround(right / F.count(F.lit(1)), 4).alias("accuracy"))


_COUNTERS = {
    "label:0": "quality = 0", "label:1": "quality = 1", "bucket:short": "n_chars < 500", "bucket:middle": "n_chars >= 500 and n_chars < 5000", "bucket:long": "n_chars >= 5000",
    "dropped:unlabelled": "quality is null", "dropped:empty": "coalesce(text, '') = ''", "judged": "quality is not null", "agreed": "quality = guess",
}


@query("AGG27_counters", f"""WITH r AS (SELECT d.*, quality, {_GUESS} AS guess FROM documents d LEFT JOIN labels USING (doc_id))
  {" UNION ALL ".join(f"SELECT '{n}' AS counter, (SELECT count(*) FROM r WHERE {c}) AS n, NULL::DOUBLE AS ratio" for n, c in _COUNTERS.items())}
  UNION ALL SELECT 'agreement', (SELECT count(*) FROM r WHERE quality IS NOT NULL), (SELECT round(avg((quality = guess)::INTEGER), 6) FROM r WHERE quality IS NOT NULL)""")
def agg27(spark, d):
    """Label, bucket and drop counters and the judge's agreement, in one pass."""
    guess = F.when(F.col("text").rlike("[$#%&]{3}|!!| [|] "), 0).otherwise(1)
    rows = docs(spark, d).withColumn("guess", guess).join(table(spark, d, "labels"), "doc_id", "left")
    sums = rows.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in _COUNTERS.items()])
    cells = [F.struct(F.lit(n).alias("counter"), F.col(f"`{n}`").alias("n"), F.lit(None).cast("double").alias("ratio")) for n in _COUNTERS]
    ratio = F.struct(F.lit("agreement").alias("counter"), F.col("judged").alias("n"), F.round(F.col("agreed") / F.nullif(F.col("judged"), F.lit(0)), 6).alias("ratio"))
    return sums.select(F.inline(F.array(*cells, ratio)))


@query("WIN11_run_transition", """WITH o AS (SELECT doc_id, quality = 1 AS p FROM labels), n AS (SELECT doc_id, toxic = 0 AS p FROM labels)
  SELECT CASE WHEN NOT o.p AND n.p THEN 'fixed' WHEN o.p AND NOT n.p THEN 'regressed' WHEN o.p THEN 'both_pass' ELSE 'both_fail' END AS change, count(*) AS n FROM o JOIN n USING (doc_id) GROUP BY 1""")
def win11(spark, d):
    rows = table(spark, d, "labels")
    return transitions(rows.selectExpr("doc_id", "quality = 1 as p"), rows.selectExpr("doc_id", "toxic = 0 as p"))


def transitions(old, new):
    """change, n of the cases (doc_id, p) that both runs have."""
    change = F.expr("case when not o and p then 'fixed' when o and not p then 'regressed' when o then 'both_pass' else 'both_fail' end")
    return old.withColumnRenamed("p", "o").join(new, "doc_id").groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


@query("RET02_long_splitter", f"SELECT doc_id, len(parts) AS n, list_transform(parts, lambda p: length(p)) AS sizes FROM (SELECT doc_id, {K.split_long_sql('x')} AS parts FROM (SELECT doc_id, coalesce(translate(text, chr(1) || chr(2) || chr(3), ''), '') AS x FROM documents))")
def ret02(spark, d):
    small_batches(spark)
    parts = K.split_long(F.col("text"))
    return docs(spark, d).select("doc_id", parts.alias("parts")).select("doc_id", F.size("parts").cast("long").alias("n"), F.transform("parts", lambda p: F.length(p).cast("long")).alias("sizes"))


@query("RET01_chunks", f"SELECT doc_id, unnest(range(0, len(c))) AS chunk_no, unnest(c) AS text FROM (SELECT doc_id, {K.chunks_sql('text')} AS c FROM documents)")
def ret01(spark, d):
    small_batches(spark)
    return docs(spark, d).select("doc_id", F.posexplode(K.chunks(F.col("text"))).alias("chunk_no", "text")).withColumn("chunk_no", F.col("chunk_no").cast("long"))


_STRIPPED = "array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT contains(x, 'License')), chr(10))"
_TAG = "coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: contains(x, 'License'))[-1], '')"


@query("SRC03_corpus", f"SELECT source || '/' || doc_id || '#' || unnest(range(0, len(c))) AS id, source, tag, unnest(c) AS text FROM (SELECT doc_id, source, {_TAG} AS tag, {K.chunks_sql(_STRIPPED)} AS c FROM documents)")
def src03(spark, d):
    """Chunks of the corpus with their ids; metadata lines are stripped first and give the tag."""
    return readers.chunked(docs(spark, d).withColumn("file", F.concat_ws("/", "source", F.col("doc_id").cast("string"))), "License", "file").select("id", "source", "tag", "text")


@query("SRC09_chunk_scan", f"SELECT source, tag, count(*) AS chunks, sum(length(text)) AS chars FROM (SELECT source, tag, unnest(c) AS text FROM (SELECT source, {_TAG} AS tag, {K.chunks_sql(_STRIPPED)} AS c FROM documents)) GROUP BY ALL")
def src09(spark, d):
    """Scan of the whole chunk table, as the lexical index reads it."""
    return src03(spark, d).groupBy("source", "tag").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


@query("FLT11_metadata_lines", "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: contains(x, 'License'))[-1] AS tag, len(list_filter(string_split(text, chr(10)), lambda x: NOT contains(x, 'License'))) AS lines FROM documents")
def flt11(spark, d):
    lines = F.split("text", "\n")
    return docs(spark, d).select("doc_id", F.try_element_at(F.filter(lines, lambda x: x.contains("License")), F.lit(-1)).alias("tag"), F.size(F.filter(lines, lambda x: ~x.contains("License"))).cast("long").alias("lines"))


_TERMS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_BM25 = f"""p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
  n AS (SELECT doc_id, sum(tf) AS n_terms FROM p GROUP BY doc_id), g AS (SELECT (SELECT count(*) FROM documents) AS docs, (SELECT sum(n_terms) FROM n) AS all_terms),
  q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  s AS (SELECT query_id, p.doc_id, sum(greatest(ln((docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 0) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n_terms * docs / all_terms))) AS score
    FROM q JOIN p ON q.term = p.term JOIN df ON df.term = p.term JOIN n ON n.doc_id = p.doc_id CROSS JOIN g GROUP BY ALL)"""


def items(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("RET04_bm25_top", f"""WITH {_BM25} SELECT query_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s WHERE score > 0) WHERE r <= 5""")
def ret04(spark, d):
    return I.best(items(spark, d), I.build(docs(spark, d)), 5).select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("SRT04_strong_lexical", f"WITH {_BM25} SELECT query_id, count(*) AS n FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM s) WHERE score >= 0.7::DOUBLE * top - 1e-9 AND score > 0 GROUP BY query_id")
def srt04(spark, d):
    return I.near_best(items(spark, d), I.build(docs(spark, d)), 0.7).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


_NEAR = """v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label AS source, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))) AS distance
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM v)"""


def near(spark, d, k):
    """k nearest other vectors of every query row (id divisible by 20)."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("source"))
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    hits = R.nearest(asked, rows, k + 1).where("query_id <> id").join(rows.select("id", "source"), "id")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@query("RET06_threshold", f"""WITH {_NEAR}, m AS (SELECT 'local' AS model, 1.1::DOUBLE AS threshold UNION ALL SELECT 'cloud', 1.25::DOUBLE)
  SELECT model, query_id, count(*) FILTER (distance <= threshold) AS passed FROM k CROSS JOIN m WHERE rank <= 9 GROUP BY ALL""")
def ret06(spark, d):
    """Hits inside the distance that goes with each embedding model (two, as a literal map)."""
    limits = F.explode(F.create_map(F.lit("local"), F.lit(1.1), F.lit("cloud"), F.lit(1.25))).alias("model", "threshold")
    return near(spark, d, 9).select("query_id", "distance", limits).groupBy("model", "query_id").agg(F.count_if(F.col("distance") <= F.col("threshold")).alias("passed"))


@query("RET05_vector_top_k", f"WITH {_NEAR} SELECT query_id, id, round(distance, 5) AS distance, rank FROM k WHERE rank <= 9")
def ret05(spark, d):
    return near(spark, d, 9).select("query_id", "id", F.round("distance", 5).alias("distance"), "rank")


#: Sources that only queries with a signal word may see, and which queries have one.
TAGGED, SIGNAL = "source = 3", "query_id % 100 = 0"
_POST = f"""{_NEAR}, c AS (SELECT *, CASE WHEN distance > 1.15::DOUBLE THEN 'threshold' WHEN {TAGGED} AND NOT ({SIGNAL}) THEN 'tag' END AS dropped FROM k WHERE rank <= 9),
  f AS (SELECT *, CASE WHEN dropped IS NULL AND row_number() OVER (PARTITION BY query_id, source, dropped ORDER BY distance, id) > 1 THEN 'source' ELSE dropped END AS cause FROM c),
  p AS (SELECT *, count(*) FILTER (cause IS NULL) OVER (PARTITION BY query_id ORDER BY distance, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept FROM f)"""


def filtered(spark, d, k=3):
    """Near hits with the cause for which each is dropped (null: it stays) and how many stayed
    before it; the visit of a query ends with its k-th hit."""
    rows = near(spark, d, 9)
    rows = rows.withColumn("dropped", F.when(F.col("distance") > 1.15, "threshold").when(F.expr(f"{TAGGED} and not ({SIGNAL})"), "tag"))
    again = F.row_number().over(Window.partitionBy("query_id", "source", "dropped").orderBy("distance", "id")) > 1
    rows = rows.withColumn("cause", F.when(F.col("dropped").isNull() & again, "source").otherwise(F.col("dropped")))
    before = Window.partitionBy("query_id").orderBy("distance", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("kept", F.count_if(F.col("cause").isNull()).over(before)).where(F.col("kept") < k)


@query("RET09_post_filter", f"WITH {_POST} SELECT query_id, id, source, kept + 1 AS place FROM p WHERE kept < 3 AND cause IS NULL")
def ret09(spark, d):
    return filtered(spark, d).where("cause is null").select("query_id", "id", "source", (F.col("kept") + 1).alias("place"))


@query("AGG28_zero_hit_causes", f"WITH {_POST} SELECT query_id, count(*) FILTER (cause = 'threshold') AS by_threshold, count(*) FILTER (cause = 'tag') AS by_tag, count(*) FILTER (cause = 'source') AS by_source FROM p WHERE kept < 3 GROUP BY query_id")
def agg28(spark, d):
    causes = {"by_threshold": "threshold", "by_tag": "tag", "by_source": "source"}
    return filtered(spark, d).groupBy("query_id").agg(*[F.count_if(F.col("cause") == c).alias(n) for n, c in causes.items()])


@query("AGG14b_per_file", f"""WITH {_NEAR}, e AS (SELECT vec_id AS query_id, label AS expected FROM embeddings WHERE vec_id % 20 = 0),
  h AS (SELECT e.query_id, expected, coalesce(bool_or(k.source = expected), false) AS hit FROM e LEFT JOIN k ON k.query_id = e.query_id AND rank <= 9 GROUP BY ALL),
  t AS (SELECT expected AS source, count(*) AS total, count(*) FILTER (hit) AS hits FROM h GROUP BY expected)
  SELECT s.source, coalesce(total, 0) AS total, coalesce(hits, 0) AS hits, total IS NOT NULL AS covered FROM (SELECT DISTINCT label AS source FROM embeddings) s LEFT JOIN t ON t.source = s.source""")
def agg14b(spark, d):
    """Totals and hits of every expected source, and the sources that no query expects."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    hits = near(spark, d, 9).groupBy("query_id").agg(F.collect_set("source").alias("found"))
    rows = own.where("query_id % 20 = 0").join(hits, "query_id", "left")
    rows = rows.groupBy("expected").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.array_contains("found", F.col("expected"))).alias("hits"))
    all_sources = own.select(F.col("expected").alias("source")).distinct()
    out = all_sources.join(rows.withColumnRenamed("expected", "source"), "source", "left")
    return out.select("source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("hits", F.lit(0)).alias("hits"), F.col("total").isNotNull().alias("covered"))


@query("AGG14_retrieval_metrics", f"""WITH {_NEAR}, r AS (SELECT e.vec_id AS query_id, min(rank) FILTER (k.source = e.label) AS rank FROM embeddings e JOIN k ON k.query_id = e.vec_id AND rank <= 9 GROUP BY e.vec_id)
  SELECT round_even(avg((coalesce(rank, 99) = 1)::INTEGER), 4) AS hit1, round_even(avg((coalesce(rank, 99) <= 3)::INTEGER), 4) AS recall3, round_even(avg(CASE WHEN rank IS NULL THEN 0 ELSE 1 / rank END), 4) AS mrr FROM r""")
def agg14(spark, d):
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "label")
    rows = near(spark, d, 9).join(own, "query_id").groupBy("query_id").agg(F.min(F.when(F.col("source") == F.col("label"), F.col("rank"))).alias("rank"))
    hit = F.coalesce("rank", F.lit(99))
    return rows.agg(F.bround(F.avg((hit == 1).cast("int")), 4).alias("hit1"), F.bround(F.avg((hit <= 3).cast("int")), 4).alias("recall3"), F.bround(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 4).alias("mrr"))


_FUSED = _BM25.replace("SELECT DISTINCT item_id AS query_id,", "SELECT DISTINCT item_id * 20 AS query_id,")


@query("RET07_fusion", f"""WITH {_NEAR}, {_FUSED}, h AS (SELECT query_id, id, distance, coalesce(contains(text, 'ention'), false) AS boosted FROM k LEFT JOIN documents ON doc_id = id WHERE rank <= 9),
  l AS (SELECT query_id, doc_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s WHERE score > 0),
  st AS (SELECT query_id, id FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM l WHERE r <= 9) WHERE score >= 0.7::DOUBLE * top - 1e-9)
  SELECT coalesce(h.query_id, st.query_id) AS query_id, coalesce(h.id, st.id) AS id,
    round(CASE WHEN h.id IS NULL THEN 1.2::DOUBLE - 0.03::DOUBLE ELSE distance - CASE WHEN st.id IS NOT NULL THEN 0.03::DOUBLE ELSE 0 END - CASE WHEN boosted THEN 0.05::DOUBLE ELSE 0 END END, 5) AS distance,
    CASE WHEN h.id IS NULL THEN 'lexical' WHEN st.id IS NOT NULL THEN 'both' ELSE 'vector' END AS origin FROM h FULL OUTER JOIN st ON h.query_id = st.query_id AND h.id = st.id""")
def ret07(spark, d):
    """Query 20 k has the vector of that id, if there is one, and the text of benchmark item k; the
    lexical side looks through all documents for all items."""
    asked = items(spark, d).withColumn("query_id", F.col("query_id") * 20)
    texts = docs(spark, d).select(F.col("doc_id").alias("id"), F.col("text").contains("ention").alias("boosted"))
    hits = near(spark, d, 9).join(texts, "id", "left").select("query_id", "id", "distance", F.coalesce("boosted", F.lit(False)).alias("boosted"))
    strong = R.strongest(I.best(asked, I.build(docs(spark, d)), 9).drop("place"), 9)
    return R.fuse(hits, strong, 1.2).select("query_id", "id", F.round("distance", 5).alias("distance"), "origin")


@query("WIN05_first_expected_rank", f"WITH {_NEAR} SELECT e.vec_id AS query_id, min(rank) FILTER (k.source IN (e.label, (e.label + 1) % 10)) AS first_rank FROM embeddings e JOIN k ON k.query_id = e.vec_id AND rank <= 9 GROUP BY e.vec_id")
def win05(spark, d):
    """The rank of the first hit whose source is one of the query's two expected ones."""
    own = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.array(F.col("label"), F.expr("(label + 1) % 10")).alias("expected"))
    return near(spark, d, 9).join(own, "query_id").groupBy("query_id").agg(F.min(F.when(F.expr("array_contains(expected, source)"), F.col("rank"))).alias("first_rank"))


@query("RET12_context", f"""WITH {_NEAR} SELECT query_id, string_agg('[' || rank || '] ' || CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '...' ELSE t END, chr(10) ORDER BY rank) AS context
  FROM (SELECT k.*, coalesce(text, '') AS t FROM k LEFT JOIN documents ON doc_id = id WHERE rank <= 3) GROUP BY query_id""")
def ret12(spark, d):
    """The three nearest documents' texts, numbered and clipped."""
    text = F.coalesce("text", F.lit(""))
    clipped = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("..."))).otherwise(text)
    rows = near(spark, d, 3).join(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), "id", "left").select("query_id", "rank", clipped.alias("clip"))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "clip"))).alias("h"))
    return rows.select("query_id", F.array_join(F.transform("h", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["clip"])), "\n").alias("context"))


@query("RET10_trace", f"""WITH {_NEAR}, r AS (SELECT * FROM k WHERE rank <= 3) SELECT query_id, count(*) AS results, round(min(distance), 4) AS top1, min(distance) <= 1.2::DOUBLE AS passed,
  string_agg(source || ':' || id, ',' ORDER BY rank) AS listed FROM r GROUP BY query_id""")
def ret10(spark, d):
    rows = near(spark, d, 3).groupBy("query_id").agg(F.count(F.lit(1)).alias("results"), F.min("distance").alias("low"), F.array_sort(F.collect_list(F.struct("rank", "source", "id"))).alias("h"))
    listed = F.array_join(F.transform("h", lambda x: F.concat(x["source"].cast("string"), F.lit(":"), x["id"].cast("string"))), ",")
    return rows.select("query_id", "results", F.round("low", 4).alias("top1"), (F.col("low") <= 1.2).alias("passed"), listed.alias("listed"))


@query("SRT05_adjusted_order", f"""WITH {_NEAR}, a AS (SELECT query_id, id, rank, distance - CASE WHEN id % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END AS adjusted FROM k WHERE rank <= 9)
  SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY adjusted, rank) AS place FROM a""")
def srt05(spark, d):
    rows = near(spark, d, 9).withColumn("adjusted", F.col("distance") - F.when(F.col("id") % 3 == 0, 0.05).otherwise(0.0))
    return rows.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("adjusted", "rank")).alias("place"))
