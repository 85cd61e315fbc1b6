"""Operator 9: licence scan with sparse TF-IDF and inheritance along directories (DataFrame
functions only).

A file's units are its lines, its blocks between blank lines (the first one is its header) and
its whole text. A unit is a sparse vector of its words: (1 + ln count) times the inverse document
frequency over all files, taken in one groupBy for the words of the templates; a word that no
template has weighs like one that no file has. Units are compared by cosine with full licence
texts, notices, titles, statements and SPDX lines. A file whose best unit reaches the template's
floor has that licence; a mere reservation of rights counts only where nothing else does.

Units that no template can match are left out before they are taken apart: by Cauchy-Schwarz, a
cosine is at most the root of the squares that the template has on the words both share (telling).

Licence files speak for their directory and all below it; of several in a directory the most
common licence wins, then the better score, then the name. A file without a licence of its own
takes the one of its nearest ancestor. Directories, few against files, find their ancestor by
joins on path prefixes; files then join their directory, salted, since one may hold a third of
all files.

Defined results: null and empty texts match nothing; very long texts are scanned whole;
repeated rows are scanned alike; a null path is in the empty directory, where nothing is
inherited; equal cosines go to the first name, then the first unit in byte order; empty tables
give no rows; other columns are kept, but for text and those that scan() and inherit() make.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import documents, written
from harborlight.llm.licence_texts import FORMS, TEXTS

THRESHOLD, EXACT, SALTS = 0.6, 0.9, 16
RESERVED = "Proprietary"
#: name, floor of the cosine, text. SPDX lines differ in one word, so they have to match whole.
TEMPLATES = tuple((name, THRESHOLD, text) for name, text in TEXTS) + tuple(
    (name, EXACT, f"SPDX-License-Identifier: {form}")
    for name in sorted({n for n, _ in TEXTS} - {RESERVED})
    for form in (name, *FORMS.get(name, ()))
)


def terms(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


VOCABULARY = tuple(sorted({w for _, _, text in TEMPLATES for w in terms(text)}))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def idf(files: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequency over all files of each word of the templates, and of a word
    that no file has. At most one row a word of VOCABULARY reaches the driver."""
    held = F.array_intersect(words(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, VOCABULARY)))
    # the empty word stands for the file itself
    rows = files.select(F.explode(F.array_append(held, F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    count = {r["w"]: r["n"] for r in rows}
    n = count.get("", 0)
    return {w: math.log((1 + n) / (1 + count.get(w, 0))) + 1 for w in VOCABULARY}, math.log(1 + n) + 1


def vectors(weight: dict[str, float]) -> list[dict[str, float]]:
    """Unit vectors of the templates."""
    out = []
    for _, _, text in TEMPLATES:
        own = terms(text)
        v = {w: (1 + math.log(own.count(w))) * weight[w] for w in own}
        norm = math.sqrt(sum(x * x for x in v.values()))
        out.append({w: x / norm for w, x in v.items()})
    return out


def telling(units: list[dict[str, float]], weight: dict[str, float]) -> list[str]:
    """Words of which every unit that reaches a template's floor has one.

    A template's most common words are left out as long as their squares stay below the floor's:
    a unit that shares no others cannot reach it.
    """
    out = set()
    for (_, floor, _), unit in zip(TEMPLATES, units):
        left, limit = 0.0, (floor - 1e-6) ** 2  # scores are rounded to six digits
        for w in sorted(unit, key=lambda w: (weight[w], w)):
            if left + unit[w] ** 2 < limit:
                left += unit[w] ** 2
            else:
                out.add(w)
    return sorted(out)


def can_match(text: Column, asked: list[str]) -> Column:
    """False where no unit of the text can reach a floor."""
    return F.arrays_overlap(words(text), F.array(*map(F.lit, asked)))


def units_of(text: Column) -> Column:
    lines = F.split(text, "\n")
    blocks = F.split(text, "\n[ \t\r]*\n")
    return F.array_distinct(F.concat(lines, blocks, F.array(text)))


def scan(files: DataFrame) -> DataFrame:
    """files (path, text, more columns) without text, plus first_line and own (score, name, line):
    the best licence unit."""
    spark = files.sparkSession
    weight, other = idf(files)
    units = vectors(weight)
    asked = telling(units, weight)
    text = F.coalesce("text", F.lit(""))
    kept = [c for c in files.columns if c not in ("text", "first_line", "own")]
    # the array of units is made only where the text has a telling word at all
    some = F.when(can_match(text, asked), F.filter(units_of(text), lambda x: can_match(x, asked)))
    row = F.struct(*kept).alias("scan_row") if kept else F.lit(None).alias("scan_row")
    rows = written(files.select(row, F.substring_index(text, "\n", 1).alias("first_line"), some.alias("units"), F.monotonically_increasing_id().alias("scan_id")), "licence-units", "zstd")

    # word, weight, and the templates that have it: at most a row a word of VOCABULARY
    held = {w: [(t, u[w]) for t, u in enumerate(units) if w in u] for w in VOCABULARY}
    table = spark.createDataFrame([(w, weight[w], held[w]) for w in VOCABULARY], "w string, weight double, held array<struct<t: int, u: double>>")
    named = spark.createDataFrame([(t, name, floor, name == RESERVED) for t, (name, floor, _) in enumerate(TEMPLATES)], "t int, name string, floor double, reserved boolean")
    each = rows.where("size(units) > 0").select("scan_id", F.posexplode("units").alias("unit_no", "line"))
    unit = ["scan_id", "unit_no"]
    counts = each.select(*unit, F.explode(words(F.col("line"))).alias("w")).groupBy(*unit, "w").agg(F.count(F.lit(1)).alias("n"))
    weighed = counts.join(F.broadcast(table), "w", "left").withColumn("x", (1 + F.log("n")) * F.coalesce("weight", F.lit(other)))
    norms = weighed.groupBy(*unit).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.select(*unit, "x", F.inline("held")).groupBy(*unit, "t").agg(F.sum(F.col("x") * F.col("u")).alias("dot"))
    scores = dots.join(norms, unit).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).join(F.broadcast(named), "t").where("score >= floor")
    found = scores.groupBy(*unit).agg(F.min(F.struct("reserved", (-F.col("score")).alias("minus"), "name")).alias("m"))
    found = found.join(each, unit).groupBy("scan_id").agg(F.min(F.struct("m.reserved", "m.minus", "m.name", "line")).alias("m"))
    own = F.struct((-F.col("m.minus")).alias("score"), F.col("m.name").alias("name"), F.col("m.line").alias("line"))
    own = found.select("scan_id", own.alias("own"))
    return rows.join(own, "scan_id", "left").select("scan_row.*" if kept else F.lit(None).alias("none"), "first_line", "own")


def directory(path: Column) -> Column:
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


MADE = ("licence", "score", "origin", "from_dir")


def inherit(scanned: DataFrame, speaks: Column, salts: int = SALTS) -> DataFrame:
    """scanned plus licence, score, origin (own, directory or none) and from_dir.

    speaks: whether a file with a licence speaks for its directory.
    """
    kept = [c for c in scanned.columns if c not in MADE]
    speaks = F.coalesce(speaks, F.lit(False)) & F.col("own").isNotNull()
    rows = scanned.select(F.struct(*kept).alias("file"), "own", directory(F.col("path")).alias("dir"), speaks.alias("speaks"), F.pmod(F.xxhash64("path"), F.lit(salts)).cast("int").alias("salt"))
    votes = rows.where("speaks").groupBy("dir", F.col("own.name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("own.score").alias("score"))
    chosen = votes.groupBy("dir").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("minus"), "name")).alias("v"))
    chosen = chosen.where("dir <> ''").select(F.col("dir").alias("from_dir"), F.col("v.name").alias("dir_name"), (-F.col("v.minus")).alias("dir_score"))
    parts = F.split("dir", "/")
    dirs = rows.select("dir").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts))))
    dirs = dirs.withColumn("from_dir", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    near = dirs.join(chosen, "from_dir").groupBy("dir").agg(F.max_by(F.struct("from_dir", "dir_name", "dir_score"), "depth").alias("near"))
    near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.join(near, ["dir", "salt"], "left")
    has = F.col("own").isNotNull()
    return rows.select(
        "file.*",
        F.when(has, F.col("own.name")).otherwise(F.col("near.dir_name")).alias("licence"),
        F.when(has, F.col("own.score")).otherwise(F.col("near.dir_score")).alias("score"),
        F.when(has, "own").when(F.col("near").isNotNull(), "directory").otherwise("none").alias("origin"),
        F.when(~has, F.col("near.from_dir")).alias("from_dir"),
    )


#: documents have no paths: their ids are laid out in directories of three depths, by source.
PATH = "concat_ws('/', source, case when doc_id % 3 > 0 then doc_id div 4096 end, case when doc_id % 3 > 1 then doc_id div 64 % 64 end, doc_id)"


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = documents(spark, sf_dir).select("doc_id", F.expr(PATH).alias("path"), "text")
    scanned = written(scan(files), "scanned")
    # a statement in the first line is a licence file's title here; one further down is a notice
    found = inherit(scanned, F.col("first_line") == F.col("own.line"))
    return found.select("doc_id", "path", F.col("own.name").alias("own_licence"), "licence", "score", "origin", "from_dir")


def sql() -> str:
    """The same scan in DuckDB's SQL, which computes weights and vectors itself from the texts."""
    quoted = ", ".join(f"({i}, '{name}', {floor}::DOUBLE, '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, floor, text) in enumerate(TEMPLATES))
    return f"""
WITH template(t, name, floor, text) AS (VALUES {quoted}),
tw AS (SELECT t, w, count(*) AS n FROM (SELECT t, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM template) GROUP BY ALL),
files AS (SELECT row_number() OVER () AS f, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10))[1] AS first_line,
    concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN doc_id // 4096 END,
      CASE WHEN doc_id % 3 > 1 THEN doc_id // 64 % 64 END, doc_id) AS path FROM documents),
df AS (SELECT w, count(*) AS n FROM (SELECT f, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM files) GROUP BY w),
idf AS (SELECT v.w, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df.n, 0))) + 1 AS x FROM (SELECT DISTINCT w FROM tw) v LEFT JOIN df ON df.w = v.w),
tx AS (SELECT t, tw.w, (1 + ln(tw.n)) * idf.x AS x FROM tw JOIN idf ON idf.w = tw.w),
unit AS (SELECT tx.t, w, x / norm AS x FROM tx JOIN (SELECT t, sqrt(sum(x * x)) AS norm FROM tx GROUP BY t) n ON n.t = tx.t),
lines AS (SELECT f, unnest(list_distinct(list_concat(string_split(text, chr(10)), string_split_regex(text, '\\n[ \\t\\r]*\\n'), [text]))) AS line FROM files),
words AS (SELECT f, line, w, count(*) AS n FROM (SELECT f, line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS w FROM lines) GROUP BY ALL),
vec AS (SELECT f, line, words.w, (1 + ln(n)) * coalesce(idf.x, ln(1 + (SELECT count(*) FROM files)) + 1) AS x FROM words LEFT JOIN idf ON idf.w = words.w),
norm AS (SELECT f, line, sqrt(sum(x * x)) AS norm FROM vec GROUP BY ALL),
dots AS (SELECT v.f, v.line, u.t, sum(v.x * u.x) AS dot FROM vec v JOIN unit u ON u.w = v.w GROUP BY ALL),
scores AS (SELECT d.f, d.line, p.name, round(dot / norm, 6) AS score FROM dots d JOIN norm n ON n.f = d.f AND n.line = d.line JOIN template p ON p.t = d.t WHERE round(dot / norm, 6) >= p.floor),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY name = '{RESERVED}', score DESC, name, line) AS r FROM scores) WHERE r = 1),
rows AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, o.name, o.score, o.line = f.first_line AS speaks
    FROM files f LEFT JOIN own o ON o.f = f.f),
votes AS (SELECT dir, name, count(*) AS n, max(score) AS score FROM rows WHERE speaks AND dir <> '' GROUP BY ALL),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY n DESC, score DESC, name) AS r FROM votes) WHERE r = 1),
near AS (SELECT dir, from_dir, name, score FROM (SELECT d.dir, c.dir AS from_dir, c.name, c.score,
      row_number() OVER (PARTITION BY d.dir ORDER BY length(c.dir) DESC) AS r
    FROM (SELECT DISTINCT dir FROM rows) d JOIN chosen c ON d.dir = c.dir OR starts_with(d.dir, c.dir || '/')) WHERE r = 1)
SELECT r.doc_id, r.path, r.name AS own_licence, coalesce(r.name, n.name) AS licence,
  CASE WHEN r.name IS NOT NULL THEN r.score ELSE n.score END AS score,
  CASE WHEN r.name IS NOT NULL THEN 'own' WHEN n.name IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN r.name IS NULL THEN n.from_dir END AS from_dir
FROM rows r LEFT JOIN near n ON n.dir = r.dir
"""
