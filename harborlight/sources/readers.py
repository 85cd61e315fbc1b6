"""Readers of the domain's files: rosters, event logs, text folders, model output blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions.chunks import chunks
from harborlight.sources.batches import small_batches

# fixed values: accepted roster headers
ALIASES = {
    "student_no": ("student_no", "学号"),
    "student_name": ("student_name", "name", "姓名"),
    "grade": ("grade", "年级"),
    "klass": ("klass", "class", "班级"),
}


def roster(rows: DataFrame) -> DataFrame:
    """A roster with known column names: headers by alias, cells trimmed, blank cells null."""
    held = {c.strip().lstrip("﻿").lower(): c for c in rows.columns}
    out = []
    for name, accepted in ALIASES.items():
        found = next((held[a] for a in accepted if a in held), None)
        cell = F.lit(None).cast("string") if found is None else F.nullif(F.btrim(F.col(f"`{found}`").cast("string"), F.lit(" \t\r\n")), F.lit(""))
        if found is None and name in ("student_no", "student_name"):
            raise ValueError(f"the roster has no column for {name}")
        out.append(cell.alias(name))
    return rows.select(*out)


def roster_csv(spark: SparkSession, path: str) -> DataFrame:
    """A UTF-8 roster file, with or without a byte order mark."""
    return roster(spark.read.option("header", True).csv(path))


EVENT = "ts timestamp, caller string, intent string, is_crisis boolean, top1_distance double, top1_passed boolean, results array<struct<source: string, tags: array<string>, distance: double>>, query string, bad string"


def event_log(spark: SparkSession, path: str, callers: tuple[str, ...] = ("intervention", "case"), since: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, bad lines) of JSON lines. Other callers and older events are dropped; a line that
    does not parse is bad, and with `since` so is one without a time."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json(F.regexp_replace("value", "^﻿", ""), EVENT, {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}).alias("e"), "value")
    bad = F.col("e.bad").isNotNull()
    if since:
        bad = bad | F.col("e.ts").isNull()
    good = rows.where(~bad & F.col("e.caller").isin(*callers))
    if since:
        good = good.where(F.col("e.ts") >= F.to_timestamp(F.lit(since)))
    return good.select("e.*").drop("bad"), rows.where(bad).select("value")


def text_folder(spark: SparkSession, path: str) -> DataFrame:
    """source, text of every .txt and .md file."""
    rows = spark.read.option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source"), F.col("value").alias("text"))


def chunked(files: DataFrame, metadata: str, file: str = "file") -> DataFrame:
    """files (`file`, text, more columns) as chunks: id (`file#n`), tag, text and the other columns.

    Lines that match `metadata` leave the text first; the last one is the tag ('' without any).
    """
    small_batches(files.sparkSession)
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    rows = files.withColumn("tag", F.coalesce(F.try_element_at(F.filter(lines, lambda x: x.rlike(metadata)), F.lit(-1)), F.lit("")))
    # exploded where they are made: as a column of their own Spark would cut texts twice, to leave out empty arrays first
    found = chunks(F.array_join(F.filter(lines, lambda x: ~x.rlike(metadata)), "\n"))
    rows = rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(found).alias("n", "text"))
    return rows.withColumn("id", F.concat(F.col(file), F.lit("#"), F.col("n").cast("string"))).drop("n")


def corpus_folder(spark: SparkSession, path: str, metadata: str = "^#{0,6}\\s*(source|来源)[:：].*") -> DataFrame:
    """id, source, tag, text of the chunks of every .txt and .md file under path."""
    files = text_folder(spark, path)
    return chunked(files, metadata, "source").select("id", "source", "tag", "text")


def valid_samples(lines: DataFrame, line: str) -> DataFrame:
    """lines with `sample` (array of from, value) instead of the JSON text in column `line`: legal
    JSON, two turns or more, all of them from human or gpt and with a value."""
    rows = lines.withColumn("sample", F.from_json(line, "array<struct<from: string, value: string>>")).drop(line)
    turn = lambda t: t["from"].isin("human", "gpt") & (F.btrim(F.coalesce(t["value"], F.lit("")), F.lit(" \t\r\n")) != "")
    return rows.where((F.size("sample") >= 2) & F.forall("sample", lambda t: F.coalesce(turn(t), F.lit(False))))


def outer_json(text: Column) -> Column:
    """The text between the first { and the last }, code fences or not."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def block_fields(text: Column, keys: tuple[str, ...]) -> Column:
    """map(key, text up to the next key) of 'key: ...' blocks; missing keys are empty."""
    stop = "|".join(keys)
    pairs = [x for k in keys for x in (F.lit(k), F.btrim(F.regexp_extract(text, rf"(?s)\[{k}\](.*?)(?=\[(?:{stop})\]|$)", 1), F.lit(" \n")))]
    return F.create_map(*pairs)


def sse_blocks(text: Column) -> Column:
    """array(event, data) of a server-sent event stream."""
    blocks = F.filter(F.split(text, "\n\n"), lambda b: F.trim(b) != "")
    return F.transform(blocks, lambda b: F.struct(F.regexp_extract(b, r"(?m)^event: ?(.*)$", 1).alias("event"), F.regexp_extract(b, r"(?m)^data: ?(.*)$", 1).alias("data")))
