"""Structural chunks of texts: blocks between blank lines, joined to pieces and cut to a size.

A section begins at a title line. Its blocks are joined to pieces: a piece takes the next block
while it has under LEAST_PIECE characters. Pieces of more than MOST characters are cut between
sentences in the same way, a longer sentence hard. Every step depends on the length of what is held
so far, so a text is one pass that holds a list, and costs its length; built-in folds would copy
what they hold at every step. The SQL below gives the same rows in DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from harborlight.sources.batches import small_batches

# fixed values: lengths in characters, ends of sentences, and what a title line looks like
LEAST_BLOCK, LEAST_PIECE, MOST, TITLE_MOST = 10, 40, 400, 40
SENTENCE = ".!?;。！？；"
HEADER = re.compile("#{1,6}[ \\t]+")
GAP = re.compile("\\n[ \\t\\r\\f\\n]*\\n")
BLANKS = " \t\r\f\n"
#: Texts whose parts are Python strings at once.
SLICE = 50
#: Characters that texts lose first; the SQL uses them as marks.
MARKS = str.maketrans("", "", "\x01\x02\x03")


def parts_of(piece: str) -> list[str]:
    """Parts of at most MOST characters, cut behind sentences; a longer sentence is cut hard."""
    if len(piece) <= MOST:
        return [piece]
    out = [""]
    for sentence in filter(None, re.split(f"(?<=[{SENTENCE}])", piece)):
        if out[-1] and len(out[-1]) + len(sentence) > MOST:
            out.append("")
        out[-1] += sentence[:MOST]
        out += [sentence[i : i + MOST] for i in range(MOST, len(sentence), MOST)]
    return out


def pieces_of(text: str) -> list[tuple[str, str]]:
    """(title of the section, piece) in order."""
    out, title, held, size = [], "", [], 0

    def flush() -> None:
        nonlocal held, size
        if held:
            out.append((title, "\n".join(held)))
        held, size = [], 0

    for block in GAP.split(text.translate(MARKS)):
        block = block.strip(BLANKS)
        if head := HEADER.match(block):
            flush()
            title = block[head.end() :].strip(BLANKS)
        elif len(block) >= LEAST_BLOCK:
            if size >= LEAST_PIECE:
                flush()
            size += len(block) + (1 if held else 0)
            held.append(block)
    flush()
    return out


def chunks_of(text: str | None) -> list[str]:
    found = (f"[{title[:TITLE_MOST]}] {part}" if title else part for title, piece in pieces_of(text or "") for part in parts_of(piece))
    return [c for c in found if len(c) >= LEAST_BLOCK]


def split_long(piece: Column) -> Column:
    """array of the parts of a text (null: one empty part)."""
    return listed(lambda x: parts_of((x or "").translate(MARKS)))(piece)


def chunks(text: Column) -> Column:
    """array of chunks: parts of pieces behind their section's title in brackets; short ones go."""
    return listed(chunks_of)(text)


def listed(cut: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    """A column function that cuts each text to a list, inside small Arrow batches: texts become Python
    strings one at a time, and a batch's parts go to Arrow a few texts at a time. A column knows no
    session, so the active one gets the small batches; callers with a table set them for its own."""

    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array([cut(x.as_py()) for x in texts.slice(at, SLICE)], pa.list_(pa.string())) for at in range(0, len(texts), SLICE)]
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.string()))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}  # as objects: Spark reads them
    small_batches(SparkSession.active())
    return F.arrow_udf(run, ArrayType(StringType()))


_TRIM = "' ' || chr(9) || chr(10) || chr(12) || chr(13)"


def _last(text: str, *marks: int) -> str:
    for mark in marks:
        text = f"string_split({text}, chr({mark}))[-1]"
    return text


def split_long_sql(piece: str) -> str:
    cut = f"array_to_string(list_transform(range(0, (length(s) - 1) // {MOST} + 1), lambda i: substr(s, i * {MOST} + 1, {MOST})), chr(1))"
    sentences = f"list_filter(string_split(regexp_replace({piece}, '([{SENTENCE}])', '\\1' || chr(2), 'g'), chr(2)), lambda x: x <> '')"
    last = _last("h", 1)
    fold = f"list_reduce(list_prepend('', {sentences}), lambda h, s: h || CASE WHEN {last} <> '' AND length({last}) + length(s) > {MOST} THEN chr(1) ELSE '' END || {cut})"
    return f"CASE WHEN length({piece}) <= {MOST} THEN [{piece}] ELSE string_split({fold}, chr(1)) END"


def chunks_sql(text: str) -> str:
    """DuckDB's form of chunks(text)."""
    header = "'^#{1,6}[ \\t]+'"
    blocks = f"list_transform(string_split(regexp_replace(translate(coalesce({text}, ''), chr(1) || chr(2) || chr(3), ''), '\\n[ \\t\\r\\f\\n]*\\n', chr(1), 'g'), chr(1)), lambda x: trim(x, {_TRIM}))"
    kept = f"list_filter({blocks}, lambda x: regexp_matches(x, {header}) OR length(x) >= {LEAST_BLOCK})"
    shown = f"list_transform({kept}, lambda x: CASE WHEN regexp_matches(x, {header}) THEN chr(2) || trim(regexp_replace(x, {header}, ''), {_TRIM}) || chr(3) ELSE x END)"
    last = _last("h", 3, 1)
    fold = f"list_reduce(list_prepend(chr(3), {shown}), lambda h, b: h || CASE WHEN starts_with(b, chr(2)) OR {last} = '' THEN '' WHEN length({last}) >= {LEAST_PIECE} THEN chr(1) ELSE chr(10) END || b)"
    front = f"CASE WHEN string_split(x, chr(3))[1] <> '' THEN '[' || substr(string_split(x, chr(3))[1], 1, {TITLE_MOST}) || '] ' ELSE '' END"
    parts = f"flatten(list_transform(list_filter(string_split(string_split(x, chr(3))[-1], chr(1)), lambda p: p <> ''), lambda p: {split_long_sql('p')}))"
    return f"list_filter(flatten(list_transform(string_split({fold}, chr(2)), lambda x: list_transform({parts}, lambda p: {front} || p))), lambda c: length(c) >= {LEAST_BLOCK})"
