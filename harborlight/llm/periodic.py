"""Operator 11: runs of periodic words by divide and conquer (Main and Lorentz).

Words are interned, so equal ids are equal words. A document is halved again and again. A run
that does not lie in one half crosses the midpoint, and then holds a pair of equal words a period
apart beside it: the word before the midpoint and a later one, or the word behind it and an
earlier one. For every such shift of a midpoint the Z-values, how far the words agree with those
a period on to the right and to the left of it, give the run and its whole extent at once. Runs
found under several shifts or midpoints are one interval with the smallest period.

All midpoints of a level, of all documents of a slice, are worked on in step: nearly all shifts
end after a few words. The rest, in documents that do repeat themselves, are extended by blocks of
doubled length that are interned in turn. So a document of n words costs about n log n whatever its
words are.

Defined results: null and empty texts and white space have no words, no runs and an empty
collapsed text; very long texts are one document whole; repeated rows and ties give equal results;
a null doc_id stays null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import documents, slices, whole_text
from harborlight.llm.kernels import IS_SPACE, interned, utf8

#: Least words of a run, and how far shifts are extended word by word.
LEAST, STEPS = 12, 16
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Blocks:
    """Blocks of 1, 2, 4 ... words of one document, interned: agreements of any length in log steps."""

    def __init__(self, code: np.ndarray):
        self.names = [code]
        size = 1
        while 2 * size <= len(code):
            held = self.names[-1]
            pair = held[:-size].astype(np.int64) * (int(held.max()) + 1) + held[size:]
            self.names.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
            size *= 2

    def ahead(self, x: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words from x on equal those `shift` further."""
        out = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.names))):
            name = self.names[k]
            there = x + shift + out
            fits = there < len(name)
            here = np.where(fits, x + out, 0)
            out += (fits & (name[here] == name[np.where(fits, there, 0)])).astype(np.int64) << k
        return out

    def behind(self, x: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """How many words before x equal those `shift` further."""
        out = np.zeros(len(x), np.int64)
        for k in reversed(range(len(self.names))):
            name = self.names[k]
            here = x - out - (1 << k)
            fits = here >= 0
            here = np.where(fits, here, 0)
            out += (fits & (name[here] == name[here + np.where(fits, shift, 0)])).astype(np.int64) << k
        return out


def agree(code: np.ndarray, x: np.ndarray, shift: np.ndarray, low: np.ndarray, high: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words beyond x, in direction `step`, equal those `shift` further, and which shifts
    were still going after STEPS words."""
    out, live = np.zeros(len(x), np.int64), np.arange(len(x))
    for k in range(1, STEPS + 1):
        at = x[live] + k * step
        inside = (at >= low[live]) & (at + shift[live] < high[live])
        live, at = live[inside], at[inside]
        live = live[code[at] == code[at + shift[live]]]
        out[live] = k
    return out, live


def runs_of(code: np.ndarray, edge: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(row, start, length, period) of the runs of every row, by row, start and period.

    code: word ids of all rows; edge: offsets of the rows.
    """
    row = np.flatnonzero(np.diff(edge) >= least)
    low, high = edge[row], edge[row + 1]
    blocks: dict[int, Blocks] = {}
    found: list[tuple[np.ndarray, ...]] = []
    while len(row):
        middle = (low + high) // 2
        size = high - low
        part = np.repeat(np.arange(len(row)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - low, size)
        right = at >= middle[part]
        beside = np.where(right, middle[part] - 1, middle[part])
        equal = np.flatnonzero(code[at] == code[beside])
        x, y, owner = np.minimum(at[equal], beside[equal]), np.maximum(at[equal], beside[equal]), row[part[equal]]
        shift, first, last = y - x, edge[owner], edge[owner + 1]
        after, going = agree(code, x, shift, first, last, 1)
        before, back = agree(code, x, shift, first, last, -1)
        # a shift that ended on both sides is decided; with one that goes on, only a long one is open
        rest = np.union1d(going, back)
        rest = rest[np.argsort(owner[rest], kind="stable")]
        for some in np.split(rest, np.flatnonzero(np.diff(owner[rest])) + 1) if len(rest) else []:
            r = int(owner[some[0]])
            if r not in blocks:
                blocks[r] = Blocks(code[edge[r] : edge[r + 1]])
            after[some] = blocks[r].ahead(x[some] + 1 - edge[r], shift[some])
            before[some] = blocks[r].behind(x[some] - edge[r], shift[some])
        agreed = before + 1 + after
        hit = (agreed >= shift) & (agreed + shift >= least)
        found.append((owner[hit], x[hit] - before[hit], agreed[hit] + shift[hit], shift[hit]))
        low, high, row = np.concatenate((low, middle)), np.concatenate((middle, high)), np.concatenate((row, row))
        long = high - low >= least
        low, high, row = low[long], high[long], row[long]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    owner, start, length, period = map(np.concatenate, zip(*found))
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = owner[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order] - edge[owner[order]], length[order], period[order]


def offsets(count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    return out


def collapsed(raw: np.ndarray, length: np.ndarray, row: np.ndarray, kept: np.ndarray, rows: int) -> pa.Array:
    """The kept words of every row, joined by single spaces. raw: the words' bytes, joined."""
    out = np.full(len(raw) + len(length), 32, np.uint8)
    out[np.arange(len(raw)) + np.repeat(np.arange(len(length)), length)] = raw
    stays = np.repeat(kept, length + 1)
    # no space behind the last kept word of a row
    words = np.flatnonzero(kept)
    last = words[np.append(row[words][1:] != row[words][:-1], True)[: len(words)]]
    stays[offsets(length + 1)[1:][last] - 1] = False
    size = np.bincount(row, weights=kept * (length + 1), minlength=rows).astype(np.int64)
    size[row[last]] -= 1
    return pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets(size)), pa.py_buffer(out[stays])]).cast(pa.large_string()).cast(pa.string())


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """FOUND for every row of docs (doc_id, text): the runs of its words, by start and period, and
    the text without what repeats: of every run only the first period stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                raw, off = utf8(piece.column(1))
                code, row, length, _ = interned(raw, off, lower=False)
                edge = offsets(np.bincount(row, minlength=piece.num_rows))
                owner, start, size, period = runs_of(code.astype(np.int32), edge, least)
                step = np.zeros(len(code) + 1, np.int64)
                np.add.at(step, edge[owner] + start + period, 1)
                np.add.at(step, edge[owner] + start + size, -1)
                kept = np.cumsum(step[:-1]) == 0
                run_at = offsets(np.bincount(owner, minlength=piece.num_rows)).astype(np.int32)
                held = pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in (start, size, period)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(edge)), pa.ListArray.from_arrays(pa.array(run_at), held), collapsed(raw[~IS_SPACE[raw]], length, row, kept, piece.num_rows)],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, FOUND)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as the query asks: in a tenth of the documents, by the hash of doc_id,
    the words from a place on repeat with a period. A null doc_id is never of that tenth."""
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = docs.select("doc_id", "text", h.alias("h"), F.expr("crc32(cast(doc_id AS string)) div 10").alias("g"))
    plain = docs.where(F.coalesce(F.col("h") % 10 != 0, F.lit(True))).select("doc_id", "text")
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    other = docs.where("h % 10 = 0").withColumn("words", words).withColumn("n", F.size("words"))
    other = other.withColumn("a", F.expr("if(n > 0, cast(g % n AS int), 0)")).withColumn("p", F.expr("1 + cast((n - a) div (3 + g % 8) AS int)"))
    repeated = F.expr("transform(sequence(0, n - 1), i -> words[if(i < a, i, a + (i - a) % p)])")
    return plain.unionByName(other.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).alias("text")))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_planted_periods(documents(spark, sf_dir)))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = rows.withColumn("longest", longest).withColumn("length", -F.col("longest.less"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), "length", F.col("longest.period").alias("period"),
        F.expr("(1000 * length) div longest.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
