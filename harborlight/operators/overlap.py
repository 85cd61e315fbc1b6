"""Longest pieces that replies share with earlier ones, by suffix and LCP arrays.

The replies of a conversation are joined, each behind a mark of its own, and their suffixes sorted by
doubled prefixes. Of all suffixes of earlier turns the one that agrees longest with a suffix is the
nearest above or the nearest below it in that order; one pass each way over the LCP array
finds both. So a conversation of n characters costs n log n whatever it repeats, and gives
one row a reply.

A conversation of more than `block` characters is dealt to blocks of replies, and each pair of blocks
is a task; a reply's longest piece is the longest of its tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.sources.batches import whole_groups

BLOCK = 1 << 20
#: Marks between replies are numbers above all characters.
MARK = 0x110000


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes in order, and for each k the ranks of all pieces of 2 ** k symbols."""
    ranks = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
    size, n = 1, len(codes)
    while True:
        rank = ranks[-1]
        key = (rank + 1) * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key, kind="stable")
        new = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        ranks.append(rank)
        size *= 2
        if new[-1] == n - 1 or size >= n:
            return order, ranks


def neighbour_lcp(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How far each suffix agrees with the one before it in the order; 0 for the first."""
    n = len(order)
    a, b, out = order[:-1], order[1:], np.zeros(n - 1, np.int64)
    for k in reversed(range(len(ranks))):
        x, y = a + out, b + out
        inside = np.maximum(x, y) < n
        same = inside & (ranks[k][np.where(inside, x, 0)] == ranks[k][np.where(inside, y, 0)])
        out[same] += 1 << k
    return np.append(0, out)


def above(turn: list[int], lcp: list[int]) -> list[int]:
    """For each place, the agreement with the nearest place before it that has a smaller turn."""
    out, turns, least = [], [], []
    for t, m in zip(turn, lcp):
        while turns and turns[-1] >= t:
            turns.pop()
            if (x := least.pop()) < m:
                m = x
        out.append(m if turns else 0)
        turns.append(t)
        least.append(m)
    return out


def longest_earlier(turns: list[int], texts: list[str]) -> list[tuple[int, int]]:
    """(start, size) of the first longest piece of each text that one of an earlier turn has, too."""
    parts = [np.append(np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int64), MARK + i) for i, t in enumerate(texts)]
    if not parts:
        return []
    length = np.array([len(p) for p in parts])
    owner = np.repeat(np.arange(len(parts)), length)
    order, ranks = suffix_order(np.concatenate(parts))
    lcp = neighbour_lcp(order, ranks)
    del ranks
    turn = np.array(turns)[owner[order]].tolist()
    up = above(turn, lcp.tolist())
    down = above(turn[::-1], [0, *lcp[:0:-1].tolist()])[::-1]
    best = np.empty(len(order), np.int64)
    best[order] = np.maximum(up, down)
    first = np.cumsum(length) - length
    most = np.maximum.reduceat(best, first)
    at = np.flatnonzero(best == most[owner])
    _, once = np.unique(owner[at], return_index=True)
    return list(zip((at[once] - first).tolist(), most.tolist()))


def overlaps(replies: DataFrame, least: int, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, overlap: the first longest piece of `least` characters or more that one
    earlier reply (conv_id, turn, text) of the conversation has, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 0):
            part = held.column(0).to_numpy()
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            conv, turn, text = (held.column(k).to_pylist() for k in (1, 2, 3))
            out = []
            for a, b in zip(edge.tolist(), edge[1:].tolist()):
                # another conversation may have the part's hash
                for c in dict.fromkeys(conv[a:b]):
                    rows = [i for i in range(a, b) if conv[i] == c]
                    found = longest_earlier([turn[i] for i in rows], [text[i] for i in rows])
                    out += [(c, turn[i], start, size, text[i][start : start + size]) for i, (start, size) in zip(rows, found) if size >= least]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["conv_id", "turn", "start", "size", "overlap"])

    rows = replies.where(F.length("text") >= least).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    large = rows.groupBy("conv_id").agg(F.ceil(F.sum(F.length("text")) / block).cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(large, "conv_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("turn"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.xxhash64("conv_id", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(part.alias("part"), "conv_id", "turn", "text").repartition("part").sortWithinPartitions("part", "conv_id", "turn")
    found = rows.mapInArrow(run, "conv_id long, turn long, start int, size int, overlap string")
    best = F.max_by("overlap", F.struct("size", (-F.col("start")).alias("first")))
    return found.groupBy("conv_id", "turn").agg(best.alias("overlap"))
