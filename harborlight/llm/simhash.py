"""Operator 13: SimHash near-duplicates by tiled exact comparison.

A fingerprint has 64 bits: of the XXH64 values of a document's 3-word shingles, repeats included,
each bit that more than half of them set. Two documents link when their fingerprints differ in at
most RADIUS bits. Equal fingerprints are one row from there on, so copies are never compared.

A tile holds distinct fingerprints with the same population counts in PARTS equal parts. A changed
bit changes one count by one, so two tiles whose counts differ by more than the radius in sum hold
no link, and the pair of them is never made. Every other pair of tiles meets in one task, where
numpy compares all of it by exclusive-or and bit counts. A tile takes at most TILE fingerprints;
classes with more have several tiles. More parts make more and smaller classes: there are as many
parts as keep the comparisons a row about alike while the table grows (`parts_for`), and whatever
their number, the comparison is exact.

A pair of tiles emits a spanning forest of its links, never the pairs.

Defined results: null and empty texts and white space have fingerprint zero, which links like any
other; fewer words than the width make one shingle; very long texts are read whole, in pieces; rows
repeated with one doc_id keep a row each; a null doc_id links like any other but never names a
group unless all its members are null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm.common import discard, documents, slices, whole_groups, whole_text, written
from harborlight.llm.components import components
from harborlight.llm.kernels import IS_SPACE, LOWER, utf8

WIDTH, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a tile at most, about, and shingles that are counted in one numpy pass.
TILE, CHUNK = 4096, 1 << 16
#: Parts that the rows of a repeated fingerprint are dealt to when they get their group's name.
SALTS = 32


def single_spaced(raw: np.ndarray, off: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows, A-Z lower-cased, with one space behind each; row, start, end of each."""
    n = len(raw)
    solid = ~IS_SPACE[raw]
    before = np.append(False, solid[:-1])[:n]
    before[off[:-1][off[:-1] < n]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.append(solid[1:], False)[:n]
    after[off[1:][off[1:] > 0] - 1] = False
    length = np.flatnonzero(solid & ~after) + 1 - start
    end = np.cumsum(length + 1) - 1
    out = np.full(int(length.sum()) + len(length), 32, np.uint8)
    out[np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)] = LOWER[raw[solid]]
    return out.tobytes(), np.searchsorted(off, start, side="right") - 1, end - length, end


def fingerprints(raw: np.ndarray, off: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """One unsigned 64-bit fingerprint a row."""
    from xxhash import xxh64_intdigest

    rows = len(off) - 1
    text, row, start, end = single_spaced(raw, off)
    words = np.bincount(row, minlength=rows)
    first = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    owner = np.repeat(np.arange(rows), count)
    head = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    tail = np.minimum(head + width, first[owner] + words[owner]) - 1
    a, b = start[head], end[tail]
    ones = np.zeros((rows, 64), np.int64)
    for i in range(0, len(owner), CHUNK):
        part = slice(i, i + CHUNK)
        h = np.array([xxh64_intdigest(text[x:y], SEED) for x, y in zip(a[part].tolist(), b[part].tolist())], "<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        of = owner[part]
        at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        ones[of[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > count[:, None], axis=1, bitorder="little").view("<u8").ravel()


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = fingerprints(*utf8(piece.column(1)), width)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, print long")


def parts_for(rows: int) -> int:
    """Parts of a fingerprint whose population counts make the classes: about 13, 41, 145 or 545
    neighbours of a class, and an eighth, a sixtieth, a 2700th or two millionths of all pairs."""
    return 2 if rows < 1 << 20 else 4 if rows < 1 << 25 else 8 if rows < 1 << 30 else 16


def population(value: Column, parts: int) -> Column:
    """The counts of set bits in the parts, each in the place of its part in one long."""
    width = 64 // parts
    counts = [F.bit_count(F.shiftrightunsigned(value, k * width).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long") for k in range(parts)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c, k * width) for k, c in enumerate(counts)])


def shifts(parts: int, radius: int) -> list[int]:
    """What to add to a class to get its neighbours: all changes of the counts by at most `radius` in
    sum. A count below zero or above its part's bits borrows or is too large, and no class has it."""
    steps, out = [0], {0}
    for _ in range(radius):
        steps = [s + d * (1 << 64 // parts * k) for s, d, k in product(steps, (1, -1), range(parts))]
        out.update(steps)
    return sorted(out)


def tile_pairs(values: DataFrame, parts: int, radius: int, tile: int) -> DataFrame:
    """print, part, side of every tile pair that a fingerprint takes part in."""
    rows = values.withColumn("class", population(F.col("print"), parts))
    sizes = rows.groupBy("class").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    sizes = written(sizes, "classes")
    near = sizes.withColumn("other", F.explode(F.array(*[F.col("class") + F.lit(s) for s in shifts(parts, radius)])))
    near = near.join(sizes.select(F.col("class").alias("other"), F.col("tiles").alias("others")), "other")
    rows = rows.join(near, "class").withColumn("own", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("there", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, theirs = F.struct(F.col("class").alias("c"), F.col("own").alias("t")), F.struct(F.col("other").alias("c"), F.col("there").alias("t"))
    low, high = F.least(mine, theirs), F.greatest(mine, theirs)
    side = F.when(mine == theirs, 2).when(mine == low, 0).otherwise(1).cast("int")
    return rows.select("print", F.xxhash64(low, high).alias("part"), side.alias("side"))


def close(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of x and y that differ in at most `radius` bits, in strips."""
    left, right = [], []
    strip = max(1, (1 << 20) // max(1, len(y)))
    for k in range(0, len(x), strip):
        i, j = np.nonzero(np.bitwise_count(x[k : k + strip, None] ^ y[None, :]) <= radius)
        left.append(i + k)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most n - 1 pairs that connect what the pairs (i, j) of n rows connect."""
    label = np.arange(n)
    while len(i):
        np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
        while (label != label[label]).any():
            label = label[label]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    child = np.flatnonzero(label != np.arange(n))
    return label[child], child


def links(values: DataFrame, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """Edges a, b that span the groups of distinct fingerprints (column print) within the radius."""
    parts = parts or parts_for(values.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, 0):
            part, side = held.column(0).to_numpy(), held.column(1).to_numpy()
            value = held.column(2).to_numpy().view(np.uint64)
            edge = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            for a, b in zip(edge, edge[1:]):
                own, cut = value[a:b], a + np.searchsorted(side[a:b], 1)
                if side[b - 1] == 2:  # a tile with itself
                    i, j = close(own, own, radius)
                    i, j = i[i < j], j[i < j]
                elif a < cut < b:
                    i, j = close(value[a:cut], value[cut:b], radius)
                    j = j + cut - a
                else:
                    continue
                if len(i):
                    i, j = forest(len(own), i, j)
                    yield pa.RecordBatch.from_arrays([pa.array(own[i].view(np.int64)), pa.array(own[j].view(np.int64))], ["a", "b"])

    rows = tile_pairs(values, parts, radius, tile).select("part", "side", "print")
    return rows.repartition("part").sortWithinPartitions("part", "side").mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row of docs (doc_id, text)."""
    signed = written(signatures(docs, width), "fingerprints")
    values = written(signed.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "prints")
    edges = written(links(values.select("print"), radius, parts, tile), "links")
    groups = components(edges).withColumnRenamed("node", "print")
    discard(edges)
    grouped = values.join(groups, "print", "left")
    names = grouped.where("component is not null").groupBy("component").agg(F.min("least").alias("name"))
    named = grouped.join(names, "component", "left").select("print", "least", "rows", F.coalesce("name", F.when(F.col("component").isNull(), F.col("least"))).alias("component_id"))
    named = written(named, "named")
    shown = F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint")
    single = named.where("rows = 1").select(F.col("least").alias("doc_id"), shown, "component_id")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    several = named.where("rows > 1").select("print", "component_id", salts)
    dealt = signed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # of a written table: the same when run again
    return single.unionByName(dealt.join(several, ["print", "salt"]).select("doc_id", shown, "component_id"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))
