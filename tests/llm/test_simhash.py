"""Operator 13 against all pairs of plainly computed fingerprints."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from harborlight.llm import simhash
from harborlight.llm.common import prepare

SF = "/root/testdata/sf0.001"


def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hs = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_groups(prints, ids):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    names = {}
    for x, i in zip(label, ids):
        names.setdefault(x, []).append(i)
    return [min((i for i in names[x] if i is not None), default=None) for x in label]


def rows_of(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def want(rows):
    prints = [plain_print(t) for _, t in rows]
    return sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, plain_groups(prints, [i for i, _ in rows]))), key=str)


def test_query_on_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = rows_of(simhash.op13(spark, SF))
    assert got == want(docs) and len({c for _, _, c in got}) < len(got)


def test_awkward_rows(spark, monkeypatch):
    prepare(spark)
    rnd = random.Random(3)
    long = " ".join(rnd.choice("abcdefghij") + str(rnd.randrange(50)) for _ in range(900))
    rows = [(7, None), (3, ""), (None, " \n"), (4, "One two"), (5, "one\tTWO"), (5, "one two"), (None, "lonely row here ok"), (None, "lonely row here ok"), (9, long), (8, long + " end"), (6, long[:-9]), (12, "é　日本 b"), (13, "aa " * 2000)]
    df = spark.createDataFrame([(i, t, "p", 1, 2) for i, t in rows], "doc_id long, text string, print string, part int, component int")
    assert rows_of(simhash.simhash_groups(df)) == want(rows)
    assert rows_of(simhash.simhash_groups(df.limit(0))) == []


def test_long_rows_are_counted_in_pieces(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    raw = np.frombuffer((text + "b c" + text).encode(), np.uint8)
    off = np.array([0, len(text), len(text) + 3, len(raw)])
    whole = simhash.fingerprints(raw, off)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    assert (simhash.fingerprints(raw, off) == whole).all()
    assert whole[0] == whole[2] == plain_print(text)


@pytest.mark.parametrize("parts,tile", [(2, 4096), (2, 8), (4, 16), (8, 2), (16, 4096)])
def test_links_for_every_number_of_parts(spark, parts, tile):
    prepare(spark)
    rnd = random.Random(parts)
    values = {0, (1 << 64) - 1, 1, 3, 7}
    for _ in range(60):
        v = rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 9)):
            values.add(v)
            v ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice((1, 2, 3))))
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "print long")
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, parts=parts, tile=tile).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    place = {v: k for k, v in enumerate(values)}
    label = list(range(len(values)))
    for a, b in edges:
        x, y = label[place[a]], label[place[b]]
        label = [x if z == y else z for z in label]
    name = [min(v for v, x in zip(values, label) if x == y) for y in label]
    assert name == plain_groups(values, values)


def test_far_tiles_are_never_made(spark):
    """Rows that differ by over the radius in one part's count share no task."""
    prepare(spark)
    df = spark.createDataFrame([(0b111,), (0b11111111,), (-1,)], "print long")
    assert simhash.tile_pairs(df, 2, 2, 8).groupBy("part").agg(F.count_distinct("print").alias("n")).where("n > 1").count() == 0


def test_copies_cost_a_row_each(spark):
    """A group of copies reaches the comparison as one row."""
    prepare(spark)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("all the same words here").alias("text"))
    got = simhash.simhash_groups(df)
    assert got.count() == 3000 and got.where("component_id = 0").count() == 3000
