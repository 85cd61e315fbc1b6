"""Operator 11 against a plain search for runs, on random words and awkward rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from harborlight.llm import periodic
from harborlight.llm.common import prepare

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_runs(w, least=12):
    """All maximal stretches with a period, by period; the smallest period of an interval counts."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in best.items())


def planted(doc_id, w):
    if doc_id is None:
        return w
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    w = planted(doc_id, words(text))
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    start, length, period = longest or (None, None, None)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), start, length, period, longest and 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def rows_of(spark, rows):
    """The query over rows of its own, by way of a table."""
    prepare(spark)
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, runs string, h int")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/periodic-{abs(hash(str(rows)))}"
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r[c] for c in COLUMNS) for r in periodic.op11(spark, folder).collect()), key=str)


@pytest.mark.parametrize("letters,seed", [(1, 0), (2, 1), (2, 2), (3, 3), (30, 4)])
def test_runs_of_random_words(letters, seed):
    rnd = random.Random(seed)
    rows = [[rnd.randrange(letters) for _ in range(rnd.choice((0, 1, 11, 12, 40, 300)))] for _ in range(40)]
    for _ in range(20):  # powers with defects, and powers of powers
        base = [rnd.randrange(letters) for _ in range(rnd.randrange(1, 20))] * rnd.randrange(2, 12)
        if rnd.random() < 0.5:
            base[rnd.randrange(len(base))] = 99
        rows.append(base + [rnd.randrange(letters) for _ in range(5)] + base)
    rows += [[1] * 500 + [2] + [1] * 500, [i & 1 ^ (bin(i).count("1") & 1) for i in range(400)]]
    edge = periodic.offsets(np.array([len(r) for r in rows]))
    got = periodic.runs_of(np.array([x for r in rows for x in r], np.int32), edge)
    want = [(i, *r) for i, row in enumerate(rows) for r in plain_runs(row)]
    assert list(zip(*(c.tolist() for c in got))) == want


def test_long_periodic_document():
    """100000 equal words and a long period twice are quick: no cost in the square of the length."""
    code = np.concatenate([np.zeros(100_000, np.int32), np.tile(np.arange(30_000, dtype=np.int32), 2)])
    got = periodic.runs_of(code, np.array([0, len(code)]))
    assert list(zip(*(c.tolist() for c in got))) == [(0, 0, 100_001, 1), (0, 100_000, 60_000, 30_000)]


def test_awkward_rows(spark):
    rep = "ab Ab  cd\n" * 9
    rows = [(None, rep), (1, None), (2, ""), (3, " \t\n"), (4, rep), (4, rep), (5, "é　ß " * 20), (6, "x " * 11), (7, "x " * 12), (8, "y z " * 3000 + rep)]
    rows += [(i, rep + " ".join(f"w{k % 17}" for k in range(i))) for i in range(20, 60)]
    assert rows_of(spark, rows) == sorted((plain_row(*r) for r in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i)
    assert rows_of(spark, []) == []


def test_query_on_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted((tuple(r[c] for c in COLUMNS) for r in periodic.op11(spark, SF).collect()), key=str)
    assert got == sorted((plain_row(r.doc_id, r.text) for r in docs), key=str)


def test_operator_keeps_spans_and_texts(spark):
    prepare(spark)
    r = periodic.periodic_runs(spark.createDataFrame([(1, "go " + "a b c " * 4 + "end")], "doc_id long, text string")).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (14, [(1, 12, 3)], "go a b c end")
