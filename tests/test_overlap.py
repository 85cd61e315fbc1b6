"""Longest shared pieces against plain search, in blocks, and on texts that repeat themselves."""

import random
import time

import pytest
from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import overlap


def plain(turns, texts):
    out = []
    for t, x in zip(turns, texts):
        earlier, best = [y for u, y in zip(turns, texts) if u < t], (0, 0)
        for i in range(len(x)):
            n = 0
            while i + n < len(x) and any(x[i : i + n + 1] in y for y in earlier):
                n += 1
            if n > best[1]:
                best = (i, n)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_against_plain_search(seed):
    rnd = random.Random(seed)
    letters = ["ab", "a", "abcdefgh", "aé日🙂"][seed % 4]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.choice((0, 1, 7, 30)))) for _ in range(9)]
    turns = [rnd.randrange(6) for _ in texts]
    got = overlap.longest_earlier(turns, texts)
    want = plain(turns, texts)
    assert [n for _, n in got] == [n for _, n in want]
    assert all(g == w for g, w in zip(got, want) if w[1])


def test_blocks_give_the_same(spark):
    rnd = random.Random(9)
    phrase = "this phrase is said again and again"
    rows = [(c, t, "".join(rnd.choice("abc ") for _ in range(rnd.randrange(60))) + (phrase[rnd.randrange(9) :] if rnd.random() < 0.5 else "")) for c in range(3) for t in range(25)] + [(9, 1, None), (9, 2, "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    whole = sorted(map(tuple, overlap.overlaps(df, 12).collect()))
    assert whole and whole == sorted(map(tuple, overlap.overlaps(df, 12, block=200).collect()))
    for c in range(3):
        own = [(t, x) for k, t, x in rows if k == c]
        want = {t: x[i : i + n] for (t, x), (i, n) in zip(own, plain(*zip(*own))) if n >= 12}
        assert {t: o for k, t, o in whole if k == c} == want
    assert overlap.overlaps(df.limit(0), 12).count() == 0


def test_equal_characters_take_seconds():
    began = time.time()
    got = overlap.longest_earlier([1, 2, 3], ["a" * 100_000, "a" * 100_000, "b" + "a" * 100_000 + "b"])
    assert got == [(0, 0), (0, 100_000), (1, 100_000)] and time.time() - began < 20


def test_shingles_cost_their_width(spark):
    rows = spark.createDataFrame([("abé🙂c",), ("ab",), ("",), (None,)], "t string").select(T.shingles(F.col("t"), 4)).collect()
    assert [r[0] for r in rows] == [["abé🙂", "bé🙂c"], ["ab"], [], []]
    began = time.time()
    long = spark.range(1).select(F.size(T.shingles(F.repeat(F.lit("some words, 0123456789. "), 40_000), 12)).alias("n"))
    assert long.first().n == 24 and time.time() - began < 60
