"""Near-duplicates where many rows are alike, yet below the limit: no text moves for these."""

import random

import numpy as np
import pytest

from harborlight.operators import curation
from harborlight.plans.catalogue import queries
from harborlight.sources.folders import written


def grams(t):
    return {t[i : i + 4] for i in range(max(1, len(t) - 3))} if t else set()


def later_ones(texts):
    sets = [grams(t) for t in texts]
    return {j for j in range(len(texts)) if sets[j] and any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(j))}


def alike(n, changes, seed):
    rnd = random.Random(seed)
    base, texts = [rnd.choice("abcdefgh") for _ in range(600)], []
    for _ in range(n):
        own = list(base)
        for k in rnd.sample(range(600), changes):
            own[k] = rnd.choice("xyz")
        texts.append("".join(own))
    return texts


@pytest.fixture
def sizes(monkeypatch):
    out = {}

    def counted(df, name, *a):
        df = written(df, name, *a)
        out[name] = max(out.get(name, 0), df.count())
        return df

    monkeypatch.setattr(curation, "written", counted)
    return out


def test_texts_move_only_where_parities_allow_it(spark, sizes):
    texts = alike(120, 24, 5)
    texts += [texts[30][:-3] + "qqq", texts[30], texts[90][3:]]
    got = {r.id for r in curation.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()}
    assert got == later_ones(texts) == {120, 121, 122}
    # all rows are likely partners of each other
    assert sizes["partners"] > 100 and sizes["texts"] <= 10, sizes


def test_merge_moves_no_text_of_rows_below_the_limit(spark, sizes, tmp_path):
    texts = alike(90, 24, 6)
    texts[80] = texts[3][:-2] + "qq"
    spark.createDataFrame([(i, t) for i, t in enumerate(texts[:40])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts[40:])] + [(900, None), (901, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id for r in queries()["DED07_merge"](spark, str(tmp_path)).collect()}
    assert got == {i - 1_000_000 for i in range(40)} | ({*range(50), 900, 901} - {40})
    assert sizes["texts"] <= 10, sizes


@pytest.mark.parametrize("letters", ["abcdefgh", "".join(map(chr, range(0x4E00, 0x4E00 + 400))), "".join(map(chr, range(0x10000, 0x10000 + 70000)))])
def test_codes_stand_for_the_grams(letters):
    """In 32 bits, in 64 bits, and as hashes."""
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(letters) for _ in range(k)) for k in (1, 2, 3, 4, 5, 60, 200)] + [letters, letters[:3], letters[:4] * 9, ""]
    sets, bits, used = curation.gram_codes(texts, 4)
    assert [len(s) for s in sets] == [len(grams(t)) for t in texts] and all((s[1:] > s[:-1]).all() for s in sets)
    for a, t in zip(sets, texts):
        for b, u in zip(sets, texts):
            assert len(np.intersect1d(a, b)) == len(grams(t) & grams(u))
        if bits:
            assert np.array_equal(curation.distinct(curation.numbered(a, bits, used, 4)), curation.gram_numbers(t, 4))


def test_parities_differ_no_more_than_sets_do():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 1 << 12, n)) for n in (1, 30, 60, 70, 500, 900, 3000)]
    places = rnd.permutation(1 << 12)
    level, odds = curation.odd_levels([curation.parity(places[s], 2) for s in sets])
    assert len(set(level)) > 3
    for j in range(len(sets)):
        for i in range(j):
            first, bits = odds[int(min(level[i], level[j]))]
            assert np.bitwise_count(bits[i - first] ^ bits[j - first]).sum() <= len(np.setxor1d(sets[i], sets[j]))


def test_sketches_are_those_of_the_signatures(spark, monkeypatch):
    rnd = random.Random(9)
    rows = spark.createDataFrame([(i, "".join(rnd.choice("abcdefghij é漢") for _ in range(rnd.choice((1, 3, 4, 50, 400))))) for i in range(40)] + [(77, ""), (78, None)], "id long, text string")
    want = {r.id: ([(x % (1 << 61)) >> 29 & 15 for x in r.signature], r.n) for r in curation.signatures(rows).collect()}
    got = {r.id: (np.unpackbits(np.frombuffer(r.low, np.uint8).reshape(4, 16), axis=1), r.n) for r in curation.sketched(rows).collect()}
    assert got.keys() == want.keys()
    for k, (bits, n) in got.items():
        assert ((bits.T * [1, 2, 4, 8]).sum(1).tolist(), n) == want[k]


@pytest.mark.parametrize("likely", [curation.LIKELY, 0.3])
def test_rectangles_find_what_single_pairs_do(likely):
    rnd = np.random.default_rng(7)
    group = np.repeat(np.arange(6), [1, 2, 47, 48, 300, 90])
    n = np.concatenate([np.sort(rnd.integers(50, 400, k)) for k in np.bincount(group)])
    low = rnd.integers(0, 1 << 63, (3, 4, 2)).astype(np.uint64)[rnd.integers(0, 3, len(n))] ^ (rnd.integers(0, 1 << 63, (len(n), 4, 2)) & rnd.integers(0, 1 << 63, (len(n), 4, 2)) & rnd.integers(0, 1 << 63, (len(n), 4, 2)) & rnd.integers(0, 1 << 63, (len(n), 4, 2))).astype(np.uint64)
    want = np.zeros(len(n), bool)
    for q in range(len(n)):
        for p in range(q):
            if group[p] == group[q] and n[p] >= 0.8 * n[q] - 1e-9 and curation.alike(low, np.array([p]), np.array([q]))[0] >= likely * 128:
                want[p] = want[q] = True
    assert 0 < want.sum() < len(n)
    assert np.array_equal(curation.with_partner(group, n, low, 0.8, likely), want)


@pytest.mark.parametrize("asking", [1.0, 0.5, 0.1])
def test_allowed_pairs_are_those_of_all_pairs(asking):
    rnd = np.random.default_rng(12)
    n = np.sort(rnd.integers(60, 300, 400))
    base = rnd.choice(1 << 20, 300, replace=False)
    sets = [np.unique(np.append(base[:k], rnd.integers(0, 1 << 20, rnd.integers(0, 60)))) for k in n]
    sets.sort(key=len)
    n, ids, ask = np.array([len(s) for s in sets]), rnd.permutation(400), rnd.random(400) < asking
    low = rnd.integers(0, 1 << 63, (400, 4, 2)).astype(np.uint64)
    got = [(int(i), int(j)) for x, y, _ in curation.allowed(ids, n, np.zeros(400, int), np.zeros(400, bool), ask, low, [curation.parity(s, 2) for s in sets], 0.8, 0.0) for i, j in zip(x, y)]
    near = [(i, j) for i in range(400) for j in range(400) if ids[i] < ids[j] and ask[j] and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    assert near and len(got) == len(set(got)) and set(near) <= set(got) and all(ask[j] and ids[i] < ids[j] for i, j in got)
