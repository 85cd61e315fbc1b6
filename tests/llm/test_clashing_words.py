"""Words and shingles that are made to share hashes stay different documents in op4 and the pipeline."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from harborlight.llm import jaccard_join
from harborlight.llm.common import prepare
from harborlight.llm.kernels import U64

#: A word of 1024 letters that no polynomial modulo 2 ** 64 tells from its complement.
THUE_MORSE = "".join("ab"[i.bit_count() & 1] for i in range(1024))
COMPLEMENT = THUE_MORSE.translate(str.maketrans("ab", "ba"))


def table(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_words_made_to_clash(spark):
    tail = " ".join(f"w{i}" for i in range(40))
    rows = [(1, THUE_MORSE), (2, COMPLEMENT), (3, "other"), (4, f"{THUE_MORSE} {tail}"), (5, f"{COMPLEMENT} {tail}"), (6, " ".join([THUE_MORSE, COMPLEMENT] * 9)), (7, " ".join([COMPLEMENT, THUE_MORSE] * 9 + [COMPLEMENT]))]
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(table(spark, rows)).collect())
    assert got == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6)]
    kept = {r.doc_id for r in P.drop_near_copies(spark, table(spark, rows), "").collect()}
    assert kept == {1, 2, 3, 4, 6}


@pytest.mark.parametrize("same_first", [False, True])
def test_overlap_compares_both_words_of_a_shingle(same_first):
    rnd = random.Random(4)
    plain = [{(rnd.randrange(30 if same_first else 10**6), rnd.randrange(4)) for _ in range(60)} for _ in range(8)]
    if not same_first:
        plain = [{(a, 0) for a, _ in s} for s in plain]
        plain[1] = {(a, 1) for a, _ in plain[0]}
    sets = [np.array(sorted(s), U64).T.copy() for s in plain]
    i, j = np.triu_indices(8, 1)
    assert jaccard_join.overlaps(sets, i, j).tolist() == [len(plain[a] & plain[b]) for a, b in zip(i, j)]


def test_equal_sets_share_a_node_and_others_do_not():
    first, second = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4], U64), np.array([7, 7, 7, 7, 7, 7, 7, 7, 7], U64)
    ids = jaccard_join.node_ids(first, second, np.array([0, 3, 6, 9, 9]))
    assert (ids[0] == ids[1]).all() and (ids[0] != ids[2]).all() and not ids[3].any()
    assert jaccard_join.numbers(ids).to_pylist()[3] == 0 and all(0 <= x < 1 << 126 for x in jaccard_join.numbers(ids).to_pylist())


@pytest.mark.parametrize("hot", [jaccard_join.HOT, 3])
def test_hot_shingles_are_not_gathered(spark, hot):
    """A passage that most documents share is most of their short texts: its shingles are in prefixes."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join(passage[: rnd.choice((12, 20, 30))] + [f"own{i % 40}x{k}" for k in range(rnd.randrange(9))])) for i in range(400)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(table(spark, rows), hot=hot).collect()}
    sets = [{tuple(t.split(" ")[k : k + 5]) for k in range(len(t.split(" ")) - 4)} for _, t in rows]
    label = list(range(400))
    for i in range(400):
        for j in range(i):
            if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == {i: (len(sets[i]), label[i]) for i in range(400)} and len(set(label)) > 3
