"""Null and shared doc_ids in op4 and in the pipeline's anti-joins."""

import random

import pytest

import corpus_pipeline as P
from harborlight.llm import jaccard_join
from harborlight.llm.common import prepare

WORDS = [f"w{i}" for i in range(3000)]
BASE = random.Random(1).sample(WORDS, 100)
OTHER = random.Random(2).sample(WORDS, 100)


def changed(words, *places):
    return " ".join(f"x{i}" if i in places else w for i, w in enumerate(words))


# each changed word costs five shingles: neighbours link (overlap 91 of 101), the ends do not (81 of 111)
LEFT, BRIDGE, RIGHT = changed(BASE, 10, 30), changed(BASE, 30, 50), changed(BASE, 50, 70)


def table(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def groups(spark, rows):
    return sorted(((r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(table(spark, rows)).collect()), key=str)


def stays(stage, spark, rows):
    return sorted(((r.doc_id, r.text) for r in stage(spark, table(spark, rows), "").collect()), key=str)


def test_null_id_bridges_two_documents(spark):
    assert groups(spark, [(1, LEFT), (2, RIGHT)]) == [(1, 1), (2, 2)]
    assert groups(spark, [(1, LEFT), (None, BRIDGE), (2, RIGHT)]) == [(1, 1), (2, 1), (None, 1)]


@pytest.mark.parametrize("seed", range(3))
def test_two_texts_under_one_id(spark, seed):
    other, near = " ".join(OTHER), changed(OTHER, 50)
    rows = [(5, LEFT), (5, other), (6, BRIDGE), (7, near), (8, changed(BASE, 30, 50, 52))]
    random.Random(seed).shuffle(rows)
    assert groups(spark, rows) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 5)]


def test_two_texts_under_one_id_do_not_share_links(spark):
    rows = [(1, LEFT), (2, " ".join(OTHER)), (2, RIGHT), (3, changed(OTHER, 50))]
    assert groups(spark, rows) == [(1, 1), (2, 2), (2, 2), (3, 2)]


def test_null_id_copies_leave_the_pipeline(spark):
    rows = [(1, "a b c"), (None, "a b c"), (None, "d"), (None, "d"), (4, None), (4, ""), (None, "")]
    got = stays(P.drop_copies, spark, rows)
    assert [r for r in got if r[1]] == [(1, "a b c"), (None, "d")] and [r[0] for r in got if not r[1]] == [4]
    near = [(1, LEFT), (None, BRIDGE), (2, RIGHT), (None, " ".join(OTHER)), (None, changed(OTHER, 50)), (None, ""), (None, "")]
    got = stays(P.drop_near_copies, spark, near)
    assert len(got) == 4 and (1, LEFT) in got and got.count((None, "")) == 2
    assert (None, " ".join(OTHER)) in got or (None, changed(OTHER, 50)) in got


def test_a_copy_leaves_the_other_text_of_its_id(spark):
    assert stays(P.drop_copies, spark, [(1, "a"), (1, "b"), (5, "a")]) == [(1, "b"), (5, "a")]
    rows = [(1, LEFT), (2, BRIDGE), (2, " ".join(OTHER))]
    assert stays(P.drop_near_copies, spark, rows) == sorted([(1, LEFT), (2, " ".join(OTHER))], key=str)


@pytest.mark.parametrize("seed", range(2))
def test_every_text_of_a_shared_id_loses_its_repeats(spark, seed):
    """op7: of texts under one doc_id each is a document, in the order of the digests."""
    import hashlib

    from harborlight.llm import repeats

    one, two, three = (" ".join(random.Random(k).sample(WORDS, 60)) for k in range(3))
    rows = [(1, one + " " + two), (1, two + " " + three), (1, three[:150] + one), (2, three), (3, "x" * 99), (3, one[:120]), (1, one + " " + two)]
    random.Random(seed).shuffle(rows)
    order = sorted(set(rows), key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    seen, want = set(), {}
    for i, t in order:
        gone = [False] * len(t)
        for k in range(len(t) - 99):
            if t[k : k + 100] in seen:
                gone[k : k + 100] = [True] * 100
            seen.add(t[k : k + 100])
        want[i, len(t), sum(gone)] = "".join(c for c, g in zip(t, gone) if not g)
    got = [(r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept).decode()) for r in repeats.remove_repeats(table(spark, rows)).collect()]
    assert len(got) == len(rows) and {g[:3]: g[3] for g in got} == want
