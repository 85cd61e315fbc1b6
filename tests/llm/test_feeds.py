"""Op3 fed twice: copies across feeds, kept bytes read from an earlier feed's file."""

import hashlib

import pytest

from harborlight.llm.common import prepare
from harborlight.llm.exact_dedup import DigestState, exact_dedup, fetched

FIRST = [(1, "a"), (2, "b"), (9, "c"), (3, None), (None, "d")]
SECOND = [(5, "a"), (4, "c"), (6, "new"), (7, "new"), (8, ""), (None, "d"), (10, "alone")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, locator string")


def want(feed, all_):
    out = []
    for i, t in feed:
        own = [j for j, u in all_ if (u or "") == (t or "")]
        keep = max((j for j in own if j is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("in_files", [True, False])
def test_second_feed_counts_the_first(spark, tmp_path, in_files):
    prepare(spark)
    feeds = []
    for k, rows in enumerate((FIRST, SECOND)):
        frame(spark, rows).coalesce(2).write.parquet(f"{tmp_path}/in {k}")
        feeds.append(spark.read.parquet(f"{tmp_path}/in {k}"))
    state = DigestState(spark, f"{tmp_path}/state")
    assert got(exact_dedup(feeds[0], state=state, in_files=in_files)) == want(FIRST, FIRST)
    assert got(exact_dedup(feeds[1], state=state, in_files=in_files)) == want(SECOND, FIRST + SECOND)
    # what stays of "c" lies in the first feed's file
    groups = state.groups()
    c = hashlib.sha256(b"c").hexdigest()
    (kept,) = groups.where(groups.digest == c).collect()
    assert kept.keep_id == 9 and ("in%200" in kept.locator) == in_files
    assert [r.held for r in fetched(groups.where(groups.digest == c)).collect()] == ["c"]


def test_a_feed_without_rows(spark, tmp_path):
    prepare(spark)
    state = DigestState(spark, f"{tmp_path}/state")
    assert got(exact_dedup(frame(spark, []), state=state)) == []
    assert got(exact_dedup(frame(spark, FIRST), state=state)) == want(FIRST, FIRST)
    assert got(exact_dedup(frame(spark, []), state=state)) == []
