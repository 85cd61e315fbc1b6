"""Boundary values of the scales."""

import pytest

from harborlight.operators import scoring as S


def score(spark, f, values):
    rows = spark.createDataFrame([(1, q, v) for q, v in values.items()], "student_no long, qid long, value int")
    return f(rows).first()


@pytest.mark.parametrize("total,severity", [(0, "none"), (4, "none"), (5, "mild"), (9, "mild"), (10, "moderate"), (14, "moderate"), (15, "moderately_severe"), (19, "moderately_severe"), (20, "severe")])
def test_depression_bands(spark, total, severity):
    values = {q: 0 for q in range(1, 10)}
    for q in range(1, 9):
        values[q] = min(3, total - sum(values.values()))
    assert sum(values.values()) == total
    r = score(spark, S.phq, values)
    assert (r.total, r.severity, r.crisis_level) == (total, severity, "safe")


def test_one_item_raises_the_crisis_level(spark):
    assert score(spark, S.phq, {q: int(q == 9) for q in range(1, 10)}).crisis_level == "elevated"


@pytest.mark.parametrize("total,severity", [(24, "none"), (25, "mild"), (50, "mild"), (51, "moderate"), (82, "moderate")])
def test_anxiety_bands(spark, total, severity):
    values = {q: 2 if 2 * q <= total else int(2 * q - 1 == total) for q in range(1, 42)}
    assert score(spark, S.scared, values).severity == severity


def test_reversed_items_and_factors(spark):
    r = score(spark, S.sdq, {q: 0 for q in range(1, 26)})
    assert (r.total, r.conduct, r.peer, r.hyperactivity) == (10, 2, 4, 4)


def test_validity_items_do_not_count(spark):
    r = score(spark, S.mht, {q: int(q in S.MHT_VALIDITY) for q in range(1, 101)})
    assert (r.total, r.validity, r.doubtful, r.severity) == (0, 10, True, "none")
    r = score(spark, S.mht, {q: int(q == 97) for q in range(1, 101)})
    assert r.crisis_level == "elevated"


def test_profile_truncates_and_turns_strengths_round(spark):
    rows = spark.createDataFrame([(1, 1, 2), (1, 2, 0)], "student_no long, qid long, value int")
    a, b = S.profile(rows, {"x": (1, 2), "good": (1, 2)}, 3, inverse=("good",)).orderBy("ordinal").collect()
    assert (a.pct, a.severity, a.level) == (33, "mild", "mid")
    assert (b.pct, b.severity) == (66, "moderate")
