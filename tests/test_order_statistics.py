"""Order statistics against sorted lists: continuous values, heavy ties, small and missing groups."""

import random

import pytest

from harborlight.operators.order_statistics import nth_values


@pytest.mark.parametrize("sorted_rows", [1 << 16, 50, 1])
def test_places_against_sorted_lists(spark, sorted_rows):
    rnd = random.Random(sorted_rows)
    groups = {"continuous": [rnd.gauss(0, 1) for _ in range(3000)], "ties": [float(rnd.choice((1, 1, 1, 2, 7))) for _ in range(2000)], "one": [5.0], "equal": [3.0] * 500, "skewed": [rnd.random() ** 9 for _ in range(700)] + [1e6]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("continuous", None), ("none", None), (None, 1.0)]
    rnd.shuffle(rows)
    places = {"first": "1", "mid": "n div 2 + 1", "p95": "floor(0.95D * n) + 1", "last": "n", "beyond": "n + 1"}
    got = {r.kind: r for r in nth_values(spark.createDataFrame(rows, "kind string, value double"), "kind", "value", places, sorted_rows).collect()}
    for g, vs in groups.items():
        vs, n = sorted(vs), len(vs)
        want = {"first": vs[0], "mid": vs[n // 2], "p95": vs[int(0.95 * n)], "last": vs[-1], "beyond": None}
        assert {k: got[g][k] for k in want} == want and got[g].n == n
    assert "none" not in got and (got[None].n, got[None]["mid"], got[None].beyond) == (1, 1.0, None)
    assert nth_values(spark.createDataFrame([], "kind string, value double"), "kind", "value", places).count() == 0
