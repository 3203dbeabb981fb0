"""Weighted percentiles: the reference's golden cases plus zero weights."""

import pytest

from schedlens.operators.percentile import weighted_percentiles

CASES = [
    ([(42, 100)], {0.0: 42, 0.3: 42, 0.5: 42, 1.0: 42}),
    ([(42, 100), (43, 50), (41, 50)], {0.0: 41, 0.2: 41, 0.5: 42, 0.6: 42, 1.0: 43}),
    ([(0, 25), (2, 50), (5, 100)], {0.0: 0, 0.1: 0, 0.25: 2, 0.5: 5, 1.0: 5}),
    ([(0, 25), (2, 50)], {0.0: 0, 0.25: 0, 0.4: 2, 1.0: 2}),
    # zero weights: leading ones win p = 0 (largest of them); a trailing one wins the end
    ([(1, 0), (3, 0), (5, 10), (9, 0)], {0.0: 3, 0.5: 9, 1.0: 9}),
    ([(1, 0), (2, 0)], {0.0: 2, 1.0: 2}),
]


@pytest.mark.parametrize("rows,expected", CASES)
def test_weighted_percentile(spark, rows, expected):
    df = spark.createDataFrame([(1, float(v), w) for v, w in rows], "g int, v double, w long")
    ps = list(expected)
    out = weighted_percentiles(df, ["g"], ps).collect()
    got = {r.p: r.value for r in out}
    assert got == {p: float(v) for p, v in expected.items()}


def test_unit_weights_is_percentile_disc(spark):
    vals = [7.0, 1.0, 4.0, 4.0, 9.0, 2.0, 8.0]
    df = spark.createDataFrame([(1, v, 1) for v in vals], "g int, v double, w long")
    ps = [0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r.p: r.value for r in weighted_percentiles(df, ["g"], ps).collect()}
    disc = spark.sql(
        "SELECT percentile_disc(array(0.01, 0.25, 0.5, 0.75, 0.99, 1.0)) WITHIN GROUP (ORDER BY v) AS a "
        "FROM VALUES " + ", ".join(f"({v})" for v in vals) + " t(v)").collect()[0].a
    assert [got[p] for p in ps] == disc


def test_chunked_running_weight_matches_brute_force(spark):
    """Values spread over many chunks, negatives, zeros and zero weights: the
    split plan equals a direct statement of the rule."""
    import random

    rnd = random.Random(3)
    rows = []
    for g in range(3):
        for _ in range(400):
            v = rnd.choice([0.0, -rnd.random() * 5, rnd.random() * 100, rnd.random() / 1000, 2.5])
            rows.append((g, v, rnd.choice([0, 1, 5, 100])))
    ps = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g int, v double, w long")
    got = {(r.g, r.p): r.value for r in weighted_percentiles(df, ["g"], ps).collect()}
    import numpy as np
    for g in range(3):
        pooled = {}
        for gg, v, w in rows:
            if gg == g:
                pooled[v] = pooled.get(v, 0) + w
        vals = sorted(pooled)
        cws = np.cumsum([pooled[v] for v in vals])
        tw = int(cws[-1])
        for p in ps:
            place = np.float32(tw * p)
            cands = [(int(c), -v) for v, c in zip(vals, cws) if np.float32(c) >= place]
            want = -min(cands)[1] if cands else max(vals)
            assert got[(g, p)] == want, (g, p)


def test_infinities_and_nan_sort_at_the_ends(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, v, 1) for v in (100.0, 1.0, 0.5, inf, nan, -inf, -3.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, v double, w long")
    ps = [i / 8 for i in range(1, 9)]
    got = [r.value for r in sorted(weighted_percentiles(df, ["g"], ps).collect(), key=lambda r: r.pi)]
    assert got[:7] == [-inf, -3.0, 0.0, 0.5, 1.0, 100.0, inf] and got[7] != got[7]


def test_weights_as_long_as_the_sentinel(spark):
    big = 2**63 - 1
    df = spark.createDataFrame([(1, 1.0, big), (1, 2.0, big), (1, 3.0, big)], "g int, v double, w long")
    got = [r.value for r in sorted(weighted_percentiles(df, ["g"], [0.2, 0.5, 0.9]).collect(), key=lambda r: r.pi)]
    assert got == [1.0, 2.0, 3.0]
