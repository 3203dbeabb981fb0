"""As-of join: the reference's toy cases on every strategy, plus edge cases."""

import pytest
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import saturating_add
from schedlens.operators.asof import asof_join, carry_partition

STRATEGIES = ["window", "bucketed", "broadcast", "auto"]
P = S.TIME_PERIOD

LEFT = [(0, 100, "tooearly"), (1, 100, "A1:"), (2, 100, "A2:"), (3, 101, "nojoin"),
        (4, 102, "A3:"), (5, -1, "through")]
RIGHT = [(1, 100, "B0"), (1, 102, "B1"), (1, -1, "not in output")]
EXPECTED = {"A1:B0", "A2:B0", "A3:B1", "nojoin", "tooearly", "through"}
LEFT_X = [(P + 1, 100, "A4:"), (2 * P + 1, 100, "A5:"), (P + 1, 102, "A6:"), (5 * P + 1, 102, "A7:")]
RIGHT_X = [(P + 1, 102, "B2")]
EXPECTED_X = {"A4:B0", "A5:B0", "A6:B2", "A7:B2"}


def _join(spark, left, right, strategy, **kw):
    a = spark.createDataFrame(left, "t long, k int, x string")
    b = spark.createDataFrame(right, "t long, k int, y string")
    return asof_join(a, b, left_keys=["k"], right_keys=["k"], left_time=F.col("t"), right_time=F.col("t"),
                     merge=lambda r: {"x": F.concat(F.col("x"), r.getField("y"))},
                     passthrough=F.col("k") == -1, strategy=strategy, **kw)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_toy_join(spark, strategy):
    out = {r.x for r in _join(spark, LEFT, RIGHT, strategy).collect()}
    assert out == EXPECTED


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_period_crossing(spark, strategy):
    out = {r.x for r in _join(spark, LEFT + LEFT_X, RIGHT + RIGHT_X, strategy).collect()}
    assert out == EXPECTED | EXPECTED_X


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_empty_right_keeps_left(spark, strategy):
    out = _join(spark, LEFT, [], strategy).collect()
    assert sorted(r.x for r in out) == sorted(x for _, _, x in LEFT)


@pytest.mark.parametrize("strategy", ["window", "bucketed", "broadcast"])
def test_ties_last_wins_backward_first_wins_forward(spark, strategy):
    a = spark.createDataFrame([(10, 1, "L")], "t long, k int, x string")
    b = spark.createDataFrame([(5, 1, "r1", 1), (5, 1, "r2", 2), (20, 1, "f1", 3), (20, 1, "f2", 4)],
                              "t long, k int, y string, tie int")
    common = dict(left_keys=["k"], right_keys=["k"], left_time=F.col("t"), right_time=F.col("t"),
                  ties=["tie"], merge=lambda r: {"m": r.getField("y")}, strategy=strategy)
    assert asof_join(a, b, **common).collect()[0].m == "r2"
    assert asof_join(a, b, direction="forward", **common).collect()[0].m == "f1"


@pytest.mark.parametrize("strategy", ["window", "bucketed", "broadcast"])
def test_forward_inclusive_boundary(spark, strategy):
    a = spark.createDataFrame([(10, 1), (11, 1), (30, 1)], "t long, k int")
    b = spark.createDataFrame([(10, 1, "d10"), (25, 1, "d25")], "t long, k int, y string")
    out = asof_join(a, b, left_keys=["k"], right_keys=["k"], left_time=F.col("t"), right_time=F.col("t"),
                    merge=lambda r: {"m": r.getField("y")}, direction="forward", strategy=strategy)
    assert {(r.t, r.m) for r in out.collect()} == {(10, "d10"), (11, "d25"), (30, None)}


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(10, None)], "t long, k int")
    b = spark.createDataFrame([(1, None, "x")], "t long, k int, y string")
    for strategy in ["window", "bucketed", "broadcast"]:
        out = asof_join(a, b, left_keys=["k"], right_keys=["k"], left_time=F.col("t"), right_time=F.col("t"),
                        merge=lambda r: {"m": r.getField("y")}, strategy=strategy).collect()
        assert out[0].m is None


def test_saturating_add_keeps_sentinel_last(spark):
    df = spark.createDataFrame([(S.LONG_MAX,), (5,)], "t long")
    out = df.select(saturating_add("t", 1_000_000).alias("u")).collect()
    assert sorted(r.u for r in out) == [1_000_005, S.LONG_MAX]


def test_carry_partition(spark):
    df = spark.createDataFrame([(1, 7, "a"), (P + 5, 7, "b"), (3 * P, 8, "c")], "t long, k int, v string")
    out = carry_partition(df, keys=["k"], time=F.col("t"), period=P, max_time=4 * P, ties=["v"])
    rows = {(r.period, r.k, r.v, r.is_carry) for r in out.collect()}
    assert rows == {
        (0, 7, "a", False), (1, 7, "b", False), (3, 8, "c", False),
        (1, 7, "a", True), (2, 7, "b", True), (3, 7, "b", True), (4, 7, "b", True),
        (4, 8, "c", True),
    }


def test_carry_partition_empty(spark):
    df = spark.createDataFrame([], "t long, k int, v string")
    assert carry_partition(df, keys=["k"], time=F.col("t")).count() == 0


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_strategies_agree_on_hot_keys(spark, direction):
    """Many right rows per key (the period-keyed broadcast probe), ties,
    sentinel times and negative times: every strategy gives the same rows."""
    import random

    rnd = random.Random(7)
    right = [(rnd.randrange(-50, 5000) * 1000, rnd.randrange(3), f"r{i}", i) for i in range(600)]
    right += [(S.LONG_MAX, 1, "rmax", 10_000)]
    left = [(rnd.randrange(-100, 5100) * 1000 + rnd.randrange(2) * 500, rnd.randrange(4), i) for i in range(800)]
    left += [(S.LONG_MAX, 1, 9_999), (S.LONG_MAX, 2, 9_998)]
    a = spark.createDataFrame(left, "t long, k int, id int")
    b = spark.createDataFrame(right, "t long, k int, y string, tie int")
    out = {}
    for strategy in ["window", "bucketed", "broadcast"]:
        df = asof_join(a, b, left_keys=["k"], right_keys=["k"], left_time=F.col("t"), right_time=F.col("t"),
                       ties=["tie"], direction=direction, strategy=strategy, period=300_000,
                       merge=lambda r: {"m": r.getField("y")})
        out[strategy] = sorted((r.id, r.m) for r in df.collect())
    assert out["window"] == out["bucketed"] == out["broadcast"]
    assert len(out["window"]) == len(left)


def test_auto_falls_back_above_broadcast_bound(spark):
    """``auto`` and ``broadcast`` broadcast only under a proven byte bound; above
    it the time-split join runs, with the same answer."""
    for strategy in ("auto", "broadcast"):
        for bound, broadcasts in ((1 << 20, True), (100, False)):
            df = _join(spark, LEFT + LEFT_X, RIGHT + RIGHT_X, strategy, broadcast_bytes=bound)
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert ("strategy=broadcast" in plan) is broadcasts
            assert {r.x for r in df.collect()} == EXPECTED | EXPECTED_X


def test_size_check_is_one_small_aggregate(spark):
    from schedlens.operators import asof as A

    b = spark.createDataFrame([(t, k, "y" * 100) for t in range(50) for k in range(3)], "t long, k int, y string")
    R = b.select(F.col("k").alias("__k0"), F.col("t").alias("__t"), F.struct("y").alias("__r"))
    stats = A.right_stats(R, ["__k0"])
    assert (stats.n, stats.n_keys, stats.t_min, stats.t_max) == (150, 3, 0, 49)
    assert stats.n_bytes > 150 * 100
    assert stats.probe_period() == 49 * 3 // 150 or stats.probe_period() == 1


def test_stages_are_stored_under_checkpoint_dir(spark):
    from schedlens.session import cut

    df = spark.createDataFrame([(1, "a")], "k int, v string")
    stored = cut(df, "probe")
    from urllib.parse import urlparse

    paths = [urlparse(p).path for p in stored.inputFiles()]
    base = urlparse(spark.sparkContext.getCheckpointDir()).path.rstrip("/")
    assert paths and all(p.startswith(base + "/") for p in paths)
    assert stored.collect() == df.collect()
