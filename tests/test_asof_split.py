"""The time-split as-of join: splits at the data's quantiles, bursts, one scan of each side."""

import random
import re

import pytest
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.operators import asof as A


def join(a, b, strategy, direction="backward", **kw):
    return A.asof_join(a, b, left_keys=["k"], right_keys=["k"], left_time=F.col("t"), right_time=F.col("t"), ties=["tie"],
                       direction=direction, strategy=strategy, merge=lambda r: {"m": r.getField("y")}, **kw)


def brute(left, right, direction, through=()):
    out = []
    for t, k, i in left:
        mine = [(rt, tie, y) for rt, rk, y, tie in right if rk == k and k is not None and (rt <= t if direction == "backward" else rt >= t)]
        m = None if not mine or i in through else (max if direction == "backward" else min)(mine)[2]
        out.append((i, m))
    return sorted(out)


def rows(seed):
    """A hot key, a burst at one time, sentinel and negative times, ties, unset keys."""
    rnd = random.Random(seed)
    key = lambda: rnd.choice([1, 1, 1, 2, 3, None])
    time = lambda: rnd.choice([777, 777, rnd.randrange(-50, 1500), rnd.randrange(-50, 1500)])
    left = [(time(), key(), i) for i in range(700)] + [(S.LONG_MAX, 1, 9_999), (S.LONG_MAX, 2, 9_998)]
    right = [(time(), key(), f"r{i}", i) for i in range(300)] + [(S.LONG_MAX, 1, "rmax", 10_000)]
    return left, right


def tables(spark, left, right):
    return (spark.createDataFrame(left, "t long, k int, id int").repartition(8),
            spark.createDataFrame(right, "t long, k int, y string, tie int"))


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("cell_rows", [2, 20, 10**9])
def test_every_split_gives_the_definition(spark, direction, cell_rows):
    left, right = rows(cell_rows % 97)
    a, b = tables(spark, left, right)
    got = sorted((r.id, r.m) for r in join(a, b, "bucketed", direction, cell_rows=cell_rows).collect())
    assert got == brute(left, right, direction)
    through = {i for _, _, i in left if i % 5 == 0}
    got = sorted((r.id, r.m) for r in join(a, b, "bucketed", direction, cell_rows=cell_rows, passthrough=F.col("id") % 5 == 0).collect())
    assert got == brute(left, right, direction, through)


def test_cells_follow_the_splitters(spark):
    df = spark.range(-2, 12).select(F.col("id").alias("t"), F.array(*[F.lit(x).cast("long") for x in (0, 3, 7)]).alias("s"))
    got = {r.t: r.c for r in df.select("t", A._cell(F.col("s"), F.col("t")).alias("c")).collect()}
    want = {t: 2 * sum(x < t for x in (0, 3, 7)) + (t in (0, 3, 7)) for t in range(-2, 12)}
    assert got == want


def tasks_used(df):
    """Rows per task behind the shuffle of the windowed rows."""
    per = df.select(F.spark_partition_id().alias("p"), "m").groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m"))
    return [r.n for r in per.collect()]


@pytest.fixture()
def no_coalescing(spark):
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)


@pytest.mark.parametrize("span", [1, S.TIME_PERIOD // 4])
def test_a_burst_of_one_key_uses_several_tasks(spark, no_coalescing, span):
    """All rows of one key inside one 20-minute period, or at one instant."""
    a = spark.range(4000, numPartitions=40).select((F.lit(1000) + F.pmod(F.col("id") * 7919, F.lit(span))).alias("t"), F.lit(1).alias("k"), F.col("id").cast("int").alias("id"))
    b = spark.createDataFrame([(1000, 1, "r", 0)], "t long, k int, y string, tie int")
    df = join(a, b, "bucketed", cell_rows=100)
    used = tasks_used(df)
    assert len(used) == 4 and max(used) < 2000
    assert df.where("m = 'r'").count() == 4000
    assert len(tasks_used(join(a, b, "window"))) == 1


@pytest.mark.parametrize("strategy", ["window", "bucketed"])
def test_unset_keys_and_passed_rows_are_spread(spark, no_coalescing, strategy):
    a = spark.range(4000, numPartitions=40).select(F.col("id").alias("t"), F.when(F.col("id") < 2000, F.lit(-1)).alias("k"), F.col("id").cast("int").alias("id"))
    b = spark.createDataFrame([(0, -1, "r", 0)], "t long, k int, y string, tie int")
    df = join(a, b, strategy, passthrough=F.col("k") == -1)
    assert max(tasks_used(df)) < 2000 and df.where("m IS NULL").count() == 4000


def test_scans_and_exchanges(spark, tmp_path):
    left, right = rows(5)
    a, b = tables(spark, left, right)
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    a, b = spark.read.parquet(str(tmp_path / "a")), spark.read.parquet(str(tmp_path / "b"))
    whole = join(a, b, "bucketed", passthrough=F.col("k") == 3)
    executed = plan(whole)[1]
    assert executed.count("FileScan") == 2 and len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", executed)) == 1
    split = plan(join(a, b, "bucketed", cell_rows=20))[1]
    assert len(re.findall(r"FileScan parquet \[[^\]]*id#", split)) == 1  # the left side once, also when keys are split
    assert len(re.findall(r"Exchange hashpartitioning\(k?_*k0", split)) <= 4
