"""As-of joins on large right sides: right rows by distinct time, hot keys in every strategy."""

import random

import pytest
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.operators import asof as A
from tests.test_asof_split import brute, join, no_coalescing, tables, tasks_used  # noqa: F401


def shared_times(seed):
    """A right side of 40 rows a time, with unset ties and a sentinel time."""
    rnd = random.Random(seed)
    left = [(rnd.randrange(-5, 60), rnd.choice([1, 1, 2, 3, None]), i) for i in range(300)]
    right = [(rnd.randrange(0, 50, 5), rnd.choice([1, 1, 2, None]), f"r{i}", i) for i in range(800)]
    return left, right + [(S.LONG_MAX, 1, "rmax", 10_000)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_shared_times_give_the_definition(spark, direction):
    left, right = shared_times(3)
    a, b = tables(spark, left, right)
    for strategy, kw in (("bucketed", {"cell_rows": 20}), ("window", {"cell_rows": 20}), ("broadcast", {"broadcast_bytes": 20_000})):
        got = sorted((r.id, r.m) for r in join(a, b, strategy, direction, **kw).collect())
        assert got == brute(left, right, direction), strategy


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_unset_and_nested_ties(spark, direction):
    """The whole tie decides, an unset part is the smallest."""
    rows = [(t, 1, n, s) for t in (1, 2) for n in (None, 4, 9) for s in (None, "a", "b")]
    right = spark.createDataFrame(rows, "t long, k int, n int, s string").select("t", "k", F.struct("n", "s").alias("tie"), F.concat_ws("/", F.coalesce(F.col("n").cast("string"), F.lit("-")), F.coalesce("s", F.lit("-"))).alias("y"))
    left = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "t long, k int, id int")
    fewer = A._distinct_times(right.select(F.col("k").alias("__k0"), F.col("t").alias("__t"), F.struct("tie").alias("__o"), F.struct("y").alias("__r")), ["__k0"], direction)
    assert fewer.count() == 2
    best = "9/b" if direction == "backward" else "-/-"
    assert {r["__r"].y for r in fewer.collect()} == {best}
    assert {r.m for r in join(left, right, "broadcast", direction, broadcast_bytes=1).collect()} == {best}


def test_a_right_side_of_few_times_is_broadcast(spark):
    left, right = shared_times(4)
    a, b = tables(spark, left, right)
    for strategy in ("auto", "broadcast"):
        assert "strategy=broadcast" in join(a, b, strategy, broadcast_bytes=20_000)._jdf.queryExecution().optimizedPlan().toString()
    b = b.withColumn("t", F.col("tie").cast("long"))  # a time of its own for every row
    assert "strategy=broadcast" not in join(a, b, "auto", broadcast_bytes=20_000)._jdf.queryExecution().optimizedPlan().toString()


def test_a_hot_key_of_the_window_form_uses_several_tasks(spark, no_coalescing):  # noqa: F811
    a = spark.range(4000, numPartitions=40).select(F.col("id").alias("t"), F.lit(1).alias("k"), F.col("id").cast("int").alias("id"))
    b = spark.createDataFrame([(0, 1, "r", 0)], "t long, k int, y string, tie int")
    df = join(a, b, "window", cell_rows=100)
    used = tasks_used(df)
    assert len(used) == 4 and max(used) < 2000 and df.where("m = 'r'").count() == 4000
