"""Percentiles of several measures from one shuffle of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.operators import percentile as P
from schedlens.operators import utilization
from schedlens.session import cut
from tests.test_asof_split import plan
from tests.test_by_task import _usage


def measures():
    return {"a": F.col("a"), "b": F.col("b")}


def weighted(spark):
    rnd = random.Random(8)
    value = lambda: rnd.choice([0.0, -0.0, -1.5, 2.0, float("inf"), float("nan"), rnd.random()])
    weight = lambda: rnd.choice([None, 0, 1, 5, 7, S.LONG_MAX])
    rows = [(rnd.choice([1, 1, 1, 2, 3]), i % 2, value(), value(), weight()) for i in range(400)]
    rows += [(9, 0, value(), value(), 0) for _ in range(9)] + [(8, 0, value(), value(), None) for _ in range(9)]
    rows += [(7, i, rnd.random(), rnd.random(), rnd.choice([None, None, 3])) for i in range(60)]
    return spark.createDataFrame(rows, "j long, i int, a double, b double, w long")


@pytest.mark.parametrize("limit", ["1", "60", "500000"])
def test_percentiles_of_several_measures(spark, limit):
    df, ps = weighted(spark), [0.0, 0.25, 0.5, 0.9, 1.0]
    spark.conf.set(P.GROUP_ROWS_CONF, limit)
    try:
        got = P.measure_percentiles(df, ["j", "i"], measures(), F.col("w"), ps).collect()
    finally:
        spark.conf.unset(P.GROUP_ROWS_CONF)
    long = P.unpivot_measures(df, ["j", "i"], measures(), F.col("w"))
    want = {(r.j, r.i, r.measure): [str(r[f"__p{k}"] + 0.0) for k in range(len(ps))]
            for r in P.percentile_columns(long, ["j", "i", "measure"], ps).collect()}
    assert {(r.j, r.i, m): [str(r[f"{m}_{k}"] + 0.0) for k in range(len(ps))] for r in got for m in measures()} == want
    assert len(want) == 16 + 120


def test_percentiles_shuffle_the_rows_once(spark, tmp_path):
    weighted(spark).write.parquet(str(tmp_path / "rows"))
    out = P.measure_percentiles(spark.read.parquet(str(tmp_path / "rows")), ["j", "i"], measures(), F.col("w"), [0.5, 0.9])
    assert plan(out)[1].count("Exchange hashpartitioning") == 1
    usage = spark.read.parquet(cut(_usage(spark)).inputFiles()[0].rsplit("/", 1)[0])
    assert plan(utilization.task_utilizations(usage))[1].count("Generate explode") == 0
