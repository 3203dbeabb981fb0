import math
import random

import pytest
from pyspark.sql import functions as F

from schedlens.functions.exact import exact_sums
from schedlens.operators import machine, series

from test_cells import usage_rows


def values():
    rng = random.Random(4)
    groups = {0: [0.1] * 1000, 1: [1e15, 0.1, -1e15], 2: [1e-30, 1.0, -1.0], 3: [2.0 ** 62, 1.0, -(2.0 ** 62)],
              4: [0.0, -0.0], 5: [1.0, 2.0 ** -53], 6: [1.0, 2.0 ** -53, 2.0 ** -100], 7: [-1.0, -(2.0 ** -53), -(2.0 ** -100)],
              8: [2.0 ** 99] * 50, 9: [3.3, None, -3.3], 10: [-0.7, 0.2]}
    for g in range(20, 60):
        groups[g] = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-12, 16) for _ in range(rng.randrange(1, 80))]
    return groups


def summed(spark, groups, parts):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    random.Random(parts).shuffle(rows)
    df = spark.createDataFrame(rows, "g int, v double").repartition(parts)
    out = exact_sums(df.groupBy("g"), {"total": F.col("v"), "twice": F.col("v") * 2}, F.count("v").alias("n"))
    assert out.columns == ["g", "n", "total", "twice"]
    return {r.g: (r.total, r.twice, r.n) for r in out.collect()}


@pytest.mark.parametrize("parts", [1, 3, 13])
def test_sums_are_the_nearest_double(spark, parts):
    groups = values()
    got = summed(spark, groups, parts)
    for g, vs in groups.items():
        vs = [v for v in vs if v is not None]
        assert got[g] == (math.fsum(vs), math.fsum(2 * v for v in vs), len(vs)), g


def test_values_outside_the_bins_and_none(spark):
    got = summed(spark, {0: [1e300, 1.5], 1: [float("inf"), 1.0], 2: [float("nan"), 1.0], 3: [None], 4: [5e-324, 1.0]}, 2)
    assert got[0][0] == 1e300 + 1.5 and got[1][0] == float("inf") and math.isnan(got[2][0])
    assert got[3][0] is None and got[4][0] == 1.0


def test_machine_and_priority_sums_do_not_depend_on_the_partitions(spark):
    usage = usage_rows(spark, odd=True)
    tables = []
    for parts in (1, 2, 7):
        df = usage.repartition(parts, F.rand(parts))
        tables.append([sorted(map(repr, f(df).collect())) for f in (
            machine.usage_by_machine, machine.machine_breakdown,
            lambda d: machine.usage_by_machine(d, daily=True))])
        rows = df.select(F.struct(*df.columns).alias("usage"), F.lit(None).cast("struct<info:struct<priority:int>>").alias("task"),
                         F.lit(None).cast("struct<info:struct<requested_resources:struct<cpus:double,memory:double>>>").alias("next_death"))
        tables[-1] += [sorted(map(repr, f(rows).collect())) for f in (series.priority_means, series.priority_series)]
    assert tables[0] == tables[1] == tables[2]
