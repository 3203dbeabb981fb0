"""Machine cells: one aggregation over usage feeds all machine tables."""

import random

from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.operators import machine

from helpers import resources, struct, task_info


def usage_rows(spark, n=400, odd=False, seed=9):
    """Usage over three days, three machines, some without priority or requests."""
    rng = random.Random(seed)
    value = (lambda: rng.random() * 3) if odd else (lambda: rng.randrange(64) / 16)
    rows = []
    for _ in range(n):
        start = rng.randrange(0, 3 * S.DAY // S.FIVE_MIN, 40) * S.FIVE_MIN + rng.randrange(0, 200) * S.SECOND
        info = task_info(rng.randrange(4), rng.choice([None, 0, 1, 2]), priority=rng.choice([None, 0, 9, 11]),
                         requested_resources=rng.choice([None, resources(value(), value())]))
        rows.append(struct(S.TASK_USAGE, start_time=start, end_time=start + rng.randrange(1, 300) * S.SECOND,
                           resources=resources(value(), rng.choice([None, value()])), task_info=info,
                           machine_info=struct(S.MACHINE_INFO, id=rng.randrange(3), capacity=resources(value(), 1.0))))
    return spark.createDataFrame(rows, S.TASK_USAGE)


def plain(rows, daily):
    """The machine tables by definition."""
    out = {}
    order = lambda r: (r["start_time"], r["end_time"])
    for r in rows:
        b = r["start_time"] % S.DAY // S.FIVE_MIN if daily else r["start_time"] // S.FIVE_MIN
        out.setdefault((r["machine_info"]["id"], b), []).append(r)
    tables = {}
    for key, group in out.items():
        tasks = {}
        for r in sorted(group, key=order):
            tasks[(r["task_info"]["job"]["id"], r["task_info"]["task_index"])] = r
        cpus = sum((r["resources"]["cpus"] or 0) * (r["end_time"] - r["start_time"]) for r in group) / S.FIVE_MIN
        tables[key] = (len(group), min(r["start_time"] for r in group), max(r["end_time"] for r in group), cpus,
                       sum(t["resources"]["memory"] or 0 for t in tasks.values()))
    return tables


def got(df):
    return {(r.machine_id, r.bucket): (r.num_components, r.start_time, r.end_time, r.resources.cpus, r.resources.memory)
            for r in df.collect()}


def test_cells_feed_every_machine_table(spark):
    usage = usage_rows(spark)
    rows = [r.asDict(True) for r in usage.collect()]
    assert len({(r["start_time"], r["end_time"], r["machine_info"]["id"]) for r in rows}) == len(rows)  # no ties
    cells = machine.machine_task_cells(usage)
    assert got(machine.usage_by_machine(usage)) == got(machine.usage_by_machine(cells)) == plain(rows, False)
    assert got(machine.usage_by_machine(usage, daily=True)) == got(machine.usage_by_machine(cells, daily=True)) == plain(rows, True)
    for daily in (False, True):
        a, b = (sorted(map(repr, machine.machine_breakdown(x, daily).collect())) for x in (usage, cells))
        assert a == b


def test_one_aggregation_over_usage(spark, tmp_path):
    """Nothing but the cells reads usage, and no aggregate sorts its input."""
    usage_rows(spark).write.parquet(str(tmp_path / "usage"))
    usage = spark.read.parquet(str(tmp_path / "usage"))
    machine.machine_task_cells(usage).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    for build in (machine.usage_by_machine, machine.machine_breakdown, lambda d: machine.usage_by_machine(d, daily=True)):
        for source in (usage, cells):
            plan = build(source)._jdf.queryExecution().executedPlan().toString()
            assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
            assert ("/usage" in plan) == (source is usage)


def test_empty(spark):
    empty = usage_rows(spark).where(F.lit(False))
    assert machine.usage_by_machine(empty).collect() == [] and machine.machine_breakdown(empty).collect() == []
