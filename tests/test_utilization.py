"""Task and job utilisation: the reference's golden cases."""

import pytest

from schedlens import schemas as S
from schedlens.operators.utilization import job_utilizations, task_utilizations

from helpers import resources, usage


def _tu(spark, rows):
    return task_utilizations(spark.createDataFrame(rows, S.TASK_USAGE)).collect()


def test_missing_request_gives_no_row(spark):
    assert _tu(spark, [usage(0, 10, res=resources(0.5, 0.25), mx=resources(0.75, 0.125))]) == []


def test_one_record(spark):
    (t,) = _tu(spark, [usage(0, 10, res=resources(0.5, 0.25), mx=resources(0.75, 0.125),
                             req=resources(0.25, 0.75))])
    assert (t.min_request.cpus, t.min_request.memory) == (0.25, 0.75)
    assert (t.max_request.cpus, t.max_request.memory) == (0.25, 0.75)
    assert [(r.cpus, r.memory) for r in t.percentile_task_usage] == [(0.75, 0.125)] * 6
    assert [(r.cpus, r.memory) for r in t.percentile_mean_task_usage] == [(0.5, 0.25)] * 6
    assert (t.start_time, t.end_time, t.running_time) == (0, 10, 10)
    assert t.usage_percentile == S.TASK_PERCENTILES


def test_two_records(spark):
    (t,) = _tu(spark, [
        usage(0, 10, res=resources(0.5, 0.25), mx=resources(1.0, 1.0), req=resources(0.25, 0.75), priority=1),
        usage(20, 40, res=resources(0.25, 0.125), mx=resources(2.0, 2.0), req=resources(0.5, 0.25), priority=2),
    ])
    assert (t.min_request.cpus, t.min_request.memory) == (0.25, 0.25)
    assert (t.max_request.cpus, t.max_request.memory) == (0.5, 0.75)
    for p, r in zip(S.TASK_PERCENTILES, t.percentile_task_usage):
        want = 1.0 if p <= 1 / 3 else 2.0
        assert (r.cpus, r.memory) == (want, want)
    for p, r in zip(S.TASK_PERCENTILES, t.percentile_mean_task_usage):
        want = (0.25, 0.125) if p <= 2 / 3 else (0.5, 0.25)
        assert (r.cpus, r.memory) == want
    assert (t.start_time, t.end_time, t.running_time) == (0, 40, 30)
    assert t.info.priority == 1  # the first record's task description


def test_unset_values_count_as_zero(spark):
    (t,) = _tu(spark, [
        usage(0, 10, res=resources(None, 0.5), mx=resources(1.0, 1.0), req=resources(None, 0.5)),
        usage(10, 20, res=resources(0.5, 0.5), mx=resources(1.0, 1.0), req=resources(0.5, 0.5)),
    ])
    assert t.min_request.cpus == 0.0
    assert t.percentile_mean_task_usage[0].cpus == 0.0


def test_job_utilization_one_task(spark):
    tu_schema = S.TASK_UTILIZATION
    info = (tuple([42] + [None] * 6), 10, None, None, None, (0.25, 0.75) + (None,) * 5, None,
            list(range(1, 10)), 1, None, None, None, None, None)
    row = (info, None, (0.25, 0.75) + (None,) * 5, (0.25, 0.75) + (None,) * 5, [0.5, 1.0],
           [(1.0, 0.125) + (None,) * 5, (0.75, 0.125) + (None,) * 5],
           [(0.5, 0.25) + (None,) * 5, (0.5, 0.25) + (None,) * 5], 0, 20, 10)
    (j,) = job_utilizations(spark.createDataFrame([row], tu_schema)).collect()
    assert j.num_tasks == 1
    assert len(j.percentile_task_usage) == 2 * len(S.JOB_PERCENTILES)
    assert [(r.cpus, r.memory) for r in j.percentile_task_usage[:6]] == [(1.0, 0.125)] * 6
    assert [(r.cpus, r.memory) for r in j.percentile_task_usage[6:]] == [(0.75, 0.125)] * 6
    assert [(r.cpus, r.memory) for r in j.percentile_mean_task_usage] == [(0.5, 0.25)] * 12
    assert j.usage_percentile == [0.5] * 6 + [1.0] * 6
    assert j.task_percentile == S.JOB_PERCENTILES * 2
    assert j.num_tasks_final == [0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert j.num_events_by_type == list(range(1, 10))
    assert (j.start_time, j.end_time, j.running_time) == (0, 20, 10)
    assert j.task_samples[0].task_index == 10


def test_sentinel_ends_saturate(spark):
    rows = [usage(i, S.LONG_MAX, res=resources(0.5, 0.25), mx=resources(1.0, 1.0), req=resources(0.25, 0.75)) for i in range(3)]
    rows.append(usage(5, 15, res=resources(float("inf"), 0.0), mx=resources(float("nan"), 0.0), req=resources(0.25, 0.75)))
    (t,) = _tu(spark, rows)
    assert t.running_time == S.LONG_MAX and t.end_time == S.LONG_MAX
    assert t.percentile_task_usage[2].cpus == 1.0 and t.percentile_mean_task_usage[2].cpus == 0.5
    df = task_utilizations(spark.createDataFrame(rows, S.TASK_USAGE))
    (j,) = job_utilizations(df.unionByName(df)).collect()
    assert j.running_time == S.LONG_MAX
