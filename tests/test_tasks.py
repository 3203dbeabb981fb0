"""Event consolidation and marking."""

from schedlens import schemas as S
from schedlens.operators.tasks import consolidate_task_events, mark_tasks

from helpers import event


def test_consolidate_one_kill(spark):
    ev = spark.createDataFrame([event(1000, S.KILL, missing=2)], S.TASK_EVENT)
    (c,) = consolidate_task_events(ev).collect()
    assert c.num_events_by_type == [0, 0, 0, 0, 0, 1, 0, 0, 0]
    assert c.final_event == S.KILL
    assert c.num_missing == 1 and c.num_events == 1
    assert c.last_deschedule_time == 1000
    assert c.first_submit_time is None and c.first_schedule_time is None


def test_consolidate_order_and_quirks(spark):
    rows = [event(5, S.SUBMIT), event(7, S.SCHEDULE), event(9, S.EVICT), event(11, S.SCHEDULE),
            event(15, S.FINISH, missing=0)]
    (c,) = consolidate_task_events(spark.createDataFrame(rows, S.TASK_EVENT)).collect()
    assert c.final_event == S.FINISH
    assert c.first_submit_time == 5 and c.first_schedule_time == 7
    assert c.last_deschedule_time == 9          # first deschedule, as the trace tools store it
    assert c.last_deschedule_time_actual == 15
    assert c.num_missing == 5 and c.num_missing_actual == 1


def test_marking_is_idempotent(spark):
    rows = [event(5, S.SUBMIT), event(7, S.SCHEDULE, idx=1), event(9, S.FAIL)]
    ev = spark.createDataFrame(rows, S.TASK_EVENT)
    once = sorted(map(tuple, mark_tasks(ev).collect()))
    twice = sorted(map(tuple, mark_tasks(mark_tasks(ev)).collect()))
    assert once == twice
    assert all(len(r[3][7]) == 9 for r in once)


def _events(spark, rows):
    """(time, missing_type, type) events of one task, without a tie column."""
    from schedlens import schemas as S
    from schedlens.functions import typed_struct
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "time long, missing_type int, type int")
    info = typed_struct(S.TASK_INFO, {"job": typed_struct(S.JOB_INFO, {"id": F.lit(7)}), "task_index": F.lit(0)})
    return df.select("*", info.alias("info"), F.lit(None).cast(S.MACHINE_INFO).alias("machine_info"))


def test_order_without_a_tie_column(spark):
    """Time, then SCHEDULE last, then the type; a missing type does not matter."""
    from schedlens import schemas as S
    from schedlens.operators.tasks import consolidate_task_events

    def final(*rows):
        return consolidate_task_events(_events(spark, list(rows))).first().final_event

    assert final((5, 1, S.SUBMIT), (5, None, S.FINISH)) == S.FINISH
    assert final((5, None, S.SCHEDULE), (5, None, S.FINISH)) == S.SCHEDULE
    assert final((6, None, S.SUBMIT), (5, None, S.SCHEDULE)) == S.SUBMIT
    assert final((S.LONG_MAX, None, S.KILL), (5, None, S.SCHEDULE)) == S.KILL


def test_consolidation_is_a_hash_aggregate(spark):
    from schedlens.operators.tasks import consolidate_task_events

    plan = consolidate_task_events(_events(spark, [(1, None, 0)]))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
