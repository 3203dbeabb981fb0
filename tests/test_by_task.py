"""Tables stored by task: no shuffle between them, whole results, hot and unset keys."""

import pytest
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.operators import enrich, utilization
from schedlens.session import cut, scratch_path
from schedlens.sources import store


def _usage(spark, n=1000, tasks=60):
    from schedlens.functions import typed_struct

    i = F.col("id")
    job = F.when(i % tasks < 3, F.lit(None)).otherwise(i % 7).cast("long")
    info = {"job": typed_struct(S.JOB_INFO, {"id": job}), "task_index": (i % tasks).cast("int"),
            "priority": (i % 12).cast("int"), "num_events": F.lit(1),
            "requested_resources": typed_struct(S.RESOURCES, {"cpus": (i % 9) / 16})}
    rows = spark.range(n).select(
        (i * 300000000).alias("start_time"), (i * 300000000 + 1000000 * (1 + i % 200)).alias("end_time"),
        typed_struct(S.TASK_INFO, info).alias("task_info"),
        typed_struct(S.RESOURCES, {"cpus": (i % 64) / 128, "memory": (i % 32) / 64}).alias("resources"),
        typed_struct(S.RESOURCES, {"cpus": (i % 60) / 128, "memory": (i % 30) / 64}).alias("max_resources"))
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in S.TASK_USAGE if f.name not in rows.columns]
    return rows.select("*", *missing).select(*S.TASK_USAGE.fieldNames(), F.col("start_time").alias("tie"))


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def _stored(spark, df, kind, buckets=8):
    folder = store.write_by_task(df, kind, scratch_path(spark, kind), buckets)
    return folder, store.read_by_task(spark, kind, folder)


def _plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def _rows(df):
    return sorted(map(str, df.select("usage", "task", "job", "tie").collect()))


def test_buckets_meet_without_a_shuffle(spark, no_broadcast):
    usage = _usage(spark)
    utils = cut(utilization.task_utilizations(usage))
    jobs = cut(utilization.job_utilizations(utils))
    u_folder, u = _stored(spark, usage, "task_usage")
    _, t = _stored(spark, utils, "task_utilization")
    assert u.count() == usage.count() and t.count() == utils.count()
    plan = _plan(enrich.combine_usage(u, t))
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("FileScan") == 2
    both = enrich.combine_usage(u, t, jobs)
    assert _plan(both).count("Exchange hashpartitioning") == 3  # tasks and jobs by job, then tasks by task
    left = _plan(both).split("SortMergeJoin", 1)[1].split("FileScan", 1)[0]
    assert "start_time" in left and "Exchange" not in left  # none over usage
    want = _rows(enrich.combine_usage(usage, utils, jobs))
    assert len(want) == 1000 and _rows(both) == want
    # another session knows nothing of the table but its folder
    other = spark.newSession()
    spark.sql(f"DROP TABLE {store._table_name(u_folder)}")
    again = store.read_by_task(other, "task_usage", u_folder)
    assert again.count() == 1000 and again.columns == u.columns


def test_a_hot_task_is_not_put_into_one_bucket(spark, no_broadcast):
    usage = _usage(spark, 600).unionByName(_usage(spark, 3).where("task_info.task_index = 2"))
    spark.conf.set("schedlens.store.taskRows", "9")
    try:
        folder, u = _stored(spark, usage, "task_usage")
    finally:
        spark.conf.unset("schedlens.store.taskRows")
    assert folder.endswith(".by-task-0")
    utils = utilization.task_utilizations(usage)
    _, t = _stored(spark, utils, "task_utilization")
    jobs = utilization.job_utilizations(utils)
    assert _rows(enrich.combine_usage(u, t, jobs)) == _rows(enrich.combine_usage(usage, utils, jobs))


def test_empty_and_unknown(spark):
    folder, u = _stored(spark, _usage(spark).limit(0), "task_usage")
    assert u.count() == 0 and u.columns[:2] == list(store.TASK_KEYS)
    with pytest.raises(ValueError):
        store.read_by_task(spark, "task_usage", folder.rsplit(".by", 1)[0])
