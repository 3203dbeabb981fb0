"""What grows with the trace is shuffled, however small its files make it look: nothing of it is broadcast."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from schedlens.operators import enrich, machine, percentile, utilization
from schedlens.session import cut
from tests.test_asof_split import plan
from tests.test_by_task import _rows, _usage


@pytest.fixture()
def stored(spark):
    """Usage and its summaries, in files far below the broadcast threshold."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") not in ("-1", "0")
    usage = cut(_usage(spark))
    utils = cut(utilization.task_utilizations(usage))
    return usage, utils, cut(utilization.job_utilizations(utils))


def broadcasts(df):
    """Broadcasts planned from the sizes of files, before anything has run."""
    return plan(df)[1].count("BroadcastExchange")


def test_offsets_of_value_chunks(spark, stored):
    """24 values a task, each in a chunk of its own: more offsets than tasks."""
    _, utils, jobs = stored
    assert broadcasts(utilization.job_utilizations(utils)) == 0
    long = utilization.task_utilization_long(utils).withColumn("w", F.lit(1).cast("bigint"))
    assert broadcasts(percentile.percentile_columns(long, ["job_id", "ui", "measure"], [0.5, 1.0])) == 0
    values = {}
    for r in long.collect():
        values.setdefault((r.job_id, r.ui, r.measure), []).append(r.v)
    got = percentile.percentile_columns(long, ["job_id", "ui", "measure"], [0.5, 1.0]).collect()
    want = {k: (sorted(v)[(len(v) + 1) // 2 - 1], max(v)) for k, v in values.items()}
    assert {(r.job_id, r.ui, r.measure): (r["__p0"], r["__p1"]) for r in got} == want
    assert jobs.count() == len({k[0] for k in want})


def test_summaries_of_usage(spark, stored):
    usage, utils, jobs = stored
    for args in ((usage, utils, jobs), (usage, utils), (usage, None, jobs)):
        assert broadcasts(enrich.combine_usage(*args)) == 0
    both = enrich.combine_usage(usage, utils, jobs)
    got = both.select("tie", F.col("task.info.task_index").alias("idx"), F.coalesce("job.job_info.id", F.lit(0)).alias("job")).collect()
    assert Counter(tuple(r) for r in got) == Counter(
        (r.tie, r.task_info.task_index, r.task_info.job.id or 0) for r in usage.collect())
    assert len(_rows(both)) == 1000
    # a reader of few columns prunes the summaries to their keys, which are as many
    narrow = both.select("tie", "usage.start_time")
    assert broadcasts(narrow) == 0
    assert machine.machine_task_cells(both).count() > 0


def test_parts_of_a_task_summary(spark, stored):
    """The percentiles and first records of all tasks meet the other columns by their shuffle."""
    text = plan(utilization.task_utilizations(stored[0]))[1]
    assert text.split("BroadcastHashJoin", 1)[0].count("SortMergeJoin") == 2  # the only other join finds the first records
