"""Usage is joined with its summaries task by task, and stored with them only where asked for."""

from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.operators import enrich, machine, utilization
from schedlens.plans import pipelines
from schedlens.session import cut
from tests.test_asof_split import plan
from tests.test_by_task import _rows, _usage, no_broadcast  # noqa: F401


def test_job_summaries_join_the_tasks(spark, no_broadcast):  # noqa: F811
    """Usage is joined, and shuffled, by its task only."""
    usage = cut(_usage(spark))
    utils = cut(utilization.task_utilizations(usage))
    jobs = cut(utilization.job_utilizations(utils))
    both = enrich.combine_usage(usage, utils, jobs)
    first = plan(both)[1].split("SortMergeJoin ", 1)[1].split("\n", 1)[0]
    assert "__idx" in first
    assert len(_rows(both)) == 1000


def test_cells_do_not_store_the_wide_usage(spark):
    usage = cut(_usage(spark))
    events = spark.createDataFrame([], S.TASK_EVENT).withColumn("tie", F.lit(0).cast("long"))
    st = pipelines.TraceStages(events, None, None, usage)
    st._memo.update(usage_with_jobs_and_machines=usage, tasks_with_jobs_and_machines=events)
    cells = st.machine_cells
    assert "usage_with_avg" not in st._memo
    again = machine.machine_task_cells(st.usage_with_avg)
    assert sorted(map(str, cells.collect())) == sorted(map(str, again.collect())) and cells.count() > 0
    assert st.usage_with_avg_rows is st.usage_with_avg
