"""Per-task event consolidation, marking, and task samples per job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import zero
from schedlens.operators.keys import event_order, event_tie, extreme_rows


def consolidate_task_events(events: DataFrame) -> DataFrame:
    """One row per task (``job_id``, ``task_index``) summarising its events.

    Events are ordered by raw time then tie. ``last_deschedule_time`` keeps the
    trace tool's value, the *first* EVICT/FAIL/FINISH/KILL/LOST time
    (``last_deschedule_time_actual`` is the last one); ``num_missing`` keeps the
    tool's count of all events (``num_missing_actual`` counts set missing types).
    Every aggregate is a scalar, so it runs as a hash aggregate with partial
    aggregation map-side: a task with a huge number of events is combined before
    the shuffle.
    """
    t = F.col("type")
    death = t.isin(*S.DEATH_TYPES)
    return events.groupBy(
        F.col("info.job.id").alias("job_id"), F.col("info.task_index").alias("task_index")
    ).agg(
        F.array(*[F.count_if(t == i).cast("int") for i in range(9)]).alias("num_events_by_type"),
        F.max_by(t, event_order(events)).alias("final_event"),
        F.min(F.when(t == S.SUBMIT, F.col("time"))).alias("first_submit_time"),
        F.min(F.when(t == S.SCHEDULE, F.col("time"))).alias("first_schedule_time"),
        F.min(F.when(death, F.col("time"))).alias("last_deschedule_time"),
        F.max(F.when(death, F.col("time"))).alias("last_deschedule_time_actual"),
        F.count(F.lit(1)).cast("int").alias("num_missing"),
        F.count("missing_type").cast("int").alias("num_missing_actual"),
        F.count(F.lit(1)).cast("int").alias("num_events"),
    )


MARK_FIELDS = ("final_event", "first_submit_time", "first_schedule_time",
               "last_deschedule_time", "num_missing", "num_events")


def mark_tasks(events: DataFrame) -> DataFrame:
    """Merge each task's consolidated summary into every one of its events.

    The histogram is replaced (not concatenated), so marking twice is a no-op.
    Aggregate once, then join back on the task key: the aggregate side is one
    row per task and AQE's skew join splits a hot task's events.
    """
    agg = consolidate_task_events(events)
    keyed = events.withColumn("__job", F.col("info.job.id")).withColumn("__idx", F.col("info.task_index"))
    a = agg.select(F.col("job_id").alias("__job"), F.col("task_index").alias("__idx"),
                   F.struct(*[F.col(c) for c in ("num_events_by_type", *MARK_FIELDS)]).alias("__agg"))
    info = F.col("info").withField("num_events_by_type", F.col("__agg.num_events_by_type"))
    for f in MARK_FIELDS:
        info = info.withField(f, F.coalesce(F.col(f"__agg.{f}"), F.col(f"info.{f}")))
    joined = keyed.join(a, ["__job", "__idx"], "left")
    return joined.select(*[info.alias("info") if c == "info" else F.col(f"`{c}`") for c in events.columns])


def task_samples(events: DataFrame) -> DataFrame:
    """One task description per task: the info of its first event.

    Long form ``(job_id, task_index, info)``: a job's samples stay one row per
    task and are never gathered into one list.
    """
    first = extreme_rows(events, {"job_id": F.col("info.job.id"), "__index": F.col("info.task_index")},
                         event_order(events), event_tie(events), last=False)
    return first.select("job_id", F.col("__index").alias("task_index"), "info")


def mark_job_utilization(job_utils: DataFrame, events: DataFrame) -> DataFrame:
    """Attach the per-task samples of each job (inner join on the job id).

    Adds ``num_samples``, ``samples_num_missing``, ``samples_num_events`` and
    the first sample (smallest task index) as ``task_samples = [first]`` --
    the sums the feature table needs, computed as aggregates. All samples of a
    job are the rows of :func:`task_samples`; they are never gathered in a list.
    """
    s = task_samples(events)
    agg = s.groupBy(zero("job_id", 0).alias("__job")).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum(F.coalesce(F.col("info.num_missing"), F.lit(0))).alias("samples_num_missing"),
        F.sum(F.coalesce(F.col("info.num_events"), F.lit(0))).alias("samples_num_events"),
        F.min(zero("task_index", 0)).alias("__index"),
    )
    first = s.select(zero("job_id", 0).alias("__j"), zero("task_index", 0).alias("__i"), F.col("task_index").isNotNull().alias("__set"),
                     F.struct("info").alias("__first"))
    one = Window.partitionBy("__j", "__i").orderBy("__set")  # an unset index reads 0, as does index 0
    first = first.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    agg = agg.join(first, (F.col("__job") == F.col("__j")) & (F.col("__index") == F.col("__i")))
    out = job_utils.join(agg, zero("job_info.id", 0) == agg["__job"], "inner")
    out = out.withColumn("task_samples", F.array(F.col("__first.info")))
    return out.select(*job_utils.columns, "num_samples", "samples_num_missing", "samples_num_events")
