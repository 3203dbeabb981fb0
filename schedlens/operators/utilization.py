"""Per-task and per-job utilisation summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import typed_struct, zero
from schedlens.operators.keys import extreme_rows, shuffled, time_order, usage_tie
from schedlens.operators.percentile import measure_percentiles, percentile_columns

# measure name -> (resources array, resources field)
TASK_MEASURES = {
    "max_cpus": ("max_resources", "cpus"),
    "max_memory": ("max_resources", "memory"),
    "cpus": ("resources", "cpus"),
    "memory": ("resources", "memory"),
}


def _total_time(c):
    """Sum of times, exact, saturating at the "after the trace" time."""
    exact = F.sum(c.cast("decimal(20,0)")).cast("decimal(38,0)")
    return F.least(exact, F.lit(S.LONG_MAX).cast("decimal(38,0)")).cast("bigint")


def _resources(cpus, memory):
    return typed_struct(S.RESOURCES, {"cpus": cpus, "memory": memory})


def task_utilizations(usage: DataFrame, percentiles=S.TASK_PERCENTILES) -> DataFrame:
    """One ``task_utilization`` row per task with at least one usage record
    carrying a task description with requested resources.

    * ``info``: the task description of the first such record (by start, end, tie)
    * ``start_time``/``end_time``/``running_time``: min, max, sum over all records
      (the sum saturates at Long.MAX_VALUE)
    * ``min_request``/``max_request``: over records with requests, unset = 0
    * ``percentile_task_usage[i]``: weighted percentile of ``max_resources``,
      ``percentile_mean_task_usage[i]`` of ``resources``; weight = end - start.

    An unset job id or task index reads 0, like every unset field of the trace. Two
    aggregates over the same key (job, task index), joined on it: the scalar one and the
    percentile one (windows over one shuffle of the narrow rows); the first record's description is
    fetched by its order.
    """
    job, idx = zero("task_info.job.id", 0), zero("task_info.task_index", 0)
    has_req = F.col("task_info").isNotNull() & F.col("task_info.requested_resources").isNotNull()
    req = "task_info.requested_resources"
    scalar = usage.groupBy(job.alias("__job"), idx.alias("__idx")).agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        _total_time(F.col("end_time") - F.col("start_time")).alias("running_time"),
        F.min(F.when(has_req, zero(f"{req}.cpus"))).alias("__min_c"),
        F.min(F.when(has_req, zero(f"{req}.memory"))).alias("__min_m"),
        F.max(F.when(has_req, zero(f"{req}.cpus"))).alias("__max_c"),
        F.max(F.when(has_req, zero(f"{req}.memory"))).alias("__max_m"),
        F.count_if(has_req).alias("__n_req"),
    ).where(F.col("__n_req") > 0)

    cells = measure_percentiles(
        usage.select(job.alias("__job"), idx.alias("__idx"), "start_time", "end_time", *{a for a, _ in TASK_MEASURES.values()}),
        ["__job", "__idx"], {m: zero(f"{a}.{f}") for m, (a, f) in TASK_MEASURES.items()},
        F.col("end_time") - F.col("start_time"), percentiles)
    arrays = _measure_arrays(cells, ["__job", "__idx"], len(percentiles))

    first = extreme_rows(usage.where(has_req), {"__job": job, "__idx": idx}, time_order(F.col("start_time"), F.col("end_time")),
                         usage_tie(usage), last=False)
    first = first.select("__job", "__idx", F.col("task_info").alias("info"))
    out = scalar.join(shuffled(arrays), ["__job", "__idx"], "inner").join(shuffled(first), ["__job", "__idx"], "inner")
    return out.select(
        F.col("info"),
        F.lit(None).cast(S.TASK_UTILIZATION["task_samples"].dataType).alias("task_samples"),
        _resources(F.col("__min_c"), F.col("__min_m")).alias("min_request"),
        _resources(F.col("__max_c"), F.col("__max_m")).alias("max_request"),
        F.array(*[F.lit(float(p)) for p in percentiles]).alias("usage_percentile"),
        F.col("percentile_task_usage"),
        F.col("percentile_mean_task_usage"),
        "start_time", "end_time", "running_time",
    )


def _measure_columns(wide: DataFrame, by: list[str], n: int) -> DataFrame:
    """One row per key: the four measures of each percentile, by one conditional
    aggregate of scalars (a hash aggregate), as two arrays of Resources."""
    return _measure_arrays(wide.groupBy(*by).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(f"__p{i}"))).alias(f"{m}_{i}") for m in TASK_MEASURES for i in range(n)]), by, n)


def _measure_arrays(cells: DataFrame, by: list[str], n: int) -> DataFrame:
    def array(cpus, memory):
        return F.array(*[_resources(F.col(f"{cpus}_{i}"), F.col(f"{memory}_{i}")) for i in range(n)])

    return cells.select(*by, array("max_cpus", "max_memory").alias("percentile_task_usage"),
                        array("cpus", "memory").alias("percentile_mean_task_usage"))


def task_utilization_long(task_utils: DataFrame) -> DataFrame:
    """``(job_id, task_index, ui, measure, v)``: the four percentile measures of
    each task, one row per (usage percentile, measure)."""
    x = task_utils.select(
        zero("info.job.id", 0).alias("job_id"), zero("info.task_index", 0).alias("task_index"),
        F.posexplode(F.arrays_zip("percentile_task_usage", "percentile_mean_task_usage")).alias("ui", "z"))
    pairs = F.array(
        F.struct(F.lit("max_cpus").alias("measure"), zero("z.percentile_task_usage.cpus").alias("v")),
        F.struct(F.lit("max_memory").alias("measure"), zero("z.percentile_task_usage.memory").alias("v")),
        F.struct(F.lit("cpus").alias("measure"), zero("z.percentile_mean_task_usage.cpus").alias("v")),
        F.struct(F.lit("memory").alias("measure"), zero("z.percentile_mean_task_usage.memory").alias("v")),
    )
    return x.select("job_id", "task_index", "ui", F.explode(pairs).alias("m")).select(
        "job_id", "task_index", "ui", "m.measure", "m.v")


def job_utilizations(task_utils: DataFrame, percentiles=S.JOB_PERCENTILES) -> DataFrame:
    """One ``job_utilization`` row per job from its task summaries.

    ``job_info`` and ``task_samples = [info]`` come from the first task (smallest
    task index). For each usage percentile ``p`` of the tasks (outer) and each
    job percentile ``p2`` (inner) the unweighted ``p2`` percentile over the job's
    tasks of their ``p`` values: ``len(p) * len(p2)`` Resources entries.
    """
    info = F.col("info")
    keyed = task_utils.select("*", zero("info.job.id", 0).alias("__job"), zero("info.task_index", 0).alias("__idx"))  # unset reads 0
    scalar = keyed.groupBy("__job").agg(
        F.min_by("info", "__idx").alias("__first"),
        F.min_by("usage_percentile", "__idx").alias("__up"),
        F.count_distinct("__idx").cast("int").alias("num_tasks"),
        F.array(*[F.count_if(zero(info.getField("final_event"), 0) == i).cast("int") for i in range(9)])
        .alias("num_tasks_final"),
        F.array(*[F.sum(zero(F.get(info.getField("num_events_by_type"), i), 0)).cast("int") for i in range(9)])
        .alias("num_events_by_type"),
        F.min(zero("min_request.cpus")).alias("__min_c"),
        F.min(zero("min_request.memory")).alias("__min_m"),
        F.max(zero("max_request.cpus")).alias("__max_c"),
        F.max(zero("max_request.memory")).alias("__max_m"),
        _total_time(F.col("running_time")).alias("running_time"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    )
    long = task_utilization_long(task_utils).withColumn("w", F.lit(1).cast("bigint"))
    n = len(percentiles)
    per_ui = _measure_columns(percentile_columns(long, ["job_id", "ui", "measure"], percentiles), ["job_id", "ui"], n)
    # one entry per usage percentile of the tasks, in their order
    entries = F.array_sort(F.collect_list(F.struct("ui", "percentile_task_usage", "percentile_mean_task_usage")))
    arrays = per_ui.groupBy(F.col("job_id").alias("__job")).agg(entries.alias("__l")).select(
        "__job", *[F.flatten(F.transform("__l", lambda x: x[c])).alias(c)
                   for c in ("percentile_task_usage", "percentile_mean_task_usage")])
    out = scalar.join(arrays, "__job", "left")
    return out.select(
        F.col("__first.job").alias("job_info"),
        F.array(F.col("__first")).alias("task_samples"),
        "num_tasks",
        _resources(F.col("__min_c"), F.col("__min_m")).alias("min_request"),
        _resources(F.col("__max_c"), F.col("__max_m")).alias("max_request"),
        F.flatten(F.transform(F.col("__up"), lambda _: F.array(*[F.lit(float(p)) for p in percentiles])))
        .alias("task_percentile"),
        F.flatten(F.transform(F.col("__up"), lambda x: F.array_repeat(x, n))).alias("usage_percentile"),
        "percentile_task_usage", "percentile_mean_task_usage",
        "start_time", "end_time", "running_time",
        "num_tasks_final", "num_events_by_type",
    )


def job_utilizations_direct(usage: DataFrame) -> DataFrame:
    """Job summaries straight from usage: task summaries, then job summaries."""
    return job_utilizations(task_utilizations(usage))
