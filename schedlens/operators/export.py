"""Job exports: duration bands and the flat per-job feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import zero

# Fixed export names of the nine event types, in type-code order.
EVENT_COLUMN_NAMES = ["submit", "schedule", "evict", "fail", "finish", "kill", "lost",
                      "update_pending", "update_running"]
# Fixed names of the four values of each percentile entry.
PERCENTILE_VALUE_NAMES = ["max_cpus", "max_mem", "mean_cpu", "mean_mem"]


def job_bands() -> dict[str, Column]:
    """Seven duration bands of jobs (inclusive upper bounds), by name."""
    d = F.col("end_time") - F.col("start_time")
    return {
        "subminute": d <= S.MINUTE,
        "minute": d > S.MINUTE,
        "hour": d > S.HOUR,
        "day": d > S.DAY,
        "subhour": d <= S.HOUR,
        "subday": d <= S.DAY,
        "multitask": F.col("num_tasks") > 1,
    }


def band_names() -> Column:
    """array<string>: the bands a job belongs to."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in job_bands().items()]), lambda x: x.isNotNull())


def job_band_membership(job_utils: DataFrame) -> DataFrame:
    """Long ``(band, job_id, duration, num_tasks)``: one row per job and band it
    belongs to (one scan, no per-band pass)."""
    return job_utils.select(
        F.explode(band_names()).alias("band"),
        F.col("job_info.id").alias("job_id"),
        (F.col("end_time") - F.col("start_time")).alias("duration"),
        F.col("num_tasks"),
    )


def percent_label(p: float) -> str:
    """``max`` for 1.0, else the whole percent (0.01 -> ``1``)."""
    return "max" if p == 1.0 else str(int(round(p * 100)))


def feature_columns(task_percentiles=S.TASK_PERCENTILES,
                    job_percentiles=S.JOB_PERCENTILES) -> list[tuple[str, Column]]:
    """``(name, expression)`` of the job feature table, in export order:
    3 strings, 12 scalars, 4 values per (usage percentile, job percentile)
    entry, 9 event counts, 9 final-event counts, missing and event totals."""
    first = F.get(F.col("task_samples"), 0)
    cols: list[tuple[str, Column]] = [
        ("name", F.col("job_info.name")),
        ("logical_name", F.col("job_info.logical_name")),
        ("user", F.col("job_info.user")),
    ]
    num = [
        ("scheduling_class", zero("job_info.scheduling_class")),
        ("priority", zero(first.getField("priority"))),
        # 0 when the first task asks for different machines, else 1 (kept as exported)
        ("different_machines", F.when(F.coalesce(first.getField("different_machines"), F.lit(False)), 0.0)
         .otherwise(1.0)),
        ("start_time", F.col("start_time")),
        ("end_time", F.col("end_time")),
        ("duration", F.col("end_time") - F.col("start_time")),
        ("running_time", F.col("running_time")),
        ("num_tasks", F.col("num_tasks")),
        ("min_req_cpus", zero("min_request.cpus")),
        ("min_req_memory", zero("min_request.memory")),
        ("max_req_cpus", zero("max_request.cpus")),
        ("max_req_memory", zero("max_request.memory")),
    ]
    k = 0
    for up in task_percentiles:
        for tp in job_percentiles:
            prefix = f"t{percent_label(tp)}_pt{percent_label(up)}"
            tu = F.get(F.col("percentile_task_usage"), k)
            mu = F.get(F.col("percentile_mean_task_usage"), k)
            vals = [tu.getField("cpus"), tu.getField("memory"), mu.getField("cpus"), mu.getField("memory")]
            num += [(f"{prefix}_{n}", zero(v)) for n, v in zip(PERCENTILE_VALUE_NAMES, vals)]
            k += 1
    num += [(f"num_{n}", zero(F.get(F.col("num_events_by_type"), i), 0))
            for i, n in enumerate(EVENT_COLUMN_NAMES)]
    num += [(f"num_final_{n}", zero(F.get(F.col("num_tasks_final"), i), 0))
            for i, n in enumerate(EVENT_COLUMN_NAMES)]
    num += [
        ("num_missing", F.aggregate(F.col("task_samples"), F.lit(0).cast("bigint"),
                                    lambda a, x: a + zero(x.getField("num_missing"), 0))),
        ("num_events", F.aggregate(F.col("task_samples"), F.lit(0).cast("bigint"),
                                   lambda a, x: a + zero(x.getField("num_events"), 0))),
    ]
    return cols + [(n, c.cast("double")) for n, c in num]


def flat_export(df: DataFrame, columns: list[tuple[str, Column]]) -> DataFrame:
    """Any flat export: one output column per ``(name, expression)`` pair, in
    order (string and numeric values alike)."""
    return df.select(*[c.alias(n) for n, c in columns])


def job_features(job_utils: DataFrame, with_job_id: bool = True, extra: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """The flat per-job feature table (3 string + 176 numeric columns), ``extra`` behind it.

    After ``mark_job_utilization`` the totals of missing records and events
    come from its aggregate columns (every task of the job), otherwise from
    the ``task_samples`` list.
    """
    cols = feature_columns()
    if "samples_num_missing" in job_utils.columns:
        cols = [(n, F.col("samples_num_missing").cast("double")) if n == "num_missing" else
                (n, F.col("samples_num_events").cast("double")) if n == "num_events" else (n, c)
                for n, c in cols]
    if with_job_id:
        cols = [("job_id", F.col("job_info.id"))] + cols
    # Extra, correctly oriented flag next to the exported one.
    cols.append(("requires_different_machines",
                 F.coalesce(F.get(F.col("task_samples"), 0).getField("different_machines"), F.lit(False))))
    return flat_export(job_utils, [*cols, *extra])


def write_band_features(job_utils: DataFrame, out_dir: str) -> dict[str, str]:
    """The feature table of each duration band: one scan, the rows expanded to their bands and
    one write partitioned by band. Returns the folder of each band; a band without jobs gets an
    empty file of the same columns."""
    out = out_dir.rstrip("/")
    rows = job_features(job_utils, extra=[("__bands", band_names())])
    rows = rows.withColumn("band", F.explode("__bands")).drop("__bands")
    rows.write.mode("overwrite").partitionBy("band").parquet(out)
    written = {r.band for r in job_utils.sparkSession.read.schema("band string").parquet(out).select("band").distinct().collect()}  # at most seven
    paths = {n: f"{out}/band={n}" for n in job_bands()}
    for n in paths.keys() - written:
        rows.drop("band").limit(0).write.mode("overwrite").parquet(paths[n])
    return paths
