"""Usage and reservation per priority level over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import bucket_5min, exact, zero

# measure -> value of one usage-with-summary row
SERIES_MEASURES = {
    "cpu_usage": "usage.resources.cpus",
    "mem_usage": "usage.resources.memory",
    "cpu_reservation": "next_death.info.requested_resources.cpus",
    "mem_reservation": "next_death.info.requested_resources.memory",
}
# output text folders of the four series
SERIES_FILES = {
    "cpu_usage": "cpu_time_prio",
    "mem_usage": "mem_time_prio",
    "cpu_reservation": "cpu_res_time_prio",
    "mem_reservation": "mem_res_time_prio",
}


def prio_label(p: int) -> str:
    return f"p{p}" if p >= 0 else f"pm{-p}"


def priority_means(uwa: DataFrame) -> DataFrame:
    """Per (machine, five-minute bucket, priority): duration-weighted mean of
    each measure. Priority comes from the task summary, -1 when unset; an unset
    value reads 0 (no next death => 0 reservation). Zero total weight gives
    NULL (counted as 0 by the series). The sums are exact."""
    w = F.col("usage.end_time") - F.col("usage.start_time")
    sums = exact.exact_sums(uwa.groupBy(
        F.col("usage.machine_info.id").alias("machine_id"),
        bucket_5min("usage.start_time").alias("bucket"),
        F.coalesce(F.col("task.info.priority"), F.lit(-1)).alias("priority"),
    ), {m: w * zero(c) for m, c in SERIES_MEASURES.items()}, F.sum(w).cast("double").alias("__w"))
    return sums.select("machine_id", "bucket", "priority", *[F.try_divide(F.col(m), F.col("__w")).alias(m) for m in SERIES_MEASURES])


def priority_series(uwa: DataFrame) -> DataFrame:
    """Per bucket: for each measure and priority -1..11 the exact sum over machines
    of the per-machine means (missing = 0; other priorities dropped). All four
    series in one aggregation, then a fixed-value pivot of its few rows."""
    level = F.when(F.col("priority").isin(*S.SERIES_PRIORITIES), F.col("priority"))
    sums = exact.exact_sums(priority_means(uwa).groupBy("bucket", level.alias("priority")), {m: F.col(m) for m in SERIES_MEASURES})
    cols = []
    for m in SERIES_MEASURES:
        for p in S.SERIES_PRIORITIES:
            cols.append(F.coalesce(F.max(F.when(F.col("priority") == p, F.col(m))), F.lit(0.0))
                        .alias(f"{m}_{prio_label(p)}"))
    return sums.groupBy("bucket").agg(*cols)


def series_lines(series: DataFrame, measure: str) -> DataFrame:
    """Text lines ``bucket v-1 v0 ... v11`` of one series (column ``value``)."""
    vals = [F.col(f"{measure}_{prio_label(p)}").cast("string") for p in S.SERIES_PRIORITIES]
    return series.select(F.concat_ws(" ", F.col("bucket").cast("string"), *vals).alias("value"))


def write_priority_series(series: DataFrame, out_dir: str, mode: str = "overwrite") -> dict[str, str]:
    paths = series_paths(out_dir)
    for m, path in paths.items():
        series_lines(series, m).write.mode(mode).text(path)
    return paths


def series_paths(out_dir: str) -> dict[str, str]:
    """The folder of each measure's text series."""
    return {m: f"{out_dir.rstrip('/')}/{name}" for m, name in SERIES_FILES.items()}
