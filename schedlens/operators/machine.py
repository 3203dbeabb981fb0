"""Machine x time-bucket usage, its breakdown, and the latest machine state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import bucket_5min, bucket_daily, exact, typed_struct, zero
from schedlens.operators.keys import event_order, event_tie, extreme_rows, time_order

WEIGHT_UNIT = float(S.FIVE_MIN)  # usage weight = duration / 300 s


def _prefix(df: DataFrame) -> str:
    """``usage.`` for usage-with-summary rows, ``""`` for bare usage rows."""
    return "usage." if "usage" in df.columns else ""


def _tie(df: DataFrame, p: str) -> Column:
    """Order of usage records with equal times, one long."""
    if "tie" in df.columns:
        return F.col("tie").cast("bigint")
    # a hash of the fields that the summaries read, so that no others are scanned
    fields = ("task_info.job.id", "task_info.task_index", "resources.cpus", "resources.memory",
              "task_info.priority", "task_info.requested_resources", "machine_info")
    return F.xxhash64(*[F.col(f"{p}{f}") for f in fields])


CELL_KEY = ("machine_id", "bucket", "job_id", "task_index")
LAST_FIELDS = ("mem", "cpu", "req_cpu", "req_mem", "prio")


def machine_task_cells(df: DataFrame) -> DataFrame:
    """One mergeable cell per (machine, five-minute bucket, task): the only pass over usage
    that the machine tables need. A stored table of cells can stand for usage in all of them.

    A cell has its time range, its number of records, the exact accumulator of cpu time, the
    last record's values, and the first record's order (``first_at``, ``first_tie``) and
    machine description. All aggregates are scalars, so they are hash aggregates: records of
    equal times meet first (they differ in ``tie`` only), then the cell; both after one
    exchange. The description is fetched by its key afterwards.
    """
    p = _prefix(df)
    ti, res = f"{p}task_info", f"{p}resources"
    start, end, info = F.col(f"{p}start_time"), F.col(f"{p}end_time"), F.col(f"{p}machine_info")
    rows = df.select(
        info.getField("id").alias("machine_id"), bucket_5min(start).alias("bucket"),
        F.col(f"{ti}.job.id").alias("job_id"), F.col(f"{ti}.task_index").alias("task_index"),
        time_order(start, end).alias("at"), start.alias("start_time"), end.alias("end_time"), _tie(df, p).alias("tie"),
        zero(f"{res}.memory").alias("mem"), zero(f"{res}.cpus").alias("cpu"),
        zero(f"{ti}.requested_resources.cpus").alias("req_cpu"), zero(f"{ti}.requested_resources.memory").alias("req_mem"),
        zero(f"{ti}.priority", 0).alias("prio"),
        (zero(f"{res}.cpus") * (end - start)).alias("cpu_time"), F.xxhash64(info).alias("info_key"))
    same_time = rows.repartition(*CELL_KEY).groupBy(*CELL_KEY, "at", "start_time", "end_time").agg(
        F.count(F.lit(1)).alias("n"), *exact.accumulate("cpu_time", F.col("cpu_time")),
        *[F.max_by(c, "tie").alias(c) for c in LAST_FIELDS],
        F.min("tie").alias("first_tie"), F.min_by("info_key", "tie").alias("info_key"))
    cells = same_time.groupBy(*CELL_KEY).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n").alias("n"),
        *exact.merge("cpu_time"), *[F.max_by(c, "at").alias(c) for c in LAST_FIELDS],
        F.min("at").alias("first_at"), F.min_by("first_tie", "at").alias("first_tie"), F.min_by("info_key", "at").alias("info_key"))
    return _with_info(cells, df.select(info.getField("id").alias("machine_id"), F.xxhash64(info).alias("info_key"), info.alias("info")))


def _with_info(rows: DataFrame, infos: DataFrame) -> DataFrame:
    """Fetches machine descriptions by machine and key; a machine has a few."""
    infos = infos.distinct().select(F.col("machine_id").alias("__id"), F.col("info_key").alias("__key"), "info")
    return rows.join(infos, rows["machine_id"].eqNullSafe(infos["__id"]) & (rows["info_key"] == infos["__key"]), "left").drop("__id", "__key")


def _daily_cells(cells: DataFrame) -> DataFrame:
    """Cells of the same time of day merged. Their buckets do not overlap, so the latest
    bucket has the last record and the earliest the first."""
    key = [F.col(c) if c != "bucket" else (F.col("bucket") % (S.DAY // S.FIVE_MIN)).alias("bucket") for c in CELL_KEY]
    return cells.select(*key, F.col("bucket").alias("day_bucket"), *[c for c in cells.columns if c not in CELL_KEY]).groupBy(*CELL_KEY).agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n").alias("n"),
        *exact.merge("cpu_time"), *[F.max_by(c, "day_bucket").alias(c) for c in LAST_FIELDS],
        *[F.min_by(c, "day_bucket").alias(c) for c in ("first_at", "first_tie", "info_key")])


def machine_buckets(df: DataFrame, daily: bool = False, breakdown: bool = True) -> DataFrame:
    """One row per (machine, bucket) with usage (and breakdown) sums, from usage or from its
    cells. The sums are exact, whatever the order and partitioning."""
    cells = df if "first_at" in df.columns else machine_task_cells(df)
    infos = cells.select("machine_id", "info_key", "info")
    cells = cells.drop("info")
    if daily:
        cells = _daily_cells(cells)
    high = F.col("prio") > S.HIGH_PRIORITY_ABOVE
    sums = {"memory": F.col("mem"), "reserved_cpus": F.col("req_cpu"), "reserved_memory": F.col("req_mem"),
            **{n: F.when(high, F.col(c)).otherwise(F.lit(0.0)) for n, c in (
                ("reserved_high_cpus", "req_cpu"), ("reserved_high_memory", "req_mem"),
                ("used_high_cpus", "cpu"), ("used_high_memory", "mem"))}}
    if not breakdown:
        sums = {"memory": sums["memory"]}
    # cells whose first records have equal times meet first: only their ties differ
    same_time = cells.groupBy("machine_id", "bucket", "first_at").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n").alias("n"),
        *exact.merge("cpu_time"), *[c for n, x in sums.items() for c in exact.accumulate(n, x)],
        F.min_by("info_key", "first_tie").alias("info_key"))
    merged = same_time.groupBy("machine_id", "bucket").agg(
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"), F.sum("n").alias("num_components"),
        *[c for n in ("cpu_time", *sums) for c in exact.merge(n)], F.min_by("info_key", "first_at").alias("info_key"))
    out = _with_info(exact.finish(merged, ["cpu_time", *sums]), infos)
    return out.withColumn("cpus", F.col("cpu_time") / F.lit(WEIGHT_UNIT)).drop("cpu_time", "info_key")


def usage_by_machine(df: DataFrame, daily: bool = False) -> DataFrame:
    """``usage_by_machine`` rows: per machine and five-minute bucket (or
    five-minute slot of the day, summed over days when ``daily``): first start,
    last end, the first record's machine description, and resources

    * cpus   = sum of cpus * duration / 300 s over all records
    * memory = sum over tasks of the memory of the task's last record.

    Accepts bare usage rows, usage-with-summary rows (column ``usage``) or the cells of
    either (:func:`machine_task_cells`).
    """
    b = machine_buckets(df, daily, breakdown=False)
    return b.select(
        "machine_id", "bucket", "start_time", "end_time",
        typed_struct(S.RESOURCES, {"cpus": F.col("cpus"), "memory": F.col("memory")}).alias("resources"),
        "info", "num_components",
    )


def machine_components(df: DataFrame, daily: bool = False) -> DataFrame:
    """The records behind each (machine, bucket): one row per record, a long table
    keyed like :func:`usage_by_machine`, never a list per bucket. Accepts bare usage
    rows or usage-with-summary rows; for these ``with_avg`` holds the summaries too."""
    p = _prefix(df)
    start = F.col(f"{p}start_time")
    record = F.col("usage") if p else F.struct(*[F.col(c) for c in S.TASK_USAGE.fieldNames()])
    extra = [c for c in df.columns if c not in ("usage", *S.TASK_USAGE.fieldNames())]
    return df.select(F.col(f"{p}machine_info.id").alias("machine_id"),
                     (bucket_daily(start) if daily else bucket_5min(start)).alias("bucket"),
                     record.alias("usage"), *[F.col(f"`{c}`") for c in extra])


def usage_by_machine_daily(df: DataFrame) -> DataFrame:
    return usage_by_machine(df, daily=True)


def machine_breakdown(df: DataFrame, daily: bool = False) -> DataFrame:
    """Per machine bucket and for cpus and memory: used, capacity, reserved
    (requests of the bucket's distinct tasks, the task's last record), and the
    reserved / used share of high-priority (> 8) tasks; plus the one-line
    ``summary_cpus`` / ``summary_memory`` text."""
    b = machine_buckets(df, daily)
    out = b.select(
        "machine_id", "bucket",
        F.col("cpus").alias("used_cpus"),
        zero("info.capacity.cpus").alias("capacity_cpus"),
        F.col("reserved_cpus"), F.col("reserved_high_cpus"), F.col("used_high_cpus"),
        F.col("memory").alias("used_memory"),
        zero("info.capacity.memory").alias("capacity_memory"),
        F.col("reserved_memory"), F.col("reserved_high_memory"), F.col("used_high_memory"),
    )
    for r in ("cpus", "memory"):
        out = out.withColumn(f"summary_{r}", F.format_string(
            "used %s capacity %s reserved %s reservedHigh %s usedHigh %s",
            *[F.col(c).cast("float").cast("string") for c in (
                f"used_{r}", f"capacity_{r}", f"reserved_{r}", f"reserved_high_{r}", f"used_high_{r}")]))
    return out


def latest_up_machines(machines: DataFrame) -> DataFrame:
    """The latest machine event per machine id among events where it is up."""
    up = machines.where(F.col("up"))
    return extreme_rows(up, {"machine_id": F.col("info.id")}, event_order(machines), event_tie(machines))


def machine_configs(machines: DataFrame) -> DataFrame:
    """Machine configuration table: platform (first character), cpu, memory of
    each machine's latest up event."""
    latest = latest_up_machines(machines)
    return latest.select(
        "machine_id",
        F.substring(F.coalesce(F.col("info.platform_id"), F.lit("")), 1, 1).alias("platform"),
        zero("info.capacity.cpus").alias("cpu"),
        zero("info.capacity.memory").alias("memory"),
    )
