"""Trace CSV ingest: raw comma-separated files -> typed trace tables.

Files are ``<dir>/*?????-of-?????.csv*`` (plain or compressed), split on commas
with no quoting; an empty field is unset (NULL). Required fields must be
present: an empty one fails the job, as does text that is not a number or a line
with too few fields (further fields are ignored).
The unsigned "after the trace" time ``18446744073709551615`` maps to
Long.MAX_VALUE.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from schedlens import schemas as S
from schedlens.functions import typed_struct
from schedlens.session import cut

TRACE_GLOB = "*?????-of-?????.csv*"

# Number of CSV columns per raw table.
RAW_WIDTH = {"task_usage": 19, "task_event": 13, "job_event": 8, "machine_event": 6}
# Columns that must not be empty, per raw table (0-based).
REQUIRED = {
    "task_usage": (0, 1, 2, 3, 4),
    "task_event": (0, 2, 3, 5),
    "job_event": (0, 2, 3),
    "machine_event": (0, 1, 2),
}
# Big tables are de-duplicated on the raw line.
DEDUPE_DEFAULT = {"task_usage": True, "task_event": True, "job_event": False, "machine_event": False}


# Rows of two longs that are broadcast: 1 << 21 take 32 MB.
DUPLICATE_BROADCAST_ROWS = 1 << 21


def raw_schema(kind: str) -> StructType:
    return StructType([StructField(f"c{i}", StringType(), True) for i in range(RAW_WIDTH[kind])])


def _fingerprint(line: Column) -> list[Column]:
    """128 bits of a line, as two differently seeded hashes."""
    return [F.xxhash64(line), F.xxhash64(F.lit(1), line)]


def distinct_lines(lines: DataFrame, fingerprint: Callable[[Column], list[Column]] = _fingerprint,
                   broadcast_rows: int = DUPLICATE_BROADCAST_ROWS) -> DataFrame:
    """Each distinct ``value`` once. Only fingerprints are shuffled for all lines; whole lines
    only where a fingerprint occurs more than once, and there the lines themselves are compared,
    so two lines that share a fingerprint both stay. The repeated fingerprints are stored and,
    up to ``broadcast_rows`` of them, broadcast to tell the lines apart; beyond, most of the
    input repeats and whole lines are shuffled."""
    marks = [c.alias(f"__f{i}") for i, c in enumerate(fingerprint(F.col("value")))]
    names = [f"__f{i}" for i in range(len(marks))]
    counted = lines.select(*marks).groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    repeated = cut(counted.where("__n > 1").select(*names), "repeated-lines")
    n = repeated.count()
    if n == 0:
        return lines.select("value")
    if n > broadcast_rows:
        return lines.select("value").dropDuplicates()
    marked = lines.select("value", *marks)
    single = marked.join(F.broadcast(repeated), names, "left_anti").select("value")
    several = marked.join(F.broadcast(repeated), names, "left_semi").select("value")
    return single.unionByName(several.dropDuplicates())


def read_raw(spark: SparkSession, in_dir: str, kind: str, pattern: str = TRACE_GLOB,
             dedupe: bool | None = None) -> DataFrame:
    """Raw string columns ``c0..cN`` of one table; each distinct line once when
    ``dedupe`` (default on for task events and usage). The whole line is compared,
    so lines that differ only past the last known column both stay."""
    lines = spark.read.text(f"{in_dir.rstrip('/')}/{pattern}").select("value")
    if dedupe if dedupe is not None else DEDUPE_DEFAULT[kind]:
        lines = distinct_lines(lines)
    width = RAW_WIDTH[kind]
    rows = lines.select(F.split("value", ",", -1).alias("f"))
    # checks are filters, which column pruning does not remove
    short = F.raise_error(F.concat(F.lit(f"{kind}: expected {width} fields, found "), F.size("f").cast("string")))
    rows = rows.where(F.when(F.size("f") >= width, True).otherwise(short.cast("boolean")))
    for i in REQUIRED[kind]:
        empty = F.raise_error(F.lit(f"{kind}: required column c{i} is empty"))
        rows = rows.where(F.when(F.get("f", F.lit(i)) != "", True).otherwise(empty.cast("boolean")))
    return rows.select(*[F.get("f", F.lit(i)).alias(f"c{i}") for i in range(width)])


def _field(c: str) -> Column:
    """A raw field with empty text read as unset (NULL)."""
    return F.when(F.col(c) == "", F.lit(None).cast("string")).otherwise(F.col(c))


def _req(c: str, kind: str) -> Column:
    return F.when(_field(c).isNull(), F.raise_error(F.lit(f"{kind}: required column {c} is empty"))) \
        .otherwise(F.col(c))


def to_time(c: Column) -> Column:
    return F.when(c == S.SENTINEL_TEXT, F.lit(S.LONG_MAX)).otherwise(c.cast("bigint"))


def to_long(c: Column) -> Column:
    return c.cast("bigint")


def to_int(c: Column) -> Column:
    return c.cast("int")


def to_float(c: Column) -> Column:
    return c.cast("double")


def to_bool(c: Column) -> Column:
    return F.when(c.isNull(), None).otherwise(c == "1")


def convert(df: DataFrame, kind: str) -> DataFrame:
    """Typed rows from raw string columns."""
    need = set(REQUIRED[kind])

    def c(i: int) -> Column:
        return _req(f"c{i}", kind) if i in need else _field(f"c{i}")

    if kind == "task_usage":
        res = typed_struct(S.RESOURCES, {
            "cpus": to_float(c(5)), "memory": to_float(c(6)), "assigned_memory": to_float(c(7)),
            "unmapped_page_cache_memory": to_float(c(8)), "page_cache_memory": to_float(c(9)),
            "disk_time": to_float(c(11)), "disk_space": to_float(c(12)),
        })
        mx = typed_struct(S.RESOURCES, {
            "memory": to_float(c(10)), "cpus": to_float(c(13)), "disk_time": to_float(c(14)),
        })
        return df.select(
            to_time(c(0)).alias("start_time"), to_time(c(1)).alias("end_time"),
            res.alias("resources"), mx.alias("max_resources"),
            to_float(c(15)).alias("cycles_per_instruction"),
            to_float(c(16)).alias("memory_accesses_per_instruction"),
            to_float(c(17)).alias("sample_portion"),
            to_bool(c(18)).alias("aggregation_type"),
            typed_struct(S.TASK_INFO, {
                "job": typed_struct(S.JOB_INFO, {"id": to_long(c(2))}),
                "task_index": to_int(c(3)),
            }).alias("task_info"),
            typed_struct(S.MACHINE_INFO, {"id": to_long(c(4))}).alias("machine_info"),
        )
    if kind == "task_event":
        info = typed_struct(S.TASK_INFO, {
            "job": typed_struct(S.JOB_INFO, {"id": to_long(c(2)), "user": c(6)}),
            "task_index": to_int(c(3)),
            "scheduling_class": to_int(c(7)),
            "priority": to_int(c(8)),
            # present (possibly with no fields set) on every ingested event
            "requested_resources": typed_struct(S.RESOURCES, {
                "cpus": to_float(c(9)), "memory": to_float(c(10)), "disk_space": to_float(c(11))}),
            "different_machines": to_bool(c(12)),
        })
        machine = F.when(_field("c4").isNull(), F.lit(None).cast(S.MACHINE_INFO)) \
            .otherwise(typed_struct(S.MACHINE_INFO, {"id": to_long(c(4))}))
        return df.select(
            to_time(c(0)).alias("time"), to_int(c(1)).alias("missing_type"),
            to_int(c(5)).alias("type"), info.alias("info"), machine.alias("machine_info"))
    if kind == "job_event":
        info = typed_struct(S.JOB_INFO, {
            "id": to_long(c(2)), "user": c(4), "scheduling_class": to_int(c(5)),
            "name": c(6), "logical_name": c(7)})
        return df.select(
            to_time(c(0)).alias("time"), to_int(c(1)).alias("missing_type"),
            to_int(c(3)).alias("type"), info.alias("info"))
    if kind == "machine_event":
        info = typed_struct(S.MACHINE_INFO, {
            "id": to_long(c(1)),
            "platform_id": c(3),
            "capacity": typed_struct(S.RESOURCES, {"cpus": to_float(c(4)), "memory": to_float(c(5))}),
        })
        return df.select(
            to_time(c(0)).alias("time"),
            to_int(c(2)).isin(*S.MACHINE_UP_RAW_TYPES).alias("up"),
            info.alias("info"))
    raise ValueError(f"unknown raw table {kind!r}")


def read_trace(spark: SparkSession, in_dir: str, kind: str, pattern: str = TRACE_GLOB,
               dedupe: bool | None = None) -> DataFrame:
    """Typed trace table from a directory of raw CSV files."""
    return convert(read_raw(spark, in_dir, kind, pattern, dedupe), kind)


# ---------------------------------------------------------------------------
# The inverse layout, for exporting typed rows as trace CSV (round trips).
# ---------------------------------------------------------------------------

def _s(c: Column) -> Column:
    return c.cast("string")


def _b(c: Column) -> Column:
    return F.when(c, F.lit("1")).when(~c, F.lit("0"))


def raw_columns(df: DataFrame, kind: str) -> DataFrame:
    """Typed rows -> raw string columns ``c0..cN`` in the trace CSV layout."""
    if kind == "task_usage":
        vals = [_s(F.col("start_time")), _s(F.col("end_time")), _s(F.col("task_info.job.id")),
                _s(F.col("task_info.task_index")), _s(F.col("machine_info.id")),
                *[_s(F.col(f"resources.{f}")) for f in ("cpus", "memory", "assigned_memory",
                                                        "unmapped_page_cache_memory", "page_cache_memory")],
                _s(F.col("max_resources.memory")), _s(F.col("resources.disk_time")),
                _s(F.col("resources.disk_space")), _s(F.col("max_resources.cpus")),
                _s(F.col("max_resources.disk_time")), _s(F.col("cycles_per_instruction")),
                _s(F.col("memory_accesses_per_instruction")), _s(F.col("sample_portion")),
                _b(F.col("aggregation_type"))]
    elif kind == "task_event":
        vals = [_s(F.col("time")), _s(F.col("missing_type")), _s(F.col("info.job.id")),
                _s(F.col("info.task_index")), _s(F.col("machine_info.id")), _s(F.col("type")),
                F.col("info.job.user"), _s(F.col("info.scheduling_class")), _s(F.col("info.priority")),
                _s(F.col("info.requested_resources.cpus")), _s(F.col("info.requested_resources.memory")),
                _s(F.col("info.requested_resources.disk_space")), _b(F.col("info.different_machines"))]
    elif kind == "job_event":
        vals = [_s(F.col("time")), _s(F.col("missing_type")), _s(F.col("info.id")), _s(F.col("type")),
                F.col("info.user"), _s(F.col("info.scheduling_class")), F.col("info.name"),
                F.col("info.logical_name")]
    elif kind == "machine_event":
        vals = [_s(F.col("time")), _s(F.col("info.id")), F.when(F.col("up"), "0").otherwise("1"),
                F.col("info.platform_id"), _s(F.col("info.capacity.cpus")), _s(F.col("info.capacity.memory"))]
    else:
        raise ValueError(kind)
    return df.select(*[v.alias(f"c{i}") for i, v in enumerate(vals)])


def write_raw(df: DataFrame, kind: str, out_dir: str, mode: str = "overwrite") -> str:
    """Write typed rows as trace CSV (no quoting, empty = unset)."""
    raw_columns(df, kind).write.mode(mode).option("nullValue", "").csv(out_dir)
    return out_dir
