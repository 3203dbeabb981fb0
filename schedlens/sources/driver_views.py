"""Typed trace tables mapped from the driver's test tables.

The driver's parquet tables are not a cluster trace, so each trace table is a
deterministic projection of one of them (FIXTURES.md section B):

* task events  <- ``events``
* task usage   <- ``events``
* job events   <- ``orders``
* machine events <- ``lineitem``

Every view carries a ``tie`` column (the source row's unique id) that the
operators use as the explicit tie-break after time. Time is compressed
ten-fold, so the 30-day trace horizon corresponds to 3 days here.
Resource values are multiples of 1/128, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from schedlens import schemas as S
from schedlens.functions import idiv, typed_struct

EPOCH_2024_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z in microseconds
TRACE_HORIZON = 3 * S.DAY  # 30 days compressed ten-fold



def _d(x: int) -> Column:
    return F.lit(float(x)).cast("double")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _micros_since_2024(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {c})")
    return F.unix_micros(F.col(c)) - F.lit(EPOCH_2024_US)


def _days_since_1995(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    etype = (idiv(eid, 2) % 9).cast("int")
    job = typed_struct(S.JOB_INFO, {"id": idiv(uid, 10) + 1})
    req = typed_struct(S.RESOURCES, {
        "cpus": (eid % 128) / _d(128),
        "memory": F.when(eid % 17 == 0, None).otherwise((eid % 64) / _d(128)),
    })
    info = typed_struct(S.TASK_INFO, {
        "job": job,
        "task_index": uid % 10,
        "priority": F.when(uid % 13 == 12, None).otherwise(uid % 13),
        "scheduling_class": uid % 4,
        "requested_resources": req,
        "different_machines": eid % 5 == 0,
    })
    machine = (F.when(etype == S.SUBMIT, F.lit(None).cast(S.MACHINE_INFO))
               .when(eid % 37 == 0, typed_struct(S.MACHINE_INFO, {"id": F.lit(0)}))
               .otherwise(typed_struct(S.MACHINE_INFO, {"id": uid % 4 + 1})))
    return ev.select(
        idiv(_micros_since_2024(ev, "ts"), 10).alias("time"),
        F.when(eid % 11 == 0, eid % 3).cast("int").alias("missing_type"),
        etype.alias("type"),
        info.alias("info"),
        machine.alias("machine_info"),
        eid.alias("tie"),
    )


def task_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    eid, uid = F.col("event_id"), F.col("user_id")
    start = idiv(_micros_since_2024(ev, "ts"), 10)
    cpus = (eid % 64) / _d(128)
    res = typed_struct(S.RESOURCES, {
        "cpus": cpus,
        "memory": F.when(eid % 19 == 0, None).otherwise((eid % 96) / _d(128)),
    })
    mx = typed_struct(S.RESOURCES, {
        "cpus": cpus + (eid % 7) / _d(128),
        "memory": (eid % 96 + eid % 5) / _d(128),
    })
    info = typed_struct(S.TASK_INFO, {
        "job": typed_struct(S.JOB_INFO, {"id": idiv(uid, 10) + 1}),
        "task_index": uid % 10,
    })
    return ev.select(
        start.alias("start_time"),
        (start + (F.lit(60) + eid % 240) * F.lit(S.SECOND)).alias("end_time"),
        res.alias("resources"),
        mx.alias("max_resources"),
        *[F.lit(None).cast(S.TASK_USAGE[c].dataType).alias(c) for c in
          ("cycles_per_instruction", "memory_accesses_per_instruction", "sample_portion", "aggregation_type")],
        info.alias("task_info"),
        typed_struct(S.MACHINE_INFO, {"id": uid % 4 + 1}).alias("machine_info"),
        eid.alias("tie"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    info = typed_struct(S.JOB_INFO, {
        "id": idiv("o_custkey", 100) + 1,
        "name": F.col("o_orderstatus"),
        "logical_name": F.when(ok % 6 == 0, None).otherwise(F.concat(F.lit("L"), (ok % 6).cast("string"))),
        "user": F.col("o_orderpriority"),
        "scheduling_class": ok % 4,
    })
    return o.select(
        (_days_since_1995("o_orderdate") * F.lit(108_000_000)).alias("time"),
        F.lit(None).cast("int").alias("missing_type"),
        (ok % 9).cast("int").alias("type"),
        info.alias("info"),
        ok.alias("tie"),
    )


def machine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    info = typed_struct(S.MACHINE_INFO, {
        "id": F.col("l_suppkey") % 5 + 1,
        "capacity": typed_struct(S.RESOURCES, {"cpus": q / _d(64), "memory": q / _d(128)}),
        "platform_id": F.concat(F.col("l_linestatus"), F.col("l_returnflag")),
    })
    return li.select(
        (_days_since_1995("l_shipdate") * F.lit(103_000_000)).alias("time"),
        (F.col("l_returnflag") != "R").alias("up"),
        info.alias("info"),
        F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("tie"),
    )


VIEWS = {
    "task_event": task_events,
    "task_usage": task_usage,
    "job_event": job_events,
    "machine_event": machine_events,
}


def trace_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: fn(spark, sf_dir) for name, fn in VIEWS.items()}
