"""Typed schemas of the trace data model.

Every record is a row with nested structs; NULL means "field not present".
Times are BIGINT microseconds of trace time (not TIMESTAMP: the "after the
trace" sentinel is Long.MAX_VALUE and does not fit a timestamp).
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# ---------------------------------------------------------------------------
# Fixed values that must equal the trace format (time units, enum codes).
# ---------------------------------------------------------------------------
SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR
FIVE_MIN = 5 * MINUTE
LONG_MAX = 9_223_372_036_854_775_807
SENTINEL_TEXT = "18446744073709551615"  # unsigned "after the trace" time in the CSV

# Time-split as-of join: period length and horizon (20 minutes, 30 days).
TIME_PERIOD = 20 * MINUTE
MAX_TIME = 30 * DAY

# Task event types, codes 0..8 in this order.
SUBMIT, SCHEDULE, EVICT, FAIL, FINISH, KILL, LOST, UPDATE_PENDING, UPDATE_RUNNING = range(9)
DEATH_TYPES = [EVICT, FAIL, FINISH, KILL, LOST]
# Machine event raw types that mean "machine is up": ADD (0) and UPDATE (2).
MACHINE_UP_RAW_TYPES = (0, 2)

# Percentiles of usage within one task, and of task summaries within one job.
TASK_PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
JOB_PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
# Priorities reported by the priority series, -1 = "no priority".
SERIES_PRIORITIES = list(range(-1, 12))
HIGH_PRIORITY_ABOVE = 8


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


RESOURCES = _s(
    ("cpus", DoubleType()),
    ("memory", DoubleType()),
    ("disk_time", DoubleType()),
    ("disk_space", DoubleType()),
    ("assigned_memory", DoubleType()),
    ("unmapped_page_cache_memory", DoubleType()),
    ("page_cache_memory", DoubleType()),
)

JOB_INFO = _s(
    ("id", LongType()),
    ("name", StringType()),
    ("logical_name", StringType()),
    ("user", StringType()),
    ("scheduling_class", IntegerType()),
    ("min_priority", IntegerType()),
    ("max_priority", IntegerType()),
)

MACHINE_ATTRIBUTE = _s(
    ("name", StringType()),
    ("value_as_string", StringType()),
    ("value_as_int", IntegerType()),
)

MACHINE_CONSTRAINT = _s(
    ("name", StringType()),
    ("type", IntegerType()),
    ("compare_number", IntegerType()),
    ("compare_string", StringType()),
)

TASK_INFO = _s(
    ("job", JOB_INFO),
    ("task_index", IntegerType()),
    ("priority", IntegerType()),
    ("scheduling_class", IntegerType()),
    ("constraints", ArrayType(MACHINE_CONSTRAINT)),
    ("requested_resources", RESOURCES),
    ("different_machines", BooleanType()),
    ("num_events_by_type", ArrayType(IntegerType())),
    ("final_event", IntegerType()),
    ("first_submit_time", LongType()),
    ("first_schedule_time", LongType()),
    ("last_deschedule_time", LongType()),
    ("num_missing", IntegerType()),
    ("num_events", IntegerType()),
)

MACHINE_INFO = _s(
    ("id", LongType()),
    ("capacity", RESOURCES),
    ("attributes", ArrayType(MACHINE_ATTRIBUTE)),
    ("platform_id", StringType()),
    ("last_down_time", LongType()),
    ("last_up_time", LongType()),
)

TASK_USAGE = _s(
    ("start_time", LongType()),
    ("end_time", LongType()),
    ("resources", RESOURCES),
    ("max_resources", RESOURCES),
    ("cycles_per_instruction", DoubleType()),
    ("memory_accesses_per_instruction", DoubleType()),
    ("sample_portion", DoubleType()),
    ("aggregation_type", BooleanType()),
    ("task_info", TASK_INFO),
    ("machine_info", MACHINE_INFO),
)

TASK_EVENT = _s(
    ("time", LongType()),
    ("missing_type", IntegerType()),
    ("type", IntegerType()),
    ("info", TASK_INFO),
    ("machine_info", MACHINE_INFO),
)

JOB_EVENT = _s(
    ("time", LongType()),
    ("missing_type", IntegerType()),
    ("type", IntegerType()),
    ("info", JOB_INFO),
)

MACHINE_EVENT = _s(
    ("time", LongType()),
    ("up", BooleanType()),
    ("info", MACHINE_INFO),
)

TASK_UTILIZATION = _s(
    ("info", TASK_INFO),
    ("task_samples", ArrayType(TASK_INFO)),
    ("min_request", RESOURCES),
    ("max_request", RESOURCES),
    ("usage_percentile", ArrayType(DoubleType())),
    ("percentile_task_usage", ArrayType(RESOURCES)),
    ("percentile_mean_task_usage", ArrayType(RESOURCES)),
    ("start_time", LongType()),
    ("end_time", LongType()),
    ("running_time", LongType()),
)

JOB_UTILIZATION = _s(
    ("job_info", JOB_INFO),
    ("task_samples", ArrayType(TASK_INFO)),
    ("num_tasks", IntegerType()),
    ("min_request", RESOURCES),
    ("max_request", RESOURCES),
    ("task_percentile", ArrayType(DoubleType())),
    ("usage_percentile", ArrayType(DoubleType())),
    ("percentile_task_usage", ArrayType(RESOURCES)),
    ("percentile_mean_task_usage", ArrayType(RESOURCES)),
    ("start_time", LongType()),
    ("end_time", LongType()),
    ("running_time", LongType()),
    ("num_tasks_final", ArrayType(IntegerType())),
    ("num_events_by_type", ArrayType(IntegerType())),
)

TASK_USAGE_WITH_AVG = _s(
    ("usage", TASK_USAGE),
    ("task", TASK_UTILIZATION),
    ("job", JOB_UTILIZATION),
    ("next_death", TASK_EVENT),
)

# Machine x time bucket. Its records are a long table of their own, keyed alike.
USAGE_BY_MACHINE = _s(
    ("machine_id", LongType()),
    ("bucket", LongType()),
    ("start_time", LongType()),
    ("end_time", LongType()),
    ("resources", RESOURCES),
    ("info", MACHINE_INFO),
    ("num_components", LongType()),
)

MACHINE_COMPONENT = _s(
    ("machine_id", LongType()),
    ("bucket", LongType()),
    ("usage", TASK_USAGE),
)

TABLE_SCHEMAS = {
    "task_usage": TASK_USAGE,
    "task_event": TASK_EVENT,
    "job_event": JOB_EVENT,
    "machine_event": MACHINE_EVENT,
    "task_utilization": TASK_UTILIZATION,
    "job_utilization": JOB_UTILIZATION,
    "task_usage_with_avg": TASK_USAGE_WITH_AVG,
    "usage_by_machine": USAGE_BY_MACHINE,
    "machine_component": MACHINE_COMPONENT,
}
