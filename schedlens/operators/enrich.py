"""Denormalising as-of joins of the trace tables, and the usage combinations.

Each enrichment merges the record that was current at the row's time into it,
field by field (a set field overwrites, an unset one keeps the old value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import (
    event_join_time,
    machine_event_join_time,
    merge_struct,
    usage_join_time,
    zero,
)
from schedlens.operators.asof import asof_join
from schedlens.operators.keys import shuffled, task_key_of_event, task_key_of_usage, tie_columns
from schedlens.sources.store import TASK_KEYS


def _payload(right: DataFrame, *cols: str) -> list[str]:
    return [c for c in cols if c in right.columns]


def _with_match(r, match_column: str | None, updates: dict) -> dict:
    """Optionally expose the matched right row's ``tie`` as ``match_column``."""
    if match_column:
        return {**updates, match_column: r.getField("tie")}
    return updates


def insert_job_in_task(tasks: DataFrame, jobs: DataFrame, strategy: str = "bucketed", match_column: str | None = None) -> DataFrame:
    """Task events <- job event current at the task event's time (key: job id)."""
    return asof_join(
        tasks, jobs,
        left_keys=[F.col("info.job.id")], right_keys=[F.col("info.id")],
        left_time=event_join_time(), right_time=event_join_time(),
        ties=tie_columns(jobs, ("time",)), strategy=strategy,
        right_payload=_payload(jobs, "info", "tie"),
        merge=lambda r: _with_match(r, match_column, {"info": F.col("info").withField(
            "job", merge_struct(F.col("info.job"), r.getField("info"), S.JOB_INFO))}),
    )


def machine_passthrough():
    """Task events without a machine (none, no id, or id 0) skip the machine join."""
    m = F.col("machine_info")
    return m.isNull() | m.getField("id").isNull() | (m.getField("id") == 0)


def insert_machine_in_task(tasks: DataFrame, machines: DataFrame, strategy: str = "auto",
                           match_column: str | None = None) -> DataFrame:
    """Task events <- machine event current at the task event's time."""
    return asof_join(
        tasks, machines,
        left_keys=[F.col("machine_info.id")], right_keys=[F.col("info.id")],
        left_time=event_join_time(), right_time=machine_event_join_time(),
        ties=tie_columns(machines, ("time",)), strategy=strategy,
        passthrough=machine_passthrough(),
        right_payload=_payload(machines, "info", "tie"),
        merge=lambda r: _with_match(r, match_column, {"machine_info": merge_struct(F.col("machine_info"), r.getField("info"), S.MACHINE_INFO)}),
    )


def insert_task_in_usage(usage: DataFrame, tasks: DataFrame, strategy: str = "bucketed",
                         match_column: str | None = None) -> DataFrame:
    """Usage <- task event current one second after the usage start (key: task)."""
    return asof_join(
        usage, tasks,
        left_keys=task_key_of_usage(), right_keys=task_key_of_event(),
        left_time=usage_join_time(), right_time=event_join_time(),
        ties=tie_columns(tasks, ("time",)), strategy=strategy,
        right_payload=_payload(tasks, "info", "tie"),
        merge=lambda r: _with_match(r, match_column, {"task_info": merge_struct(F.col("task_info"), r.getField("info"), S.TASK_INFO)}),
    )


def insert_machine_in_usage(usage: DataFrame, machines: DataFrame, strategy: str = "auto",
                            match_column: str | None = None) -> DataFrame:
    """Usage <- machine event current one second after the usage start."""
    return asof_join(
        usage, machines,
        left_keys=[F.col("machine_info.id")], right_keys=[F.col("info.id")],
        left_time=usage_join_time(), right_time=machine_event_join_time(),
        ties=tie_columns(machines, ("time",)), strategy=strategy,
        right_payload=_payload(machines, "info", "tie"),
        merge=lambda r: _with_match(r, match_column, {"machine_info": merge_struct(F.col("machine_info"), r.getField("info"), S.MACHINE_INFO)}),
    )


def insert_job_in_job_utilization(job_utils: DataFrame, jobs: DataFrame, strategy: str = "bucketed",
                                  match_column: str | None = None) -> DataFrame:
    """Job utilisation <- job event current at the job's end time."""
    return asof_join(
        job_utils, jobs,
        left_keys=[F.col("job_info.id")], right_keys=[F.col("info.id")],
        left_time=F.col("end_time"), right_time=event_join_time(),
        ties=tie_columns(jobs, ("time",)), strategy=strategy,
        right_payload=_payload(jobs, "info", "tie"),
        merge=lambda r: _with_match(r, match_column, {"job_info": merge_struct(F.col("job_info"), r.getField("info"), S.JOB_INFO)}),
    )


def combine_usage(usage: DataFrame, task_utils: DataFrame | None = None,
                  job_utils: DataFrame | None = None) -> DataFrame:
    """Wrap usage as ``usage_with_avg`` rows and attach its task and job summaries.

    Both attachments are inner equi-joins (usage without a summary is dropped;
    duplicate summaries multiply rows). Extra top-level columns of ``usage``
    (such as ``tie``) are carried along.
    """
    extra = [c for c in usage.columns if c not in S.TASK_USAGE.fieldNames()]
    out = usage.select(F.struct(*[F.col(c) for c in S.TASK_USAGE.fieldNames()]).alias("usage"), *extra)
    return attach_summaries(out, task_utils, job_utils)


def attach_summaries(rows: DataFrame, task_utils: DataFrame | None = None,
                     job_utils: DataFrame | None = None) -> DataFrame:
    """Inner equi-joins of wrapped usage (column ``usage``) with its summaries. They
    widen every row, so joins that shuffle usage (next death) come before. An unset job
    id or task index reads 0 on both sides.

    Tables stored by task (columns ``job_key``, ``task_key``) are joined on these, so their
    buckets meet without a shuffle. Job summaries join the task summaries, a row per task, and
    not the usage, which is shuffled once, before it is widened. Neither is broadcast: both
    grow with the trace, and stored they take a small part of their size in memory."""
    cols = list(rows.columns)
    out = rows.select("*", *_task_key(rows, "usage.task_info"))
    j = None if job_utils is None else job_utils.select(
        zero("job_info.id", 0).alias("__job"), F.struct(*[F.col(c) for c in job_utils.columns]).alias("job"))
    if task_utils is not None:
        t = task_utils.select(*_task_key(task_utils, "info"),
                              F.struct(*[F.col(c) for c in task_utils.columns if c not in TASK_KEYS]).alias("task"))
        if j is not None:
            t, j = t.join(shuffled(j), ["__job"], "inner"), None
            cols += ["task", "job"]
        else:
            cols.append("task")
        out = out.join(shuffled(t), ["__job", "__idx"], "inner")
    if j is not None:
        out = out.join(shuffled(j), ["__job"], "inner")
        cols.append("job")
    return out.select(*cols)


def _task_key(df: DataFrame, info: str) -> list[Column]:
    if TASK_KEYS[0] in df.columns:
        return [F.col(k).alias(a) for k, a in zip(TASK_KEYS, ("__job", "__idx"))]
    return [zero(f"{info}.job.id", 0).alias("__job"), zero(f"{info}.task_index", 0).alias("__idx")]


def death_events(events: DataFrame) -> DataFrame:
    """Events that end a task's run: EVICT, FAIL, FINISH, KILL, LOST."""
    return events.where(F.col("type").isin(*S.DEATH_TYPES))


def attach_next_death(usage_with_avg: DataFrame, events: DataFrame, strategy: str = "bucketed") -> DataFrame:
    """Each usage row gets the task's earliest death at or after its start
    (raw times; a death exactly at the start counts). Rows with no later death
    keep ``next_death`` NULL; deaths of tasks without usage produce nothing."""
    deaths = death_events(events)
    death_cols = [c for c in S.TASK_EVENT.fieldNames() if c in deaths.columns]
    deaths = deaths.withColumn("__death", F.struct(*[F.col(c) for c in death_cols]))
    return asof_join(
        usage_with_avg, deaths,
        left_keys=[F.col("usage.task_info.job.id"), F.col("usage.task_info.task_index")],
        right_keys=task_key_of_event(),
        left_time=F.col("usage.start_time"), right_time=F.col("time"),
        ties=tie_columns(deaths.drop("__death"), ("time",)), direction="forward", strategy=strategy,
        right_payload=["__death", *(["tie"] if "tie" in deaths.columns else [])],
        merge=lambda r: {"next_death": r.getField("__death"),
                         **({"next_death_tie": r.getField("tie")} if "tie" in deaths.columns else {})},
    )
