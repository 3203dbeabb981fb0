"""The query registry: one Spark query per operator, each with a DuckDB oracle.

Each query reads the driver's tables through the typed views, runs operators
of the library over the whole tables and returns a flat, aliased DataFrame
whose columns match the oracle SQL (``schedlens.plans.oracle*``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import event_join_time
from schedlens.functions.digest import content_digest
from schedlens.operators import asof, enrich, export, machine, percentile, sample, series, tasks, utilization
from schedlens.operators.keys import tie_columns
from schedlens.plans import oracle as O
from schedlens.plans import oracle_chain as C
from schedlens.plans import pipelines
from schedlens.session import cut, scratch_path
from schedlens.sources import driver_views as V
from schedlens.sources import ingest, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TP, JP = S.TASK_PERCENTILES, S.JOB_PERCENTILES
MEASURE_ALIASES = (("max_cpus", "ptu_cpus"), ("max_memory", "ptu_memory"),
                   ("cpus", "pmtu_cpus"), ("memory", "pmtu_memory"))


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def chain_sql(upto: str, body: str) -> str:
    return O.with_views(body, *C.chain_upto(upto))


# ---------------------------------------------------------------------------
# Shared Spark plans over the views
# ---------------------------------------------------------------------------

def views(spark: SparkSession, sf: str):
    return (V.task_events(spark, sf), V.task_usage(spark, sf),
            V.job_events(spark, sf), V.machine_events(spark, sf))


_STAGES: dict[tuple[str, str], pipelines.TraceStages] = {}


def stages(spark: SparkSession, sf: str) -> pipelines.TraceStages:
    """The staged pipeline over the views of ``sf``; within one session the
    stored stages are shared by every query that reads them."""
    key = (spark.sparkContext.applicationId, sf.rstrip("/"))
    if key not in _STAGES:
        te, tu, je, me = views(spark, sf)
        _STAGES[key] = pipelines.TraceStages(te, je, me, tu)
    return _STAGES[key]


# ---------------------------------------------------------------------------
# Flatteners
# ---------------------------------------------------------------------------

def _mark_cols(prefix: str) -> list[Column]:
    return [F.get(F.col(f"{prefix}num_events_by_type"), i).alias(f"n{i}") for i in range(9)] + [
        F.col(f"{prefix}{c}").alias(c) for c in tasks.MARK_FIELDS]


def task_utils_flat(tu: DataFrame) -> DataFrame:
    cols = [
        F.col("info.job.id").alias("job_id"), F.col("info.task_index").alias("task_index"),
        "start_time", "end_time", "running_time",
        F.col("min_request.cpus").alias("min_req_cpus"), F.col("min_request.memory").alias("min_req_memory"),
        F.col("max_request.cpus").alias("max_req_cpus"), F.col("max_request.memory").alias("max_req_memory"),
        F.col("info.priority").alias("priority"), F.col("info.scheduling_class").alias("scheduling_class"),
        F.col("info.different_machines").alias("different_machines"),
        *_mark_cols("info."),
        F.col("info.job.name").alias("job_name"), F.col("info.job.logical_name").alias("job_logical_name"),
        F.col("info.job.user").alias("job_user"), F.col("info.job.scheduling_class").alias("job_scheduling_class"),
    ]
    for m, a in MEASURE_ALIASES:
        arr = "percentile_task_usage" if m.startswith("max") else "percentile_mean_task_usage"
        f = "cpus" if m.endswith("cpus") else "memory"
        cols += [F.get(F.col(arr), i).getField(f).alias(f"{a}_{i}") for i in range(len(TP))]
    return tu.select(*cols)


def job_utils_flat(ju: DataFrame) -> DataFrame:
    first = F.get(F.col("task_samples"), 0)
    cols = [
        F.col("job_info.id").alias("job_id"),
        F.col("job_info.name").alias("job_name"), F.col("job_info.logical_name").alias("job_logical_name"),
        F.col("job_info.user").alias("job_user"), F.col("job_info.scheduling_class").alias("job_scheduling_class"),
        first.getField("priority").alias("first_priority"),
        first.getField("different_machines").alias("first_different_machines"),
        first.getField("num_missing").alias("first_num_missing"),
        first.getField("num_events").alias("first_num_events"),
        "num_tasks",
        *[F.get(F.col("num_tasks_final"), i).alias(f"ntf{i}") for i in range(9)],
        *[F.get(F.col("num_events_by_type"), i).alias(f"nebt{i}") for i in range(9)],
        F.col("min_request.cpus").alias("min_req_cpus"), F.col("min_request.memory").alias("min_req_memory"),
        F.col("max_request.cpus").alias("max_req_cpus"), F.col("max_request.memory").alias("max_req_memory"),
        "running_time", "start_time", "end_time",
    ]
    for u in range(len(TP)):
        for p in range(len(JP)):
            k = u * len(JP) + p
            for m, a in MEASURE_ALIASES:
                arr = "percentile_task_usage" if m.startswith("max") else "percentile_mean_task_usage"
                f = "cpus" if m.endswith("cpus") else "memory"
                cols.append(F.get(F.col(arr), k).getField(f).alias(f"{a}_{u}_{p}"))
    return ju.select(*cols)


# ---------------------------------------------------------------------------
# As-of joins
# ---------------------------------------------------------------------------

SQL_TASK_INTO_USAGE = O.with_views("""
SELECT u.tie AS usage_id, u.job_id, u.task_index, u.start_time,
       r.priority, r.scheduling_class, r.req_cpus, r.req_memory, r.different_machines,
       r.tie AS matched_event_id
FROM uej u ASOF LEFT JOIN tej_last r
  ON u.job_id = r.job_id AND u.task_index = r.task_index AND u.jt >= r.jt
""")


def _task_into_usage(strategy):
    def q(spark, sf):
        out = enrich.insert_task_in_usage(V.task_usage(spark, sf), V.task_events(spark, sf),
                                          strategy=strategy, match_column="matched_event_id")
        return out.select(
            F.col("tie").alias("usage_id"),
            F.col("task_info.job.id").alias("job_id"), F.col("task_info.task_index").alias("task_index"),
            "start_time",
            F.col("task_info.priority").alias("priority"),
            F.col("task_info.scheduling_class").alias("scheduling_class"),
            F.col("task_info.requested_resources.cpus").alias("req_cpus"),
            F.col("task_info.requested_resources.memory").alias("req_memory"),
            F.col("task_info.different_machines").alias("different_machines"),
            "matched_event_id")
    return q


register("asof_task_into_usage", SQL_TASK_INTO_USAGE)(_task_into_usage("window"))
register("asof_task_into_usage_bucketed", SQL_TASK_INTO_USAGE)(_task_into_usage("bucketed"))
register("asof_task_into_usage_broadcast", SQL_TASK_INTO_USAGE)(_task_into_usage("broadcast"))

SQL_MACHINE_INTO_USAGE = O.with_views("""
SELECT u.tie AS usage_id, u.machine_id, u.start_time, m.cap_cpus, m.cap_memory, m.platform_id
FROM uej u ASOF LEFT JOIN me_last m ON u.machine_id = m.machine_id AND u.jt >= m.time
""")


def _machine_into_usage(strategy):
    def q(spark, sf):
        out = enrich.insert_machine_in_usage(V.task_usage(spark, sf), V.machine_events(spark, sf),
                                             strategy=strategy)
        return out.select(F.col("tie").alias("usage_id"), F.col("machine_info.id").alias("machine_id"),
                          "start_time", F.col("machine_info.capacity.cpus").alias("cap_cpus"),
                          F.col("machine_info.capacity.memory").alias("cap_memory"),
                          F.col("machine_info.platform_id").alias("platform_id"))
    return q


register("asof_machine_into_usage_broadcast", SQL_MACHINE_INTO_USAGE)(_machine_into_usage("broadcast"))
register("asof_machine_into_usage_window", SQL_MACHINE_INTO_USAGE)(_machine_into_usage("window"))
register("asof_machine_into_usage_bucketed", SQL_MACHINE_INTO_USAGE)(_machine_into_usage("bucketed"))
register("asof_machine_into_usage_auto", SQL_MACHINE_INTO_USAGE)(_machine_into_usage("auto"))


SQL_MACHINE_INTO_TASK = O.with_views("""
SELECT t.tie AS event_id, t.machine_id, t.time, t.type,
  CASE WHEN t.machine_id IS NULL OR t.machine_id = 0 THEN NULL ELSE m.cap_cpus END AS cap_cpus,
  CASE WHEN t.machine_id IS NULL OR t.machine_id = 0 THEN NULL ELSE m.cap_memory END AS cap_memory,
  CASE WHEN t.machine_id IS NULL OR t.machine_id = 0 THEN NULL ELSE m.platform_id END AS platform_id
FROM tej t ASOF LEFT JOIN me_last m ON t.machine_id = m.machine_id AND t.jt >= m.time
""")


def _machine_into_task(strategy):
    def q(spark, sf):
        out = enrich.insert_machine_in_task(V.task_events(spark, sf), V.machine_events(spark, sf),
                                            strategy=strategy)
        return out.select(F.col("tie").alias("event_id"), F.col("machine_info.id").alias("machine_id"),
                          "time", "type", F.col("machine_info.capacity.cpus").alias("cap_cpus"),
                          F.col("machine_info.capacity.memory").alias("cap_memory"),
                          F.col("machine_info.platform_id").alias("platform_id"))
    return q


register("asof_machine_into_task", SQL_MACHINE_INTO_TASK)(_machine_into_task("broadcast"))
register("asof_machine_into_task_bucketed", SQL_MACHINE_INTO_TASK)(_machine_into_task("bucketed"))

SQL_JOB_INTO_TASK = O.with_views("""
SELECT t.tie AS event_id, t.job_id, t.task_index, t.time, t.type,
  j.name AS job_name, j.logical_name AS job_logical_name, j."user" AS job_user,
  j.scheduling_class AS job_scheduling_class, j.tie AS matched_job_event_id
FROM tej t ASOF LEFT JOIN jej_last j ON t.job_id = j.job_id AND t.jt >= j.jt
""")


def _job_into_task(strategy):
    def q(spark, sf):
        out = enrich.insert_job_in_task(V.task_events(spark, sf), V.job_events(spark, sf),
                                        strategy=strategy, match_column="matched_job_event_id")
        return out.select(F.col("tie").alias("event_id"), F.col("info.job.id").alias("job_id"),
                          F.col("info.task_index").alias("task_index"), "time", "type",
                          F.col("info.job.name").alias("job_name"),
                          F.col("info.job.logical_name").alias("job_logical_name"),
                          F.col("info.job.user").alias("job_user"),
                          F.col("info.job.scheduling_class").alias("job_scheduling_class"),
                          "matched_job_event_id")
    return q


register("asof_job_into_task", SQL_JOB_INTO_TASK)(_job_into_task("window"))
register("asof_job_into_task_bucketed", SQL_JOB_INTO_TASK)(_job_into_task("bucketed"))


@register("asof_job_into_job_utilization", chain_sql("ju", """
SELECT ju.job_id, ju.end_time,
  coalesce(j.name, ju.job_name) AS job_name, coalesce(j.logical_name, ju.job_logical_name) AS job_logical_name,
  coalesce(j."user", ju.job_user) AS job_user,
  coalesce(j.scheduling_class, ju.job_scheduling_class) AS job_scheduling_class,
  j.tie AS matched_job_event_id
FROM ju ASOF LEFT JOIN jej_last j ON ju.job_id = j.job_id AND ju.end_time >= j.jt
"""))
def q_job_into_job_util(spark, sf):
    ju = stages(spark, sf).job_utils
    out = enrich.insert_job_in_job_utilization(ju, V.job_events(spark, sf), match_column="matched_job_event_id")
    return out.select(F.col("job_info.id").alias("job_id"), "end_time",
                      F.col("job_info.name").alias("job_name"),
                      F.col("job_info.logical_name").alias("job_logical_name"),
                      F.col("job_info.user").alias("job_user"),
                      F.col("job_info.scheduling_class").alias("job_scheduling_class"),
                      "matched_job_event_id")


SQL_NEXT_DEATH = O.with_views("""
SELECT u.tie AS usage_id, u.job_id, u.task_index, u.start_time,
  d.tie AS death_id, d.time AS death_time, d.type AS death_type
FROM ue u ASOF LEFT JOIN (
  SELECT * FROM te WHERE type IN (2, 3, 4, 5, 6)
  QUALIFY row_number() OVER (PARTITION BY job_id, task_index, time ORDER BY tie) = 1) d
  ON u.job_id = d.job_id AND u.task_index = d.task_index AND u.start_time <= d.time
""")


def _next_death(strategy):
    def q(spark, sf):
        uwa = enrich.combine_usage(V.task_usage(spark, sf))
        out = enrich.attach_next_death(uwa, V.task_events(spark, sf), strategy=strategy)
        return out.select(F.col("tie").alias("usage_id"), F.col("usage.task_info.job.id").alias("job_id"),
                          F.col("usage.task_info.task_index").alias("task_index"),
                          F.col("usage.start_time").alias("start_time"),
                          F.col("next_death_tie").alias("death_id"),
                          F.col("next_death.time").alias("death_time"),
                          F.col("next_death.type").alias("death_type"))
    return q


register("next_death", SQL_NEXT_DEATH)(_next_death("window"))
register("next_death_bucketed", SQL_NEXT_DEATH)(_next_death("bucketed"))
register("next_death_broadcast", SQL_NEXT_DEATH)(_next_death("broadcast"))

CARRY_LAST = V.TRACE_HORIZON // S.TIME_PERIOD


@register("carry_partition", O.with_views(f"""
SELECT period, job_id, task_index, tie AS event_id, time, false AS is_carry FROM tp
UNION ALL
SELECT c.period, c.job_id, c.task_index, c.tie AS event_id, t.time, true AS is_carry
FROM (SELECT unnest(range(period + 1, coalesce(nxt, {CARRY_LAST}) + 1)) AS period, job_id, task_index, tie
      FROM (SELECT *, lead(period) OVER (PARTITION BY job_id, task_index ORDER BY period) AS nxt
            FROM (SELECT job_id, task_index, period, arg_max(tie, (jt, tie)) AS tie
                  FROM tp GROUP BY job_id, task_index, period))) c
JOIN tej t ON t.tie = c.tie
""", ("tp", f"SELECT *, least(jt // {S.TIME_PERIOD}, {V.TRACE_HORIZON // S.TIME_PERIOD}) AS period FROM tej")))
def q_carry_partition(spark, sf):
    te = V.task_events(spark, sf).withColumn("__jt", event_join_time())
    out = asof.carry_partition(
        te.select(F.col("info.job.id").alias("job_id"), F.col("info.task_index").alias("task_index"),
                  "time", "tie", "__jt"),
        keys=["job_id", "task_index"], time=F.col("__jt"), period=S.TIME_PERIOD,
        max_time=V.TRACE_HORIZON, ties=["tie"])
    return out.select("period", "job_id", "task_index", F.col("tie").alias("event_id"), "time", "is_carry")


# ---------------------------------------------------------------------------
# Task events: consolidation, marking, samples
# ---------------------------------------------------------------------------

@register("task_consolidation", chain_sql("agg", "SELECT * FROM agg"))
def q_task_consolidation(spark, sf):
    a = tasks.consolidate_task_events(V.task_events(spark, sf))
    return a.select("job_id", "task_index",
                    *[F.get(F.col("num_events_by_type"), i).alias(f"n{i}") for i in range(9)],
                    "final_event", "first_submit_time", "first_schedule_time", "last_deschedule_time",
                    "last_deschedule_time_actual", "num_missing", "num_missing_actual", "num_events")


@register("mark_tasks", chain_sql("mte", f"""
SELECT tie AS event_id, job_id, task_index, type, time, {C.MARK_COLS} FROM mte"""))
def q_mark_tasks(spark, sf):
    m = tasks.mark_tasks(V.task_events(spark, sf))
    return m.select(F.col("tie").alias("event_id"), F.col("info.job.id").alias("job_id"),
                    F.col("info.task_index").alias("task_index"), "type", "time", *_mark_cols("info."))


@register("mark_tasks_twice", chain_sql("mte", f"""
SELECT tie AS event_id, job_id, task_index, type, time, {C.MARK_COLS} FROM mte"""))
def q_mark_tasks_twice(spark, sf):
    """Marking is idempotent: marking the marked events changes nothing."""
    m = tasks.mark_tasks(tasks.mark_tasks(V.task_events(spark, sf)))
    return m.select(F.col("tie").alias("event_id"), F.col("info.job.id").alias("job_id"),
                    F.col("info.task_index").alias("task_index"), "type", "time", *_mark_cols("info."))


SQL_FIRST_EVENTS = """SELECT * FROM te
QUALIFY row_number() OVER (PARTITION BY job_id, task_index ORDER BY time, tie) = 1"""


@register("task_samples_per_job", O.with_views("""
SELECT job_id, task_index, priority, scheduling_class, req_cpus, req_memory, different_machines FROM fe
""", ("fe", SQL_FIRST_EVENTS)))
def q_task_samples_per_job(spark, sf):
    x = tasks.task_samples(V.task_events(spark, sf)).select("job_id", F.col("info").alias("i"))
    return x.select("job_id", F.col("i.task_index").alias("task_index"), F.col("i.priority").alias("priority"),
                    F.col("i.scheduling_class").alias("scheduling_class"),
                    F.col("i.requested_resources.cpus").alias("req_cpus"),
                    F.col("i.requested_resources.memory").alias("req_memory"),
                    F.col("i.different_machines").alias("different_machines"))


@register("mark_job_utilization", chain_sql("ju", """
SELECT ju.job_id, ju.num_tasks, s.num_samples, s.samples_num_missing, s.samples_num_events,
       s.first_sample_task_index, s.first_sample_priority
FROM ju JOIN (
  SELECT job_id, count(*) AS num_samples, CAST(sum(coalesce(num_missing, 0)) AS BIGINT) AS samples_num_missing,
         CAST(sum(coalesce(num_events, 0)) AS BIGINT) AS samples_num_events,
         min(task_index) AS first_sample_task_index,
         arg_min_null(priority, task_index) AS first_sample_priority
  FROM (SELECT * FROM tjm QUALIFY row_number() OVER (PARTITION BY job_id, task_index ORDER BY time, tie) = 1)
  GROUP BY job_id) s USING (job_id)
"""))
def q_mark_job_utilization(spark, sf):
    st = stages(spark, sf)
    m = tasks.mark_job_utilization(st.job_utils, st.tasks_with_jobs_and_machines)
    first = F.get(F.col("task_samples"), 0)
    return m.select(F.col("job_info.id").alias("job_id"), "num_tasks", "num_samples", "samples_num_missing",
                    "samples_num_events", first.getField("task_index").alias("first_sample_task_index"),
                    first.getField("priority").alias("first_sample_priority"))


# ---------------------------------------------------------------------------
# Percentiles and utilisation
# ---------------------------------------------------------------------------

@register("weighted_percentiles", O.with_views(
    "SELECT * FROM " + C.wp_sql("wl", ["job_id", "task_index", "measure"], TP),
    ("wl", " UNION ALL ".join(
        f"SELECT job_id, task_index, '{m}' AS measure, coalesce({m}, 0) AS v, end_time - start_time AS w FROM ue"
        for m in ("max_cpus", "max_memory", "cpus", "memory")))))
def q_weighted_percentiles(spark, sf):
    u = V.task_usage(spark, sf)
    long = percentile.unpivot_measures(
        u, [F.col("task_info.job.id").alias("job_id"), F.col("task_info.task_index").alias("task_index")],
        {"max_cpus": F.coalesce(F.col("max_resources.cpus"), F.lit(0.0)),
         "max_memory": F.coalesce(F.col("max_resources.memory"), F.lit(0.0)),
         "cpus": F.coalesce(F.col("resources.cpus"), F.lit(0.0)),
         "memory": F.coalesce(F.col("resources.memory"), F.lit(0.0))},
        F.col("end_time") - F.col("start_time"))
    return percentile.weighted_percentiles(long, ["job_id", "task_index", "measure"], TP)


@register("task_utilization", chain_sql("tu", "SELECT * FROM tu"))
def q_task_utilization(spark, sf):
    return task_utils_flat(stages(spark, sf).task_utils)


@register("job_utilization", chain_sql("ju", "SELECT * FROM ju"))
def q_job_utilization(spark, sf):
    return job_utils_flat(stages(spark, sf).job_utils)


@register("job_utilization_direct", chain_sql("ju", "SELECT * FROM ju"))
def q_job_utilization_direct(spark, sf):
    return job_utils_flat(utilization.job_utilizations_direct(stages(spark, sf).usage_with_jobs_and_machines))


def _some_unset(usage: DataFrame) -> DataFrame:
    """Every third job id and every fifth task index (0 included) is unset."""
    job, idx = F.col("task_info.job.id"), F.col("task_info.task_index")
    return usage.withColumn("task_info", F.col("task_info").withField("job.id", F.when(job % 3 != 0, job))
                            .withField("task_index", F.when(idx % 5 != 0, idx)))


_UNSET = ("us", "SELECT * REPLACE (CASE WHEN job_id % 3 = 0 THEN 0 ELSE job_id END AS job_id, "
          "CASE WHEN task_index % 5 = 0 THEN 0 ELSE task_index END AS task_index) FROM uf")
_UNSET_TASKS = ("ut", """SELECT job_id, task_index, min(start_time) AS start_time, max(end_time) AS end_time,
  CAST(sum(end_time - start_time) AS BIGINT) AS running_time,
  min(coalesce(req_cpus, 0)) FILTER (WHERE task_tie IS NOT NULL) AS min_req_cpus,
  max(coalesce(req_memory, 0)) FILTER (WHERE task_tie IS NOT NULL) AS max_req_memory
FROM us GROUP BY job_id, task_index HAVING count_if(task_tie IS NOT NULL) > 0""")


def _unset_sql(body: str) -> str:
    return O.with_views(body, *C.chain_upto("uf"), _UNSET, _UNSET_TASKS)


@register("task_utilization_unset_keys", _unset_sql(
    "SELECT t.*, p.v AS mean_cpus_max FROM ut t JOIN (SELECT job_id, task_index, max(coalesce(cpus, 0)) AS v "
    "FROM us GROUP BY job_id, task_index) p USING (job_id, task_index)"))
def q_task_utilization_unset_keys(spark, sf):
    """Records without a job id or task index count for id or index 0, like the reference's unset fields."""
    tu = utilization.task_utilizations(_some_unset(stages(spark, sf).usage_with_jobs_and_machines))
    last = F.element_at("percentile_mean_task_usage", -1)
    return tu.select(F.coalesce("info.job.id", F.lit(0)).alias("job_id"), F.coalesce("info.task_index", F.lit(0)).alias("task_index"),
                     "start_time", "end_time", "running_time", F.col("min_request.cpus").alias("min_req_cpus"),
                     F.col("max_request.memory").alias("max_req_memory"), last.getField("cpus").alias("mean_cpus_max"))


@register("job_utilization_unset_keys", _unset_sql("""
SELECT job_id, CAST(count(*) AS INTEGER) AS num_tasks, min(start_time) AS start_time, max(end_time) AS end_time,
  CAST(sum(running_time) AS BIGINT) AS running_time FROM ut GROUP BY job_id"""))
def q_job_utilization_unset_keys(spark, sf):
    tu = utilization.task_utilizations(_some_unset(stages(spark, sf).usage_with_jobs_and_machines))
    return utilization.job_utilizations(tu).select(F.coalesce("job_info.id", F.lit(0)).alias("job_id"), "num_tasks",
                                                   "start_time", "end_time", "running_time")


# ---------------------------------------------------------------------------
# Usage with summaries, machines, priorities
# ---------------------------------------------------------------------------

@register("combine_usage", chain_sql("cu", """
SELECT tie AS usage_id, job_id, task_index, task_start_time, task_running_time,
       job_num_tasks, job_start_time, job_end_time FROM cu"""))
def q_combine_usage(spark, sf):
    st = stages(spark, sf)
    return _combined_flat(enrich.combine_usage(st.usage_with_jobs_and_machines, st.task_utils, st.job_utils))


def _combined_flat(cu: DataFrame) -> DataFrame:
    return cu.select(F.col("tie").alias("usage_id"), F.col("usage.task_info.job.id").alias("job_id"),
                     F.col("usage.task_info.task_index").alias("task_index"),
                     F.col("task.start_time").alias("task_start_time"),
                     F.col("task.running_time").alias("task_running_time"),
                     F.col("job.num_tasks").alias("job_num_tasks"),
                     F.col("job.start_time").alias("job_start_time"),
                     F.col("job.end_time").alias("job_end_time"))


@register("combine_usage_by_task", ORACLE["combine_usage"])
def q_combine_usage_by_task(spark, sf):
    """The same over usage and task summaries stored by task: their buckets meet without a shuffle."""
    st = stages(spark, sf)
    base = scratch_path(spark, "by-task")
    stored = [store.read_by_task(spark, kind, store.write_by_task(df, kind, f"{base}/{kind}", 16))
              for kind, df in (("task_usage", st.usage_with_jobs_and_machines), ("task_utilization", st.task_utils))]
    return _combined_flat(enrich.combine_usage(*stored, st.job_utils))


@register("usage_with_next_death", chain_sql("cud", """
SELECT tie AS usage_id, job_id, task_index, start_time, death_id, death_time, death_req_cpus, death_req_memory
FROM cud"""))
def q_usage_with_next_death(spark, sf):
    uwa = stages(spark, sf).usage_with_avg
    return uwa.select(F.col("tie").alias("usage_id"), F.col("usage.task_info.job.id").alias("job_id"),
                      F.col("usage.task_info.task_index").alias("task_index"),
                      F.col("usage.start_time").alias("start_time"),
                      F.col("next_death_tie").alias("death_id"), F.col("next_death.time").alias("death_time"),
                      F.col("next_death.info.requested_resources.cpus").alias("death_req_cpus"),
                      F.col("next_death.info.requested_resources.memory").alias("death_req_memory"))


def _machine_sql(src: str, bucket: str, with_info: bool) -> str:
    info = ""
    if with_info:
        info = """, arg_min_null(cap_cpus, (start_time, end_time, tie)) AS cap_cpus,
  arg_min_null(platform_id, (start_time, end_time, tie)) AS platform_id"""
    return f"""
SELECT machine_id, bucket, min(s) AS start_time, max(e) AS end_time, CAST(sum(n) AS BIGINT) AS num_components,
  sum(cpu_time) / CAST(300000000 AS DOUBLE) AS cpus, sum(mem) AS memory{info.replace('(start_time, end_time, tie)', 'fo')}
FROM (
  SELECT machine_id, {bucket} AS bucket, job_id, task_index, min(start_time) AS s, max(end_time) AS e,
    count(*) AS n, sum(coalesce(cpus, 0) * (end_time - start_time)) AS cpu_time,
    arg_max(coalesce(memory, 0), (start_time, end_time, tie)) AS mem,
    min((start_time, end_time, tie)) AS fo{info}
  FROM {src} GROUP BY machine_id, bucket, job_id, task_index)
GROUP BY machine_id, bucket"""


def _machine_flat(b: DataFrame, with_info: bool) -> DataFrame:
    cols = ["machine_id", "bucket", "start_time", "end_time", "num_components",
            F.col("resources.cpus").alias("cpus"), F.col("resources.memory").alias("memory")]
    if with_info:
        cols += [F.col("info.capacity.cpus").alias("cap_cpus"), F.col("info.platform_id").alias("platform_id")]
    return b.select(*cols)


@register("machine_usage_5min", chain_sql("cu", _machine_sql("cu", "start_time // 300000000", True)))
def q_machine_usage_5min(spark, sf):
    return _machine_flat(stages(spark, sf).usage_by_machine, True)


@register("machine_usage_daily", chain_sql(
    "cu", _machine_sql("cu", "(start_time % 86400000000) // 300000000", True)))
def q_machine_usage_daily(spark, sf):
    return _machine_flat(stages(spark, sf).usage_by_machine_daily, True)


@register("machine_usage_bare", O.with_views(_machine_sql("ue", "start_time // 300000000", False)))
def q_machine_usage_bare(spark, sf):
    return _machine_flat(machine.usage_by_machine(V.task_usage(spark, sf)), False)


@register("machine_breakdown", chain_sql("cu", """
SELECT machine_id, bucket,
  sum(cpu_time) / CAST(300000000 AS DOUBLE) AS used_cpus, coalesce(arg_min_null(cap_cpus, fo), 0) AS capacity_cpus,
  sum(l.req_cpu) AS reserved_cpus, coalesce(sum(l.req_cpu) FILTER (WHERE l.prio > 8), 0) AS reserved_high_cpus,
  coalesce(sum(l.cpu) FILTER (WHERE l.prio > 8), 0) AS used_high_cpus,
  sum(l.mem) AS used_memory, coalesce(arg_min_null(cap_memory, fo), 0) AS capacity_memory,
  sum(l.req_mem) AS reserved_memory, coalesce(sum(l.req_mem) FILTER (WHERE l.prio > 8), 0) AS reserved_high_memory,
  coalesce(sum(l.mem) FILTER (WHERE l.prio > 8), 0) AS used_high_memory
FROM (
  SELECT machine_id, start_time // 300000000 AS bucket, job_id, task_index,
    sum(coalesce(cpus, 0) * (end_time - start_time)) AS cpu_time,
    arg_max({'mem': coalesce(memory, 0), 'cpu': coalesce(cpus, 0), 'req_cpu': coalesce(req_cpus, 0),
             'req_mem': coalesce(req_memory, 0), 'prio': coalesce(priority, 0)},
            (start_time, end_time, tie)) AS l,
    min((start_time, end_time, tie)) AS fo,
    arg_min_null(cap_cpus, (start_time, end_time, tie)) AS cap_cpus,
    arg_min_null(cap_memory, (start_time, end_time, tie)) AS cap_memory
  FROM cu GROUP BY machine_id, bucket, job_id, task_index)
GROUP BY machine_id, bucket"""))
def q_machine_breakdown(spark, sf):
    return machine.machine_breakdown(stages(spark, sf).machine_cells).drop("summary_cpus", "summary_memory")


SERIES_SQL_MEASURES = {
    "cpu_usage": "coalesce(cpus, 0)",
    "mem_usage": "coalesce(memory, 0)",
    "cpu_reservation": "coalesce(death_req_cpus, 0)",
    "mem_reservation": "coalesce(death_req_memory, 0)",
}
SQL_PRIORITY_MEANS = "SELECT machine_id, start_time // 300000000 AS bucket, coalesce(task_priority, -1) AS priority, " + \
    ", ".join(f"CASE WHEN sum(end_time - start_time) = 0 THEN NULL ELSE "
              f"sum((end_time - start_time) * {e}) / CAST(sum(end_time - start_time) AS DOUBLE) END AS {m}"
              for m, e in SERIES_SQL_MEASURES.items()) + \
    " FROM cud GROUP BY machine_id, start_time // 300000000, coalesce(task_priority, -1)"


@register("priority_mean", chain_sql("cud", SQL_PRIORITY_MEANS))
def q_priority_mean(spark, sf):
    return series.priority_means(stages(spark, sf).usage_with_avg)


def _series_cols(measures) -> str:
    return ", ".join(
        f"coalesce(sum({m}) FILTER (WHERE priority = {p}), 0) AS {m}_{series.prio_label(p)}"
        for m in measures for p in S.SERIES_PRIORITIES)


@register("priority_series", chain_sql("cud", f"""
SELECT bucket, {_series_cols(SERIES_SQL_MEASURES)} FROM ({SQL_PRIORITY_MEANS}) GROUP BY bucket"""))
def q_priority_series(spark, sf):
    return series.priority_series(stages(spark, sf).usage_with_avg)


def _one_series(measure):
    def q(spark, sf):
        s = series.priority_series(stages(spark, sf).usage_with_avg)
        return s.select("bucket", *[f"{measure}_{series.prio_label(p)}" for p in S.SERIES_PRIORITIES])
    return q


for _m in SERIES_SQL_MEASURES:
    register(f"priority_series_{_m}", chain_sql("cud", f"""
SELECT bucket, {_series_cols([_m])} FROM ({SQL_PRIORITY_MEANS}) GROUP BY bucket"""))(_one_series(_m))


_TEXT_SERIES = {"cpu_usage": "cpu_usage", "mem_usage": "mem_usage", "cpu_reservation": "cpu_reservation", "mem_reservation": "mem_reservation"}


@register("priority_series_text", chain_sql("cud", " UNION ALL ".join(
    f"SELECT '{name}' AS series, bucket, {', '.join(f'coalesce(sum({col}) FILTER (WHERE priority = {p}), 0) AS v{p + 1}' for p in range(-1, 12))} "
    f"FROM ({SQL_PRIORITY_MEANS}) GROUP BY bucket" for name, col in _TEXT_SERIES.items())))
def q_priority_series_text(spark, sf):
    """The four series as text files (``bucket v-1 ... v11`` lines), read back into numbers."""
    s = series.priority_series(stages(spark, sf).usage_with_avg)
    base = scratch_path(spark, "series")
    paths = series.write_priority_series(cut(s, "series"), base)
    word = F.split("value", " ")
    parts = [spark.read.text(p).select(F.lit(m).alias("series"), word[0].cast("bigint").alias("bucket"),
                                       *[word[i + 1].cast("double").alias(f"v{i}") for i in range(13)])
             for m, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# Samples, bands, features, machine configs
# ---------------------------------------------------------------------------

MACHINE_RATE, JOB_RATE = 2, 3


@register("sample_machines_usage", O.with_views(
    f"SELECT tie AS usage_id, machine_id FROM ue WHERE coalesce(machine_id, 0) % {MACHINE_RATE} = 0"))
def q_sample_machines_usage(spark, sf):
    u = sample.sample_machines_from_usage(MACHINE_RATE, V.task_usage(spark, sf))
    return u.select(F.col("tie").alias("usage_id"), F.col("machine_info.id").alias("machine_id"))


@register("sample_machines_tasks", O.with_views(
    f"SELECT tie AS event_id, machine_id FROM te WHERE machine_id IS NOT NULL AND machine_id % {MACHINE_RATE} = 0"))
def q_sample_machines_tasks(spark, sf):
    t = sample.sample_machines_from_tasks(MACHINE_RATE, V.task_events(spark, sf))
    return t.select(F.col("tie").alias("event_id"), F.col("machine_info.id").alias("machine_id"))


@register("sample_machines_machines", O.with_views(
    f"SELECT t1, t2, t3, t4, t5, machine_id FROM me WHERE machine_id % {MACHINE_RATE} = 0"))
def q_sample_machines_machines(spark, sf):
    m = sample.sample_machines_from_machines(MACHINE_RATE, V.machine_events(spark, sf))
    return m.select(*[F.col(f"tie.{c}").alias(f"t{i + 1}") for i, c in enumerate(
        ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))],
        F.col("info.id").alias("machine_id"))


@register("sample_jobs_tasks", O.with_views(
    f"SELECT tie AS event_id, job_id FROM te WHERE job_id % {JOB_RATE} = 0"))
def q_sample_jobs_tasks(spark, sf):
    t = sample.sample_jobs_from_tasks(JOB_RATE, V.task_events(spark, sf))
    return t.select(F.col("tie").alias("event_id"), F.col("info.job.id").alias("job_id"))


@register("sample_jobs_usage", O.with_views(
    f"SELECT tie AS usage_id, job_id FROM ue WHERE job_id % {JOB_RATE} = 0"))
def q_sample_jobs_usage(spark, sf):
    u = sample.sample_jobs_from_usage(JOB_RATE, V.task_usage(spark, sf))
    return u.select(F.col("tie").alias("usage_id"), F.col("task_info.job.id").alias("job_id"))


@register("sample_files_roundtrip", O.with_views(f"""
SELECT 'tasks' AS part, tie AS row_id FROM te WHERE machine_id IS NOT NULL AND machine_id % {MACHINE_RATE} = 0
UNION ALL SELECT 'usage', tie FROM ue WHERE coalesce(machine_id, 0) % {MACHINE_RATE} = 0
UNION ALL SELECT 'job-tasks', tie FROM te WHERE job_id % {JOB_RATE} = 0
UNION ALL SELECT 'job-usage', tie FROM ue WHERE job_id % {JOB_RATE} = 0"""))
def q_sample_files_roundtrip(spark, sf):
    te, tu = V.task_events(spark, sf), V.task_usage(spark, sf)
    base = scratch_path(spark, "samples")
    sample.write_machine_sample(base, MACHINE_RATE, te, tu)
    sample.write_job_sample(base, JOB_RATE, te, tu)
    mt, mu = sample.read_machine_sample(spark, base, MACHINE_RATE)
    jt, ju = sample.read_job_sample(spark, base, JOB_RATE)
    parts = [(n, d) for n, d in (("tasks", mt), ("usage", mu), ("job-tasks", jt), ("job-usage", ju))]
    out = None
    for n, d in parts:
        x = d.select(F.lit(n).alias("part"), F.col("tie").alias("row_id"))
        out = x if out is None else out.unionByName(x)
    return out


SQL_BANDS = {
    "subminute": f"end_time - start_time <= {S.MINUTE}",
    "minute": f"end_time - start_time > {S.MINUTE}",
    "hour": f"end_time - start_time > {S.HOUR}",
    "day": f"end_time - start_time > {S.DAY}",
    "subhour": f"end_time - start_time <= {S.HOUR}",
    "subday": f"end_time - start_time <= {S.DAY}",
    "multitask": "num_tasks > 1",
}


@register("job_bands", chain_sql("ju", "\nUNION ALL ".join(
    f"SELECT '{b}' AS band, job_id, end_time - start_time AS duration, num_tasks FROM ju WHERE {c}"
    for b, c in SQL_BANDS.items())))
def q_job_bands(spark, sf):
    return export.job_band_membership(stages(spark, sf).job_utils)


def _features_sql() -> str:
    cols = ["ju.job_id", "job_name AS name", "job_logical_name AS logical_name", "job_user AS \"user\""]
    num = [("scheduling_class", "coalesce(job_scheduling_class, 0)"),
           ("priority", "coalesce(s.fs_priority, 0)"),
           ("different_machines", "CASE WHEN coalesce(s.fs_dm, false) THEN 0 ELSE 1 END"),
           ("start_time", "start_time"), ("end_time", "end_time"), ("duration", "end_time - start_time"),
           ("running_time", "running_time"), ("num_tasks", "num_tasks"),
           ("min_req_cpus", "coalesce(min_req_cpus, 0)"), ("min_req_memory", "coalesce(min_req_memory, 0)"),
           ("max_req_cpus", "coalesce(max_req_cpus, 0)"), ("max_req_memory", "coalesce(max_req_memory, 0)")]
    for u, up in enumerate(TP):
        for p, jp in enumerate(JP):
            prefix = f"t{export.percent_label(jp)}_pt{export.percent_label(up)}"
            for (m, a), n in zip(MEASURE_ALIASES, export.PERCENTILE_VALUE_NAMES):
                num.append((f"{prefix}_{n}", f"coalesce({a}_{u}_{p}, 0)"))
    num += [(f"num_{n}", f"coalesce(nebt{i}, 0)") for i, n in enumerate(export.EVENT_COLUMN_NAMES)]
    num += [(f"num_final_{n}", f"coalesce(ntf{i}, 0)") for i, n in enumerate(export.EVENT_COLUMN_NAMES)]
    num += [("num_missing", "s.samples_num_missing"), ("num_events", "s.samples_num_events")]
    cols += [f"CAST({e} AS DOUBLE) AS {n}" for n, e in num]
    cols.append("coalesce(s.fs_dm, false) AS requires_different_machines")
    return f"""
SELECT {', '.join(cols)}
FROM ju JOIN (
  SELECT job_id, CAST(sum(coalesce(num_missing, 0)) AS BIGINT) AS samples_num_missing,
         CAST(sum(coalesce(num_events, 0)) AS BIGINT) AS samples_num_events,
         arg_min_null(priority, task_index) AS fs_priority, arg_min_null(different_machines, task_index) AS fs_dm
  FROM (SELECT * FROM tjm QUALIFY row_number() OVER (PARTITION BY job_id, task_index ORDER BY time, tie) = 1)
  GROUP BY job_id) s USING (job_id)"""


@register("job_features", chain_sql("ju", _features_sql()))
def q_job_features(spark, sf):
    st = stages(spark, sf)
    return export.job_features(tasks.mark_job_utilization(st.job_utils, st.tasks_with_jobs_and_machines))


@register("machine_latest_config", O.with_views("""
SELECT machine_id, substring(coalesce(platform_id, ''), 1, 1) AS platform, coalesce(cap_cpus, 0) AS cpu,
       coalesce(cap_memory, 0) AS memory
FROM me WHERE up
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY time DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC, t5 DESC) = 1
"""))
def q_machine_latest_config(spark, sf):
    return machine.machine_configs(V.machine_events(spark, sf))


@register("machine_tie_order", O.with_views("""
SELECT machine_id, max(time) AS time, true AS same FROM me WHERE up GROUP BY machine_id"""))
def q_machine_tie_order(spark, sf):
    """Without a tie column, as in real traces: the latest machine and the machine that the
    as-of join finds at that same time are the same record."""
    up = V.machine_events(spark, sf).drop("tie").where(F.col("up"))
    latest = machine.latest_up_machines(up)
    found = asof.asof_join(
        latest, up, left_keys=["machine_id"], right_keys=[F.col("info.id")], left_time=F.col("time"), right_time=F.col("time"),
        ties=tie_columns(up, ("time",)), strategy="bucketed", right_payload=["info"], merge=lambda r: {"found": r.getField("info")})
    return found.select("machine_id", "time", F.col("found").eqNullSafe(F.col("info")).alias("same"))


# ---------------------------------------------------------------------------
# Sources and sinks (S1-S12) and the pipelines
# ---------------------------------------------------------------------------

def _raw_te_sql() -> str:
    return """
SELECT DISTINCT CAST(time AS VARCHAR) AS c0, CAST(missing_type AS VARCHAR) AS c1, CAST(job_id AS VARCHAR) AS c2,
  CAST(task_index AS VARCHAR) AS c3, CAST(machine_id AS VARCHAR) AS c4, CAST(type AS VARCHAR) AS c5,
  CAST(NULL AS VARCHAR) AS c6, CAST(scheduling_class AS VARCHAR) AS c7, CAST(priority AS VARCHAR) AS c8,
  CAST(req_cpus AS VARCHAR) AS c9, CAST(req_memory AS VARCHAR) AS c10, CAST(NULL AS VARCHAR) AS c11,
  CASE WHEN different_machines THEN '1' ELSE '0' END AS c12
FROM te"""


@register("dedupe_raw", O.with_views(_raw_te_sql()))
def q_dedupe_raw(spark, sf):
    """Every line written twice, read through the de-duplicating raw reader."""
    src = V.task_events(spark, sf)
    path = scratch_path(spark, "csv-doubled")
    ingest.write_raw(src.unionByName(src), "task_event", path)
    raw = ingest.read_raw(spark, path, "task_event", pattern="part-*")
    return raw.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in raw.columns])


def _roundtrip(spark, sf, kind: str) -> DataFrame:
    src = V.VIEWS[kind](spark, sf)
    path = scratch_path(spark, f"csv-{kind}")
    ingest.write_raw(src, kind, path)
    return ingest.read_trace(spark, path, kind, pattern="part-*")


@register("ingest_task_usage", O.with_views("""
SELECT start_time, end_time, job_id, task_index, machine_id, cpus, memory, max_cpus, max_memory FROM ue"""))
def q_ingest_task_usage(spark, sf):
    return _task_usage_flat(_roundtrip(spark, sf, "task_usage"))


def _task_usage_flat(u: DataFrame, *more) -> DataFrame:
    return u.select("start_time", "end_time", F.col("task_info.job.id").alias("job_id"),
                    F.col("task_info.task_index").alias("task_index"), F.col("machine_info.id").alias("machine_id"),
                    F.col("resources.cpus").alias("cpus"), F.col("resources.memory").alias("memory"),
                    F.col("max_resources.cpus").alias("max_cpus"), F.col("max_resources.memory").alias("max_memory"), *more)


@register("ingest_task_event", O.with_views("""
SELECT time, missing_type, job_id, task_index, machine_id, type, scheduling_class, priority,
       req_cpus, req_memory, different_machines FROM te"""))
def q_ingest_task_event(spark, sf):
    return _task_event_flat(_roundtrip(spark, sf, "task_event"))


def _task_event_flat(t: DataFrame, *more) -> DataFrame:
    return t.select("time", "missing_type", F.col("info.job.id").alias("job_id"),
                    F.col("info.task_index").alias("task_index"), F.col("machine_info.id").alias("machine_id"),
                    "type", F.col("info.scheduling_class").alias("scheduling_class"),
                    F.col("info.priority").alias("priority"),
                    F.col("info.requested_resources.cpus").alias("req_cpus"),
                    F.col("info.requested_resources.memory").alias("req_memory"),
                    F.col("info.different_machines").alias("different_machines"), *more)


@register("ingest_job_event", O.with_views("""
SELECT time, type, job_id, name, logical_name, "user", scheduling_class FROM je"""))
def q_ingest_job_event(spark, sf):
    return _job_event_flat(_roundtrip(spark, sf, "job_event"))


def _job_event_flat(j: DataFrame) -> DataFrame:
    return j.select("time", "type", F.col("info.id").alias("job_id"), F.col("info.name").alias("name"),
                    F.col("info.logical_name").alias("logical_name"), F.col("info.user").alias("user"),
                    F.col("info.scheduling_class").alias("scheduling_class"))


@register("ingest_machine_event", O.with_views("""
SELECT time, up, machine_id, platform_id, cap_cpus, cap_memory FROM me"""))
def q_ingest_machine_event(spark, sf):
    return _machine_event_flat(_roundtrip(spark, sf, "machine_event"))


def _machine_event_flat(m: DataFrame) -> DataFrame:
    return m.select("time", "up", F.col("info.id").alias("machine_id"), F.col("info.platform_id").alias("platform_id"),
                    F.col("info.capacity.cpus").alias("cap_cpus"), F.col("info.capacity.memory").alias("cap_memory"))


@register("store_roundtrip", O.with_views("""
SELECT tie AS usage_id, start_time, end_time, job_id, task_index, machine_id, cpus, memory FROM ue"""))
def q_store_roundtrip(spark, sf):
    path = scratch_path(spark, "store")
    store.write_table(V.task_usage(spark, sf), "task_usage", path, partitions=4)
    u = store.read_table(spark, "task_usage", path)
    return u.select(F.col("tie").alias("usage_id"), "start_time", "end_time",
                    F.col("task_info.job.id").alias("job_id"), F.col("task_info.task_index").alias("task_index"),
                    F.col("machine_info.id").alias("machine_id"), F.col("resources.cpus").alias("cpus"),
                    F.col("resources.memory").alias("memory"))


def _contents(spark, paths: dict[str, str], sums: dict[str, tuple[str, str]], flat: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Per stored output its rows, two sums over its content and the digest of its flat
    columns; text outputs sum the bucket and count the values of their lines."""
    out = None
    for name, p in paths.items():
        if name in series.SERIES_FILES:
            word = F.split("value", " ")
            x = spark.read.text(p).select("value", word[0].cast("bigint").alias("a"), F.size(word).cast("bigint").alias("b"))
            first, second = "a", "b"
        else:
            x, (first, second) = spark.read.parquet(p), sums[name]
        digest = content_digest(flat[name](x)).select("digest")
        x = x.agg(F.count(F.lit(1)).alias("n_rows"), F.expr(f"sum({first})").cast("bigint").alias("sum_1"),
                  F.expr(f"sum({second})").cast("bigint").alias("sum_2")).select(F.lit(name).alias("output"), "n_rows", "sum_1", "sum_2")
        x = x.withColumn("on", F.lit(1)).join(digest.withColumn("on", F.lit(1)), "on").drop("on")  # one row each
        out = x if out is None else out.unionByName(x)
    return out


def _contents_sql(rows: list[tuple[str, str, str, str, str]]) -> str:
    def texts(cols: str) -> str:
        return ", ".join(f"coalesce(length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in cols.split("; "))

    def half(begin: int) -> str:
        return f"coalesce(CAST(sum(CAST('0x' || substr(row_md5, {begin}, 15) AS BIGINT)) AS VARCHAR), '0')"

    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS output, count(*) AS n_rows, CAST(sum({a}) AS BIGINT) AS sum_1, CAST(sum({b}) AS BIGINT) AS sum_2, "
        f"{half(1)} || '-' || {half(16)} AS digest FROM (SELECT *, md5(concat_ws(',', {texts(cols)})) AS row_md5 FROM {src})"
        for name, src, a, b, cols in rows)


def _set(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END"


def _millionths(c: str) -> str:
    return f"CAST(round({c} * 1000000) AS BIGINT)"


_TE = ("time; missing_type; job_id; task_index; machine_id; type; scheduling_class; priority; "
       "req_cpus; req_memory; different_machines")
_UE = "start_time; end_time; job_id; task_index; machine_id; cpus; memory; max_cpus; max_memory"
# marks that the order of equal times cannot change
_MARKS = "; ".join(f"n{i}" for i in range(9)) + "; first_submit_time; first_schedule_time; last_deschedule_time; num_missing; num_events"
_JOB_SET, _CAP_SET = _set("job_user"), _set("cap_cpus")


@register("import_pipeline", chain_sql("uf", _contents_sql([
    ("tasks", "te", "time", _set("req_memory"), _TE), ("usage", "ue", "start_time", _set("memory"), _UE),
    ("jobs", "je", "time", _set("logical_name"), 'time; type; job_id; name; logical_name; "user"; scheduling_class'),
    ("machines", "me", "time", "CASE WHEN up THEN 1 ELSE 0 END", "time; up; machine_id; platform_id; cap_cpus; cap_memory"),
    ("tasks_marked", "mte", "num_events", "coalesce(first_submit_time, 0)", f"{_TE}; {_MARKS}"),
    ("tasks_with_jobs", "tj", "time", _set("job_user"), f"{_TE}; {_MARKS}; {_JOB_SET}"),
    ("tasks_with_jobs_and_machines", "tjm", "num_events", _set("cap_cpus"), f"{_TE}; {_MARKS}; {_JOB_SET}; {_CAP_SET}"),
    ("usage_with_machines", "um", "start_time", _set("cap_cpus"), f"{_UE}; {_CAP_SET}"),
    ("usage_with_jobs_and_machines", "uf", "end_time", "coalesce(num_events, 0)", f"{_UE}; {_CAP_SET}; {_MARKS}; {_JOB_SET}")])))
def q_import_pipeline(spark, sf):
    """CSV (derived from the driver tables, without a tie column) -> import pipeline ->
    rows, content sums and digests per stored table: all columns of the imported tables; of
    the joined ones all that the order of equal times cannot change (each row's own columns,
    its marks, and whether it found a match)."""
    raw = {}
    for kind in ("task_event", "task_usage", "job_event", "machine_event"):
        p = scratch_path(spark, f"raw-{kind}")
        ingest.write_raw(V.VIEWS[kind](spark, sf), kind, p)
        raw[kind] = p
    paths = pipelines.import_trace(spark, raw, scratch_path(spark, "import"), pattern="part-*")
    capacity = "machine_info.capacity.cpus"

    def marks(info: str) -> list[Column]:
        return [F.get(F.col(f"{info}.num_events_by_type"), i).alias(f"n{i}") for i in range(9)] + [
            F.col(f"{info}.{c}") for c in ("first_submit_time", "first_schedule_time", "last_deschedule_time", "num_missing", "num_events")]

    def found(c: str, name: str) -> Column:
        return F.col(c).isNotNull().cast("int").alias(name)

    user, cap = found("info.job.user", "has_job"), found(capacity, "has_machine")
    return _contents(spark, paths, {
        "tasks": ("time", _set("info.requested_resources.memory")), "usage": ("start_time", _set("resources.memory")),
        "jobs": ("time", _set("info.logical_name")), "machines": ("time", "CASE WHEN up THEN 1 ELSE 0 END"),
        "tasks_marked": ("info.num_events", "coalesce(info.first_submit_time, 0)"),
        "tasks_with_jobs": ("time", _set("info.job.user")),
        "tasks_with_jobs_and_machines": ("info.num_events", _set(capacity)),
        "usage_with_machines": ("start_time", _set(capacity)),
        "usage_with_jobs_and_machines": ("end_time", "coalesce(task_info.num_events, 0)")}, {
        "tasks": _task_event_flat, "usage": _task_usage_flat, "jobs": _job_event_flat, "machines": _machine_event_flat,
        "tasks_marked": lambda t: _task_event_flat(t, *marks("info")),
        "tasks_with_jobs": lambda t: _task_event_flat(t, *marks("info"), user),
        "tasks_with_jobs_and_machines": lambda t: _task_event_flat(t, *marks("info"), user, cap),
        "usage_with_machines": lambda u: _task_usage_flat(u, cap),
        "usage_with_jobs_and_machines": lambda u: _task_usage_flat(u, cap, *marks("task_info"), found("task_info.job.user", "has_job"))})


_MEASURE_COLS = "; ".join(f"{a}_{i}" for a in ("ptu_cpus", "ptu_memory", "pmtu_cpus", "pmtu_memory") for i in range(6))
_JOB_MEASURE_COLS = "; ".join(f"{a}_{u}_{p}" for u in range(6) for p in range(6) for a in ("ptu_cpus", "ptu_memory", "pmtu_cpus", "pmtu_memory"))
_FINAL = "; final_event; first_submit_time; first_schedule_time; last_deschedule_time; num_missing; num_events"
_TU = ("job_id; task_index; start_time; end_time; running_time; min_req_cpus; min_req_memory; max_req_cpus; max_req_memory; "
       "priority; scheduling_class; different_machines; " + "; ".join(f"n{i}" for i in range(9)) + _FINAL
       + "; job_name; job_logical_name; job_user; job_scheduling_class; " + _MEASURE_COLS)
_JU = ("job_id; job_name; job_logical_name; job_user; job_scheduling_class; first_priority; first_different_machines; "
       "first_num_missing; first_num_events; num_tasks; " + "; ".join([f"ntf{i}" for i in range(9)] + [f"nebt{i}" for i in range(9)])
       + "; min_req_cpus; min_req_memory; max_req_cpus; max_req_memory; running_time; start_time; end_time; " + _JOB_MEASURE_COLS)
_CUD = ("tie; job_id; task_index; machine_id; start_time; end_time; cpus; memory; max_cpus; max_memory; priority; platform_id; cap_cpus; "
        "task_start_time; task_running_time; job_num_tasks; job_start_time; job_end_time; death_id; death_time; death_req_cpus; death_req_memory")
_MACHINE = f"machine_id; bucket; start_time; end_time; num_components; {_millionths('cpus')}; {_millionths('memory')}; cap_cpus; platform_id"


def _usage_with_avg_flat(u: DataFrame) -> DataFrame:
    return u.select("tie", "usage.task_info.job.id", "usage.task_info.task_index", F.col("usage.machine_info.id").alias("machine_id"),
                    "usage.start_time", "usage.end_time", F.col("usage.resources.cpus").alias("cpus"),
                    F.col("usage.resources.memory").alias("memory"), F.col("usage.max_resources.cpus").alias("max_cpus"),
                    F.col("usage.max_resources.memory").alias("max_memory"), "usage.task_info.priority",
                    "usage.machine_info.platform_id", F.col("usage.machine_info.capacity.cpus").alias("cap_cpus"),
                    F.col("task.start_time").alias("task_start_time"), "task.running_time", "job.num_tasks",
                    F.col("job.start_time").alias("job_start_time"), F.col("job.end_time").alias("job_end_time"),
                    "next_death_tie", F.col("next_death.time").alias("death_time"),
                    F.col("next_death.info.requested_resources.cpus").alias("death_cpus"),
                    F.col("next_death.info.requested_resources.memory").alias("death_memory"))


def _machine_digest_flat(b: DataFrame) -> DataFrame:
    f = _machine_flat(b, True)
    return f.select("machine_id", "bucket", "start_time", "end_time", "num_components",
                    F.expr(_millionths("cpus")).alias("cpus"), F.expr(_millionths("memory")).alias("memory"), "cap_cpus", "platform_id")


def _series_text_flat(t: DataFrame) -> DataFrame:
    word = F.split("value", " ")
    return t.select(word[0].alias("bucket"), *[F.round(word[i + 1].cast("double") * 1000000).cast("bigint").alias(f"v{i}") for i in range(13)])


_SERIES_TEXT_COLS = "bucket; " + "; ".join(_millionths(f"v{i}") for i in range(13))


def _series_text_sql(measure: str) -> str:
    values = ", ".join(f"coalesce(sum({measure}) FILTER (WHERE priority = {p}), 0) AS v{p + 1}" for p in range(-1, 12))
    return f"(SELECT bucket, bucket AS a, {values} FROM ({SQL_PRIORITY_MEANS}) GROUP BY bucket)"


@register("summaries_pipeline", chain_sql("cud", _contents_sql([
    ("task_utils", "tu", "running_time", "start_time", _TU), ("job_utils", "ju", "num_tasks", "end_time", _JU),
    ("usage_with_avg", "cud", "start_time", "end_time", _CUD),
    ("usage_by_machine", f"({_machine_sql('cud', 'start_time // 300000000', True)})", "start_time", "end_time", _MACHINE),
    ("usage_by_machine_daily", f"({_machine_sql('cud', '(start_time % 86400000000) // 300000000', True)})", "start_time", "end_time", _MACHINE),
    *[(m, _series_text_sql(m), "a", "14", _SERIES_TEXT_COLS)
      for m in ("cpu_usage", "mem_usage", "cpu_reservation", "mem_reservation")]])))
def q_summaries_pipeline(spark, sf):
    """Stored enriched tables -> summaries pipeline -> rows, content sums and the digest of
    all columns per output (sums of doubles in millionths, as the SQL adds them in any order)."""
    st = stages(spark, sf)
    base = scratch_path(spark, "summ")
    tp, up = f"{base}/tasks", f"{base}/usage"
    st.tasks_with_jobs_and_machines.write.parquet(tp)
    st.usage_with_jobs_and_machines.write.parquet(up)
    paths = pipelines.run_summaries(spark, tp, up, f"{base}/out")
    return _contents(spark, paths, {
        "task_utils": ("running_time", "start_time"), "job_utils": ("num_tasks", "end_time"),
        "usage_with_avg": ("usage.start_time", "usage.end_time"),
        "usage_by_machine": ("start_time", "end_time"), "usage_by_machine_daily": ("start_time", "end_time")}, {
        "task_utils": task_utils_flat, "job_utils": job_utils_flat, "usage_with_avg": _usage_with_avg_flat,
        "usage_by_machine": _machine_digest_flat, "usage_by_machine_daily": _machine_digest_flat,
        **dict.fromkeys(series.SERIES_FILES, _series_text_flat)})


@register("job_band_exports", chain_sql("ju", f"SELECT f.*, band FROM ({_features_sql()}) f JOIN (VALUES "
    + ", ".join(f"('{b}')" for b in SQL_BANDS) + ") names(band) ON CASE band "
    + " ".join(f"WHEN '{b}' THEN {c}" for b, c in SQL_BANDS.items()) + " END"))
def q_job_band_exports(spark, sf):
    """Every feature column of the seven band files, written and read back."""
    st = stages(spark, sf)
    paths = pipelines.export_jobs(spark, st.job_utils, st.tasks_with_jobs_and_machines,
                                  scratch_path(spark, "bands"))
    out = None
    for band, p in paths.items():
        x = spark.read.parquet(p).withColumn("band", F.lit(band))
        out = x if out is None else out.unionByName(x)
    return out


@register("machine_config_export", O.with_views("""
SELECT machine_id, substring(coalesce(platform_id, ''), 1, 1) AS platform, coalesce(cap_cpus, 0) AS cpu,
       coalesce(cap_memory, 0) AS memory
FROM me WHERE up
QUALIFY row_number() OVER (PARTITION BY machine_id ORDER BY time DESC, t1 DESC, t2 DESC, t3 DESC, t4 DESC, t5 DESC) = 1
"""))
def q_machine_config_export(spark, sf):
    """The machine configuration table written by the export and read back."""
    p = pipelines.export_machine_configs(V.machine_events(spark, sf), scratch_path(spark, "machines"))
    return spark.read.parquet(p)


_BREAKDOWN = [("used", "used"), ("capacity", "capacity"), ("reserved", "reserved"),
              ("reservedHigh", "reserved_high"), ("usedHigh", "used_high")]


@register("machine_breakdown_text", "SELECT machine_id, bucket, " + ", ".join(
    f"'{label}' AS {r}_label{i}, CAST(CAST({col}_{r} AS FLOAT) AS DOUBLE) AS {r}_value{i}"
    for r in ("cpus", "memory") for i, (label, col) in enumerate(_BREAKDOWN)) + f" FROM ({ORACLE['machine_breakdown']})")
def q_machine_breakdown_text(spark, sf):
    """The one-line usage summaries of each machine bucket: labels and numbers parsed
    back from the text."""
    b = machine.machine_breakdown(stages(spark, sf).machine_cells)
    out = []
    for r in ("cpus", "memory"):
        word = F.split(f"summary_{r}", " ")
        for i in range(5):
            out += [word[2 * i].alias(f"{r}_label{i}"), word[2 * i + 1].cast("float").cast("double").alias(f"{r}_value{i}")]
    return b.select("machine_id", "bucket", *out)


_COMPONENT_SQL = """SELECT machine_id, start_time // 300000000 AS bucket, tie AS usage_id, start_time, end_time, job_id, task_index, cpus, memory FROM {t}"""


def _components_flat(df):
    u = "usage."
    return df.select("machine_id", "bucket", F.col("tie").alias("usage_id"), f"{u}start_time", f"{u}end_time",
                     F.col(f"{u}task_info.job.id").alias("job_id"), F.col(f"{u}task_info.task_index").alias("task_index"),
                     F.col(f"{u}resources.cpus").alias("cpus"), F.col(f"{u}resources.memory").alias("memory"))


@register("machine_components", O.with_views(_COMPONENT_SQL.format(t="ue")))
def q_machine_components(spark, sf):
    """Records of every machine bucket, from bare usage, through the store."""
    path = store.write_table(machine.machine_components(V.task_usage(spark, sf)), "machine_component", scratch_path(spark, "components"))
    return _components_flat(store.read_table(spark, "machine_component", path))


@register("machine_components_with_avg", chain_sql("cu", _COMPONENT_SQL.format(t="cu")))
def q_machine_components_with_avg(spark, sf):
    """The same from usage with its summaries."""
    return _components_flat(machine.machine_components(stages(spark, sf).usage_with_avg_rows))
