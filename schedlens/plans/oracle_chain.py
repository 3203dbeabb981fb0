"""DuckDB oracle CTE chain for the import and summaries pipelines (flat SQL).

Mirrors ``schedlens.plans.pipelines`` on the driver views: marking, the four
as-of denormalisations, task / job summaries, combined usage with next death.
"""

from __future__ import annotations

from schedlens.plans.oracle import JOB_PERCENTILES, TASK_PERCENTILES

N_TYPES = 9
DEATHS = "(2, 3, 4, 5, 6)"
NS = ", ".join(f"n{i}" for i in range(N_TYPES))
MARK_COLS = f"{NS}, final_event, first_submit_time, first_schedule_time, last_deschedule_time, num_missing, num_events"
JOB_COLS = "job_name, job_logical_name, job_user, job_scheduling_class"


def wp_sql(src: str, by: list[str], ps: list[float]) -> str:
    """Weighted percentiles of ``src(by..., v, w)`` -> ``(by..., pi, p, value)``."""
    b = ", ".join(by)
    picks = ",\n  ".join(
        f"arg_min(v, (cw, -v)) FILTER (WHERE CAST(cw AS FLOAT) >= "
        f"CAST(CAST(tw AS DOUBLE) * CAST({p!r} AS DOUBLE) AS FLOAT)) AS p{i}"
        for i, p in enumerate(ps))
    unions = "\nUNION ALL ".join(
        f"SELECT {b}, {i} AS pi, CAST({p!r} AS DOUBLE) AS p, coalesce(p{i}, mx) AS value FROM agg"
        for i, p in enumerate(ps))
    return f"""(
WITH pooled AS (SELECT {b}, v, CAST(sum(w) AS BIGINT) AS w FROM {src} GROUP BY {b}, v),
ranked AS (SELECT {b}, v,
  CAST(sum(w) OVER (PARTITION BY {b} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cw,
  CAST(sum(w) OVER (PARTITION BY {b}) AS BIGINT) AS tw FROM pooled),
agg AS (SELECT {b}, max(v) AS mx,
  {picks}
  FROM ranked GROUP BY {b})
{unions})"""


CHAIN = [
    ("agg", f"""
SELECT job_id, task_index,
  {", ".join(f"CAST(count_if(type = {i}) AS INTEGER) AS n{i}" for i in range(N_TYPES))},
  arg_max(type, (time, tie)) AS final_event,
  min(time) FILTER (WHERE type = 0) AS first_submit_time,
  min(time) FILTER (WHERE type = 1) AS first_schedule_time,
  min(time) FILTER (WHERE type IN {DEATHS}) AS last_deschedule_time,
  max(time) FILTER (WHERE type IN {DEATHS}) AS last_deschedule_time_actual,
  CAST(count(*) AS INTEGER) AS num_missing,
  CAST(count(missing_type) AS INTEGER) AS num_missing_actual,
  CAST(count(*) AS INTEGER) AS num_events
FROM te GROUP BY job_id, task_index"""),
    ("mte", f"SELECT tej.*, {', '.join('agg.' + c for c in MARK_COLS.split(', '))} "
            "FROM tej JOIN agg USING (job_id, task_index)"),
    ("tj", """
SELECT m.*, j.name AS job_name, j.logical_name AS job_logical_name, j."user" AS job_user,
       j.scheduling_class AS job_scheduling_class
FROM mte m ASOF LEFT JOIN jej_last j ON m.job_id = j.job_id AND m.jt >= j.jt"""),
    ("tjm", """
SELECT t.*,
  CASE WHEN t.machine_id IS NULL OR t.machine_id = 0 THEN NULL ELSE m.cap_cpus END AS cap_cpus,
  CASE WHEN t.machine_id IS NULL OR t.machine_id = 0 THEN NULL ELSE m.cap_memory END AS cap_memory,
  CASE WHEN t.machine_id IS NULL OR t.machine_id = 0 THEN NULL ELSE m.platform_id END AS platform_id
FROM tj t ASOF LEFT JOIN me_last m ON t.machine_id = m.machine_id AND t.jt >= m.time"""),
    ("tjm_last", """SELECT * FROM tjm
QUALIFY row_number() OVER (PARTITION BY job_id, task_index, jt ORDER BY tie DESC) = 1"""),
    ("um", """
SELECT u.*, m.cap_cpus, m.cap_memory, m.platform_id
FROM uej u ASOF LEFT JOIN me_last m ON u.machine_id = m.machine_id AND u.jt >= m.time"""),
    ("uf", f"""
SELECT u.*, r.priority, r.scheduling_class, r.req_cpus, r.req_memory, r.different_machines,
  {', '.join('r.' + c for c in MARK_COLS.split(', '))}, {', '.join('r.' + c for c in JOB_COLS.split(', '))},
  r.tie AS task_tie
FROM um u ASOF LEFT JOIN tjm_last r
  ON u.job_id = r.job_id AND u.task_index = r.task_index AND u.jt >= r.jt"""),
    # task summaries
    ("tu_first", """SELECT * FROM uf WHERE task_tie IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY job_id, task_index ORDER BY start_time, end_time, tie) = 1"""),
    ("tu_scalar", """
SELECT job_id, task_index, min(start_time) AS start_time, max(end_time) AS end_time,
  CAST(sum(end_time - start_time) AS BIGINT) AS running_time,
  min(coalesce(req_cpus, 0)) FILTER (WHERE task_tie IS NOT NULL) AS min_req_cpus,
  min(coalesce(req_memory, 0)) FILTER (WHERE task_tie IS NOT NULL) AS min_req_memory,
  max(coalesce(req_cpus, 0)) FILTER (WHERE task_tie IS NOT NULL) AS max_req_cpus,
  max(coalesce(req_memory, 0)) FILTER (WHERE task_tie IS NOT NULL) AS max_req_memory
FROM uf GROUP BY job_id, task_index HAVING count_if(task_tie IS NOT NULL) > 0"""),
    ("tu_long", """
SELECT job_id, task_index, 'max_cpus' AS measure, coalesce(max_cpus, 0) AS v, end_time - start_time AS w FROM uf
UNION ALL SELECT job_id, task_index, 'max_memory', coalesce(max_memory, 0), end_time - start_time FROM uf
UNION ALL SELECT job_id, task_index, 'cpus', coalesce(cpus, 0), end_time - start_time FROM uf
UNION ALL SELECT job_id, task_index, 'memory', coalesce(memory, 0), end_time - start_time FROM uf"""),
    ("tu_pct", "SELECT * FROM " + wp_sql("tu_long", ["job_id", "task_index", "measure"], TASK_PERCENTILES)),
    ("tu_wide", "SELECT job_id, task_index, " + ", ".join(
        f"max(value) FILTER (WHERE measure = '{m}' AND pi = {i}) AS {a}_{i}"
        for m, a in (("max_cpus", "ptu_cpus"), ("max_memory", "ptu_memory"), ("cpus", "pmtu_cpus"), ("memory", "pmtu_memory"))
        for i in range(len(TASK_PERCENTILES))) + " FROM tu_pct GROUP BY job_id, task_index"),
    ("tu", f"""
SELECT s.*, f.priority, f.scheduling_class, f.different_machines,
  {', '.join('f.' + c for c in MARK_COLS.split(', '))}, {', '.join('f.' + c for c in JOB_COLS.split(', '))},
  w.* EXCLUDE (job_id, task_index)
FROM tu_scalar s JOIN tu_first f USING (job_id, task_index) JOIN tu_wide w USING (job_id, task_index)"""),
    # job summaries
    ("ju_long", " UNION ALL ".join(
        f"SELECT job_id, {i} AS ui, '{m}' AS measure, coalesce({a}_{i}, 0) AS v, CAST(1 AS BIGINT) AS w FROM tu"
        for i in range(len(TASK_PERCENTILES))
        for m, a in (("max_cpus", "ptu_cpus"), ("max_memory", "ptu_memory"), ("cpus", "pmtu_cpus"), ("memory", "pmtu_memory")))),
    ("ju_pct", "SELECT * FROM " + wp_sql("ju_long", ["job_id", "ui", "measure"], JOB_PERCENTILES)),
    ("ju_scalar", f"""
SELECT job_id,
  arg_min_null(job_name, task_index) AS job_name, arg_min_null(job_logical_name, task_index) AS job_logical_name,
  arg_min_null(job_user, task_index) AS job_user, arg_min_null(job_scheduling_class, task_index) AS job_scheduling_class,
  arg_min_null(priority, task_index) AS first_priority,
  arg_min_null(different_machines, task_index) AS first_different_machines,
  arg_min_null(num_missing, task_index) AS first_num_missing, arg_min_null(num_events, task_index) AS first_num_events,
  CAST(count(DISTINCT task_index) AS INTEGER) AS num_tasks,
  {", ".join(f"CAST(count_if(coalesce(final_event, 0) = {i}) AS INTEGER) AS ntf{i}" for i in range(N_TYPES))},
  {", ".join(f"CAST(sum(coalesce(n{i}, 0)) AS INTEGER) AS nebt{i}" for i in range(N_TYPES))},
  min(coalesce(min_req_cpus, 0)) AS min_req_cpus, min(coalesce(min_req_memory, 0)) AS min_req_memory,
  max(coalesce(max_req_cpus, 0)) AS max_req_cpus, max(coalesce(max_req_memory, 0)) AS max_req_memory,
  CAST(sum(running_time) AS BIGINT) AS running_time, min(start_time) AS start_time, max(end_time) AS end_time
FROM tu GROUP BY job_id"""),
    ("ju_wide", "SELECT job_id, " + ", ".join(
        f"max(value) FILTER (WHERE measure = '{m}' AND ui = {u} AND pi = {p}) AS {a}_{u}_{p}"
        for u in range(len(TASK_PERCENTILES)) for p in range(len(JOB_PERCENTILES))
        for m, a in (("max_cpus", "ptu_cpus"), ("max_memory", "ptu_memory"), ("cpus", "pmtu_cpus"), ("memory", "pmtu_memory")))
        + " FROM ju_pct GROUP BY job_id"),
    ("ju", "SELECT s.*, w.* EXCLUDE (job_id) FROM ju_scalar s LEFT JOIN ju_wide w USING (job_id)"),
    # usage with its summaries and the next death
    ("cu", """
SELECT uf.*, tu.priority AS task_priority, tu.start_time AS task_start_time, tu.running_time AS task_running_time,
  ju.num_tasks AS job_num_tasks, ju.start_time AS job_start_time, ju.end_time AS job_end_time
FROM uf JOIN tu USING (job_id, task_index) JOIN ju USING (job_id)"""),
    ("deaths_first", f"""SELECT * FROM tjm WHERE type IN {DEATHS}
QUALIFY row_number() OVER (PARTITION BY job_id, task_index, time ORDER BY tie) = 1"""),
    ("cud", """
SELECT c.*, d.tie AS death_id, d.time AS death_time, d.req_cpus AS death_req_cpus, d.req_memory AS death_req_memory
FROM cu c ASOF LEFT JOIN deaths_first d
  ON c.job_id = d.job_id AND c.task_index = d.task_index AND c.start_time <= d.time"""),
]


def chain_upto(name: str) -> list[tuple[str, str]]:
    """CTEs of the chain up to and including ``name``."""
    out = []
    for n, sql in CHAIN:
        out.append((n, sql))
        if n == name:
            return out
    raise KeyError(name)
