"""DuckDB SQL building blocks for the independent oracle.

The same views as ``schedlens.sources.driver_views``, written flat in SQL,
plus the join-time columns (``jt``). Each query's oracle is a ``WITH`` chain
over these CTEs, so every oracle is a self-contained statement over the
driver's pre-registered tables.
"""

from __future__ import annotations

D128 = "CAST(128 AS DOUBLE)"
D64 = "CAST(64 AS DOUBLE)"
US = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01'))"
LONG_MAX = 9223372036854775807

TASK_PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
JOB_PERCENTILES = [0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def sat_add(expr: str, off: int) -> str:
    return f"(CASE WHEN {expr} > {LONG_MAX - off} THEN {LONG_MAX} ELSE {expr} + {off} END)"


BASE_VIEWS = {
    "te": f"""
SELECT {US} // 10 AS time,
       CAST(CASE WHEN event_id % 11 = 0 THEN event_id % 3 END AS INTEGER) AS missing_type,
       CAST((event_id // 2) % 9 AS INTEGER) AS type,
       user_id // 10 + 1 AS job_id,
       CAST(user_id % 10 AS INTEGER) AS task_index,
       CASE WHEN (event_id // 2) % 9 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 0
            ELSE user_id % 4 + 1 END AS machine_id,
       CAST(user_id % 4 AS INTEGER) AS scheduling_class,
       CAST(CASE WHEN user_id % 13 = 12 THEN NULL ELSE user_id % 13 END AS INTEGER) AS priority,
       (event_id % 128) / {D128} AS req_cpus,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id % 64) / {D128} END AS req_memory,
       event_id % 5 = 0 AS different_machines,
       event_id AS tie
FROM events""",
    "ue": f"""
SELECT {US} // 10 AS start_time,
       {US} // 10 + (60 + event_id % 240) * 1000000 AS end_time,
       user_id // 10 + 1 AS job_id,
       CAST(user_id % 10 AS INTEGER) AS task_index,
       user_id % 4 + 1 AS machine_id,
       (event_id % 64) / {D128} AS cpus,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE (event_id % 96) / {D128} END AS memory,
       (event_id % 64) / {D128} + (event_id % 7) / {D128} AS max_cpus,
       (event_id % 96 + event_id % 5) / {D128} AS max_memory,
       event_id AS tie
FROM events""",
    "je": """
SELECT CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS BIGINT) * 108000000 AS time,
       CAST(NULL AS INTEGER) AS missing_type,
       CAST(o_orderkey % 9 AS INTEGER) AS type,
       o_custkey // 100 + 1 AS job_id,
       o_orderstatus AS name,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'L' || CAST(o_orderkey % 6 AS VARCHAR) END AS logical_name,
       o_orderpriority AS "user",
       CAST(o_orderkey % 4 AS INTEGER) AS scheduling_class,
       o_orderkey AS tie
FROM orders""",
    "me": f"""
SELECT CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS BIGINT) * 103000000 AS time,
       l_returnflag <> 'R' AS up,
       l_suppkey % 5 + 1 AS machine_id,
       l_quantity / {D64} AS cap_cpus,
       l_quantity / {D128} AS cap_memory,
       l_linestatus || l_returnflag AS platform_id,
       l_orderkey AS t1, l_partkey AS t2, l_suppkey AS t3, l_quantity AS t4, l_extendedprice AS t5
FROM lineitem""",
}

# Join times and the tie-reduced right sides used by ASOF joins (of equal
# (key, time) rows only the last tie can ever match a backward join).
DERIVED_VIEWS = {
    "tej": f"SELECT *, CASE WHEN type = 1 THEN {sat_add('time', 1)} ELSE time END AS jt FROM te",
    "uej": f"SELECT *, {sat_add('start_time', 1000000)} AS jt FROM ue",
    "jej": f"SELECT *, CASE WHEN type = 1 THEN {sat_add('time', 1)} ELSE time END AS jt FROM je",
    "tej_last": """SELECT * FROM tej
QUALIFY row_number() OVER (PARTITION BY job_id, task_index, jt ORDER BY tie DESC) = 1""",
    "jej_last": """SELECT * FROM jej
QUALIFY row_number() OVER (PARTITION BY job_id, jt ORDER BY tie DESC) = 1""",
    "me_last": """SELECT * FROM me
QUALIFY row_number() OVER (PARTITION BY machine_id, time
                           ORDER BY t1 DESC, t2 DESC, t3 DESC, t4 DESC, t5 DESC) = 1""",
}

ALL_VIEWS = {**BASE_VIEWS, **DERIVED_VIEWS}


def with_views(body: str, *extra: tuple[str, str]) -> str:
    """``WITH`` all the base views, the derived views and ``extra`` CTEs, then ``body``."""
    ctes = [f"{name} AS ({sql.strip()})" for name, sql in ALL_VIEWS.items()]
    ctes += [f"{name} AS ({sql.strip()})" for name, sql in extra]
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()
