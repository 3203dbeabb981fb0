"""Benchmark: headline operators at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Each operator runs over whole tables into Spark's ``noop`` sink (the full plan
executes, nothing is collected). Inputs an operator reads from earlier stages
are materialised once beforehand, so each timing is that operator alone.
Reported per query: median of ``$BENCH_RUNS`` warm runs (after one warm-up).
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from schedlens.operators import enrich, export, machine, series, tasks, utilization  # noqa: E402
from schedlens.plans import pipelines  # noqa: E402
from schedlens.session import local_session  # noqa: E402
from schedlens.session import scratch_path  # noqa: E402
from schedlens.sources import driver_views as V  # noqa: E402
from schedlens.sources import ingest  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, runs: int) -> float:
    fn()  # warm-up: JVM code generation, file listing
    ts = []
    for _ in range(runs):
        t0 = time.perf_counter()
        fn()
        ts.append(time.perf_counter() - t0)
    return round(statistics.median(ts), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, max(8, cpus))

    te, tu, je, me = (V.task_events(spark, sf_dir), V.task_usage(spark, sf_dir),
                      V.job_events(spark, sf_dir), V.machine_events(spark, sf_dir))
    st = pipelines.TraceStages(te, je, me, tu)
    uf = st.usage_with_jobs_and_machines
    tutils = st.task_utils
    uwa = st.usage_with_avg
    jutils, wide = st.job_utils, st.usage_with_jobs_and_machines
    marked = tasks.mark_job_utilization(jutils, st.tasks_with_jobs_and_machines)
    csv = ingest.write_raw(tu, "task_usage", scratch_path(spark, "bench-csv"))

    q = {
        "import_usage_csv": lambda: run(ingest.read_trace(spark, csv, "task_usage", pattern="part-*")),
        "mark_tasks": lambda: run(tasks.mark_tasks(te)),
        "combine_usage": lambda: run(enrich.combine_usage(wide, tutils, jutils)),
        "job_features": lambda: run(export.job_features(marked)),
        "machine_components": lambda: run(machine.machine_components(uwa)),
        "asof_task_usage_window": lambda: run(enrich.insert_task_in_usage(tu, te, strategy="window")),
        "asof_task_usage_bucketed": lambda: run(enrich.insert_task_in_usage(tu, te, strategy="bucketed")),
        "asof_machine_usage_broadcast": lambda: run(enrich.insert_machine_in_usage(tu, me, strategy="broadcast")),
        "asof_machine_usage_window": lambda: run(enrich.insert_machine_in_usage(tu, me, strategy="window")),
        "asof_machine_usage_bucketed": lambda: run(enrich.insert_machine_in_usage(tu, me, strategy="bucketed")),
        "next_death": lambda: run(enrich.attach_next_death(enrich.combine_usage(tu), te)),
        "task_utilization": lambda: run(utilization.task_utilizations(uf)),
        "job_utilization": lambda: run(utilization.job_utilizations(tutils)),
        "machine_5min": lambda: run(machine.usage_by_machine(uwa)),
        "machine_daily": lambda: run(machine.usage_by_machine(uwa, daily=True)),
        "priority_series": lambda: run(series.priority_series(uwa)),
    }
    results = {name: timed(fn, runs) for name, fn in q.items()}

    # End to end: views -> marking -> four as-of joins -> five summaries + series,
    # every stage written to the shared folder (one cold run, then warm runs).
    def full():
        s = pipelines.TraceStages(te, je, me, tu)
        run(s.usage_by_machine)
        run(s.usage_by_machine_daily)
        run(series.priority_series(s.usage_with_avg))
        run(s.job_utils)
    results["full_pipeline"] = timed(full, max(1, runs - 2))

    headline = [k for k in results if k != "full_pipeline"]
    out = {
        "metric": "sum_of_operator_medians",
        "value": round(sum(results[k] for k in headline), 3),
        "unit": "sec",
        "queries": results,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus,
        "runs": runs,
        "spark": spark.version,
        "rows": {"task_usage": tu.count(), "task_events": te.count(),
                 "job_events": je.count(), "machine_events": me.count()},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
