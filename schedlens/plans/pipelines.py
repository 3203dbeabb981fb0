"""End-to-end pipelines: import (CSV -> denormalised tables), summaries, export.

Every stage that later stages read is written as a table under the output
folder and read back, so a lost executor only recomputes from the last
written stage (lineage is cut at each table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from schedlens.functions.digest import content_digest
from schedlens.operators import enrich, export, machine, series, tasks, utilization
from schedlens.session import apply_scale_settings, cut
from schedlens.sources import ingest, manifest, store


class TraceStages:
    """The import and summary stages over typed trace tables, built on demand.

    Each stage is computed once and written as a table (``materialize=True``)
    because later stages read it more than once; the plans of later stages then
    start from the stored stage.
    """

    def __init__(self, task_events: DataFrame, job_events: DataFrame, machine_events: DataFrame,
                 usage: DataFrame, *, task_join: str = "bucketed", job_join: str = "bucketed",
                 machine_join: str = "auto", materialize: bool = True):
        self.task_events, self.job_events = task_events, job_events
        self.machine_events, self.usage = machine_events, usage
        self.task_join, self.job_join, self.machine_join = task_join, job_join, machine_join
        self._materialize = materialize
        self._memo: dict[str, DataFrame] = {}

    def _stage(self, name: str, build) -> DataFrame:
        if name not in self._memo:
            df = build()
            self._memo[name] = cut(df, name) if self._materialize else df
        return self._memo[name]

    @property
    def tasks_marked(self) -> DataFrame:
        return self._stage("tasks_marked", lambda: tasks.mark_tasks(self.task_events))

    @property
    def tasks_with_jobs_and_machines(self) -> DataFrame:
        return self._stage("tasks_with_jobs_and_machines", lambda: enrich.insert_machine_in_task(
            enrich.insert_job_in_task(self.tasks_marked, self.job_events, strategy=self.job_join),
            self.machine_events, strategy=self.machine_join))

    @property
    def usage_with_machines(self) -> DataFrame:
        return self._stage("usage_with_machines", lambda: enrich.insert_machine_in_usage(
            self.usage, self.machine_events, strategy=self.machine_join))

    @property
    def usage_with_jobs_and_machines(self) -> DataFrame:
        return self._stage("usage_with_jobs_and_machines", lambda: enrich.insert_task_in_usage(
            self.usage_with_machines, self.tasks_with_jobs_and_machines, strategy=self.task_join))

    @property
    def task_utils(self) -> DataFrame:
        return self._stage("task_utils", lambda: utilization.task_utilizations(self.usage_with_jobs_and_machines))

    @property
    def job_utils(self) -> DataFrame:
        return self._stage("job_utils", lambda: utilization.job_utilizations(self.task_utils))

    @property
    def usage_with_avg(self) -> DataFrame:
        return self._stage("usage_with_avg", lambda: self.usage_with_avg_rows)

    @property
    def usage_with_avg_rows(self) -> DataFrame:
        """The rows of ``usage_with_avg``, not stored unless it is already: a reader of few
        columns does not widen every row with both summaries and write them."""
        if "usage_with_avg" in self._memo:
            return self._memo["usage_with_avg"]
        if "usage_with_avg_rows" not in self._memo:
            self._memo["usage_with_avg_rows"] = usage_with_avg(
                self.usage_with_jobs_and_machines, self.tasks_with_jobs_and_machines,
                self.task_utils, self.job_utils, self.task_join)
        return self._memo["usage_with_avg_rows"]

    @property
    def machine_cells(self) -> DataFrame:
        return self._stage("machine_cells", lambda: machine.machine_task_cells(self.usage_with_avg_rows))

    @property
    def usage_by_machine(self) -> DataFrame:
        return machine.usage_by_machine(self.machine_cells)

    @property
    def usage_by_machine_daily(self) -> DataFrame:
        return machine.usage_by_machine(self.machine_cells, daily=True)


def usage_with_avg(usage: DataFrame, task_events: DataFrame, task_utils: DataFrame, job_utils: DataFrame,
                   strategy: str = "bucketed") -> DataFrame:
    """Usage with its next death and summaries. The death join shuffles the narrow
    usage rows; the wide summaries are joined last."""
    deaths = enrich.attach_next_death(enrich.combine_usage(usage), task_events, strategy=strategy)
    return enrich.attach_summaries(deaths, task_utils, job_utils)


def _stored(spark: SparkSession, kind: str, path: str, build, stage: str, inputs: list[str], resume: bool) -> tuple[DataFrame, str]:
    """Write a stage's table and read it back. With ``resume`` a finished table that was made
    from the same inputs is kept, and its digest is returned for the stages after it."""
    if not resume:
        store.write_table(build(), kind, path)
        return store.read_table(spark, kind, path), ""
    source = manifest.made_from(stage, *inputs)
    digest = manifest.digest_of(spark, path, source)
    if digest is None:
        manifest.start(spark, path, source)
        store.write_table(build(), kind, path)
        digest = manifest.finish(spark, path, source, store.read_table(spark, kind, path))
    return store.read_table(spark, kind, path), digest


def import_trace(spark: SparkSession, raw_dirs: dict[str, str], out_dir: str,
                 pattern: str = ingest.TRACE_GLOB, input_bytes: int | None = None, resume: bool = False) -> dict[str, str]:
    """Read the four raw tables, store them, then store each enriched stage.

    ``raw_dirs`` maps ``task_event``, ``task_usage``, ``job_event``,
    ``machine_event`` to CSV folders; ``input_bytes`` sizes the session's shuffles
    for them. With ``resume`` every stage leaves a manifest (one more scan of its table),
    and a rerun makes only the stages that are unfinished or whose inputs changed.
    Returns the written paths.
    """
    if input_bytes:
        apply_scale_settings(spark, input_bytes)
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}
    tables: dict[str, DataFrame] = {}
    digests: dict[str, str] = {}

    def stage(name: str, kind: str, inputs: list[str], build) -> None:
        paths[name] = f"{out}/{name}"
        tables[name], digests[name] = _stored(spark, kind, paths[name], build, name, inputs, resume)

    for kind, name in (("task_event", "tasks"), ("task_usage", "usage"), ("job_event", "jobs"), ("machine_event", "machines")):
        files = [manifest.files_digest(spark, raw_dirs[kind], pattern)] if resume else []
        stage(name, kind, files, lambda: ingest.read_trace(spark, raw_dirs[kind], kind, pattern))
    for name, kind, left, right, build in (
            ("tasks_marked", "task_event", "tasks", None, tasks.mark_tasks),
            ("tasks_with_jobs", "task_event", "tasks_marked", "jobs", enrich.insert_job_in_task),
            ("tasks_with_jobs_and_machines", "task_event", "tasks_with_jobs", "machines", enrich.insert_machine_in_task),
            ("usage_with_machines", "task_usage", "usage", "machines", enrich.insert_machine_in_usage),
            ("usage_with_jobs_and_machines", "task_usage", "usage_with_machines", "tasks_with_jobs_and_machines",
             enrich.insert_task_in_usage)):
        names = [n for n in (left, right) if n]
        stage(name, kind, [digests[n] for n in names], lambda: build(*[tables[n] for n in names]))
    return paths


def run_summaries(spark: SparkSession, tasks_path: str, usage_path: str, out_dir: str,
                  input_bytes: int | None = None, resume: bool = False) -> dict[str, str]:
    """Compute and store the summaries plus the four priority series.

    Task and job summaries and the joined usage are written once and read back
    by every later stage (machine tables, series). ``input_bytes`` sizes the
    session's shuffles for the stored usage. ``resume`` as in :func:`import_trace`: inputs
    without a manifest are digested first."""
    if input_bytes:
        apply_scale_settings(spark, input_bytes)
    out = out_dir.rstrip("/")
    ev = store.read_table(spark, "task_event", tasks_path)
    usage = store.read_table(spark, "task_usage", usage_path)
    paths: dict[str, str] = {}

    def known(path: str, df: DataFrame) -> str:
        return (manifest.digest_of(spark, path) or content_digest(df).first().digest) if resume else ""

    def stage(name: str, kind: str, folder: str, inputs: list[str], build) -> tuple[DataFrame, str]:
        paths[name] = f"{out}/{folder}"
        return _stored(spark, kind, paths[name], build, name, inputs, resume)

    d_ev, d_usage = known(tasks_path, ev), known(usage_path, usage)
    task_utils, d_tu = stage("task_utils", "task_utilization", "task_utils", [d_usage],
                             lambda: utilization.task_utilizations(usage))
    job_utils, d_ju = stage("job_utils", "job_utilization", "job_utils_with_tasks", [d_tu],
                            lambda: utilization.job_utilizations(task_utils))
    uwa, d_uwa = stage("usage_with_avg", "task_usage_with_avg", "task_usage_w_avg", [d_usage, d_ev, d_tu, d_ju],
                       lambda: usage_with_avg(usage, ev, task_utils, job_utils))
    memo: list[DataFrame] = []

    def cells() -> DataFrame:  # one pass over usage for both machine tables
        if not memo:
            memo.append(cut(machine.machine_task_cells(uwa), "machine-cells"))
        return memo[0]

    for name, daily in (("usage_by_machine", False), ("usage_by_machine_daily", True)):
        stage(name, "usage_by_machine", "usage_by_machine_w_avg" + ("_daily" if daily else ""), [d_uwa],
              lambda: machine.usage_by_machine(cells(), daily=daily))
    # one aggregation, read back by the four text files
    source, mark = manifest.made_from("series", d_uwa), f"{out}/series"
    if not resume or manifest.digest_of(spark, mark, source) is None:
        if resume:
            manifest.start(spark, mark, source)
        rows = cut(series.priority_series(uwa), "series")
        paths.update(series.write_priority_series(rows, out))
        if resume:
            manifest.finish(spark, mark, source, rows)
    else:
        paths.update(series.series_paths(out))
    return paths


def export_jobs(spark: SparkSession, job_utils: DataFrame, task_events: DataFrame, out_dir: str) -> dict[str, str]:
    """Mark job summaries with their task samples and write the feature table
    for each of the seven duration bands (Parquet, one distributed write)."""
    return export.write_band_features(tasks.mark_job_utilization(job_utils, task_events), out_dir)


def export_machine_configs(machine_events: DataFrame, path: str) -> str:
    machine.machine_configs(machine_events).write.mode("overwrite").parquet(path)
    return path
