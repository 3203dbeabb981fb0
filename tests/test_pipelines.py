"""Import and summaries pipelines on trace-named CSV files."""

import gzip
import os
import tempfile

from schedlens.plans import pipelines
from schedlens.sources import store


def _csv(d, name, lines, gz=False):
    os.makedirs(d, exist_ok=True)
    path = os.path.join(d, name)
    data = ("\n".join(lines) + "\n").encode()
    if gz:
        with gzip.open(path, "wb") as f:
            f.write(data)
    else:
        with open(path, "wb") as f:
            f.write(data)


def test_import_then_summaries(spark):
    base = tempfile.mkdtemp(prefix="schedlens-trace-")
    raw = {k: os.path.join(base, k) for k in ("task_event", "task_usage", "job_event", "machine_event")}
    # job 7: submitted at 0, scheduled at 10 on machine 3, finished at 900 s
    _csv(raw["task_event"], "part-00000-of-00002.csv", [
        "0,,7,0,,0,alice,2,9,0.5,0.25,,0",
        "10,,7,0,3,1,alice,2,9,0.5,0.25,,0",
    ])
    _csv(raw["task_event"], "part-00001-of-00002.csv.gz", ["900000000,,7,0,3,4,alice,2,9,0.5,0.25,,0"], gz=True)
    _csv(raw["job_event"], "part-00000-of-00001.csv", ["0,,7,0,alice,2,jobname,logical"])
    _csv(raw["machine_event"], "part-00000-of-00001.csv", ["0,3,0,platA,0.5,0.5"])
    _csv(raw["task_usage"], "part-00000-of-00001.csv", [
        "300000000,600000000,7,0,3,0.25,0.125,,,,0.25,,,0.5,,,,,",
        "600000000,900000000,7,0,3,0.125,0.125,,,,0.25,,,0.25,,,,,",
    ])
    out = os.path.join(base, "out")
    paths = pipelines.import_trace(spark, raw, out)
    assert store.read_table(spark, "task_event", paths["tasks"]).count() == 3
    usage = store.read_table(spark, "task_usage", paths["usage_with_jobs_and_machines"]).collect()
    assert len(usage) == 2
    for u in usage:
        assert u.task_info.priority == 9 and u.task_info.job.name == "jobname"
        assert u.task_info.num_events == 3 and u.task_info.final_event == 4
        assert u.machine_info.platform_id == "platA" and u.machine_info.capacity.cpus == 0.5

    summ = pipelines.run_summaries(spark, paths["tasks_with_jobs_and_machines"],
                                   paths["usage_with_jobs_and_machines"], os.path.join(base, "summ"))
    (job,) = spark.read.parquet(summ["job_utils"]).collect()
    assert job.num_tasks == 1 and job.num_tasks_final[4] == 1
    uwa = spark.read.parquet(summ["usage_with_avg"]).collect()
    assert all(r.next_death.time == 900000000 for r in uwa)
    lines = sorted(r.value for r in spark.read.text(summ["cpu_usage"]).collect())
    assert [ln.split()[0] for ln in lines] == ["1", "2"]
    assert len(lines[0].split()) == 14
