"""Content digests, manifests and resumed pipelines."""

import os

import pytest
from pyspark.sql import functions as F

from schedlens.functions.digest import content_digest
from schedlens.plans import pipelines
from schedlens.session import scratch_path
from schedlens.sources import manifest, store

DDL = "a long, b string, s struct<x:double,y:struct<z:int,w:string>>, v array<struct<p:double,q:int>>, m map<string,int>, r binary"
ROW = (1, "t", (0.5, (None, "w")), [(0.25, None), None], {"k": 1, "l": 2}, b"\xff\x00")


def _digest(spark, rows, ddl=DDL):
    return tuple(content_digest(spark.createDataFrame(rows, ddl)).first())


def test_order_and_partitions_do_not_matter(spark):
    df = spark.range(5000).select("id", (F.col("id") / 7).alias("x"), F.col("id").cast("string").alias("t"))
    want = content_digest(df).first()
    assert want.n_rows == 5000
    for other in (df.repartition(13), df.orderBy(F.desc("x")), df.coalesce(1)):
        assert content_digest(other).first() == want


def test_repeated_rows_count_and_empty(spark):
    assert _digest(spark, []) == (0, "0-0")
    one, two = _digest(spark, [ROW]), _digest(spark, [ROW, ROW])
    assert (one[0], two[0]) == (1, 2)
    assert [2 * int(x) for x in one[1].split("-")] == [int(x) for x in two[1].split("-")]


@pytest.mark.parametrize("other", [
    (2, *ROW[1:]), (None, *ROW[1:]), (1, None, *ROW[2:]), (1, "", *ROW[2:]), (1, "t", None, *ROW[3:]),
    (1, "t", (0.5, None), *ROW[3:]), (1, "t", (0.5, (None, None)), *ROW[3:]), (1, "t", (0.5000000000000001, (None, "w")), *ROW[3:]),
    (*ROW[:3], [(0.25, None)], *ROW[4:]), (*ROW[:3], [None, (0.25, None)], *ROW[4:]), (*ROW[:3], [(0.25, 0), None], *ROW[4:]),
    (*ROW[:3], None, *ROW[4:]), (*ROW[:4], {"k": 2, "l": 1}, ROW[5]), (*ROW[:5], b"\xff"), (*ROW[:5], None)])
def test_any_leaf_changes_it(spark, other):
    assert _digest(spark, [other]) != _digest(spark, [ROW])


def test_values_do_not_run_into_each_other(spark):
    ddl = "a string, b string"
    rows = [("x,1:y", None), ("x", "1:y"), ("x,1:y,-", None), (None, "x"), ("x", None), ("-", "x"), ("", "")]
    assert len({_digest(spark, [r], ddl) for r in rows}) == len(rows)


def test_maps_in_any_order(spark):
    assert _digest(spark, [(*ROW[:4], {"l": 2, "k": 1}, ROW[5])]) == _digest(spark, [ROW])


def _lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def _raw(base):
    raw = {k: os.path.join(base, k) for k in ("task_event", "task_usage", "job_event", "machine_event")}
    _lines(raw["task_event"], "part-00000-of-00001.csv", [
        "0,,7,0,,0,alice,2,9,0.5,0.25,,0", "10,,7,0,3,1,alice,2,9,0.5,0.25,,0", "900000000,,7,0,3,4,alice,2,9,0.5,0.25,,0"])
    _lines(raw["job_event"], "part-00000-of-00001.csv", ["0,,7,0,alice,2,jobname,logical"])
    _lines(raw["machine_event"], "part-00000-of-00001.csv", ["0,3,0,platA,0.5,0.5"])
    _lines(raw["task_usage"], "part-00000-of-00001.csv", ["300000000,600000000,7,0,3,0.25,0.125,,,,0.25,,,0.5,,,,,"])
    return raw


def test_a_rerun_makes_only_what_changed(spark, monkeypatch):
    base = scratch_path(spark, "resume").removeprefix("file:")
    raw, out = _raw(base), f"{base}/out"
    made = []
    written = store.write_table
    monkeypatch.setattr(store, "write_table", lambda df, kind, path, **kw: (made.append(path.rsplit("/", 1)[1]), written(df, kind, path, **kw))[1])

    def run():
        made.clear()
        return pipelines.import_trace(spark, raw, out, resume=True)

    paths = run()
    everything = list(paths)
    assert made == everything and len(made) == 9
    assert run() == paths and made == []
    # a table whose writing was interrupted is made again; its content and so the later stages stay
    source = manifest.made_from("tasks_with_jobs", *[manifest.digest_of(spark, paths[n]) for n in ("tasks_marked", "jobs")])
    manifest.start(spark, paths["tasks_with_jobs"], source)
    run()
    assert made == ["tasks_with_jobs"]
    # another machine table: everything made from it, nothing else
    _lines(raw["machine_event"], "part-00000-of-00001.csv", ["0,3,0,platform-B,0.5,0.5"])
    run()
    assert made == ["machines", "tasks_with_jobs_and_machines", "usage_with_machines", "usage_with_jobs_and_machines"]
    (u,) = store.read_table(spark, "task_usage", paths["usage_with_jobs_and_machines"]).collect()
    assert u.machine_info.platform_id == "platform-B"

    def summaries():
        made.clear()
        return pipelines.run_summaries(spark, paths["tasks_with_jobs_and_machines"], paths["usage_with_jobs_and_machines"],
                                       f"{base}/summ", resume=True)

    first = summaries()
    assert len(made) == 5 and summaries() == first and made == []
    assert spark.read.text(first["cpu_usage"]).count() == 1
    # a stored table that was changed behind the manifest's back
    path = paths["jobs"]
    assert manifest.intact(spark, path, store.read_table(spark, "job_event", path))
    changed = store.read_table(spark, "job_event", path).withColumn("time", F.col("time") + 1)
    assert not manifest.intact(spark, path, changed)
