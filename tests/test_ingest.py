"""Trace CSV ingest and the Parquet store."""

import os
import tempfile

import pytest
from pyspark.errors import PySparkException
from py4j.protocol import Py4JJavaError

from schedlens import schemas as S
from schedlens.sources import ingest, store


def _write(d, name, lines):
    with open(os.path.join(d, name), "w") as f:
        f.write("\n".join(lines) + "\n")


def test_task_event_ingest_sentinel_dedupe_and_glob(spark):
    d = tempfile.mkdtemp(prefix="schedlens-csv-")
    line = "18446744073709551615,,7,3,,1,alice,2,9,0.5,0.25,,1"
    _write(d, "part-00000-of-00001.csv", [line, line, "10,2,7,4,5,0,,,,,,,0"])
    _write(d, "notes.csv", ["1,,1,1,,1,,,,,,,"])  # not a trace part file: ignored
    rows = sorted(ingest.read_trace(spark, d, "task_event").collect(), key=lambda r: r.time)
    assert len(rows) == 2
    a, b = rows
    assert a.time == 10 and a.missing_type == 2 and a.machine_info.id == 5
    assert b.time == S.LONG_MAX and b.machine_info is None
    assert b.info.job.user == "alice" and b.info.priority == 9
    assert b.info.requested_resources.cpus == 0.5 and b.info.different_machines is True
    assert a.info.requested_resources is not None  # present even with no field set


def test_required_field_rejected(spark):
    d = tempfile.mkdtemp(prefix="schedlens-csv-")
    _write(d, "part-00000-of-00001.csv", ["10,,,4,5,0,,,,,,,0"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest.read_trace(spark, d, "task_event").collect()


def test_machine_event_up_flag(spark):
    d = tempfile.mkdtemp(prefix="schedlens-csv-")
    _write(d, "part-00000-of-00001.csv", ["0,1,0,abc,0.5,0.25", "5,1,1,,,", "9,1,2,xyz,1,1"])
    rows = sorted(ingest.read_trace(spark, d, "machine_event").collect(), key=lambda r: r.time)
    assert [r.up for r in rows] == [True, False, True]
    assert rows[0].info.capacity.cpus == 0.5 and rows[0].info.platform_id == "abc"


def test_store_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="schedlens-store-")
    d = os.path.join(d, "jobs")
    df = ingest.convert(spark.createDataFrame([("1", "", "7", "0", "bob", "2", "n", "ln")],
                                              ingest.raw_schema("job_event")), "job_event")
    store.write_table(df, "job_event", d, partitions=2)
    back = store.read_table(spark, "job_event", d).collect()
    assert back == df.collect()


def test_short_line_rejected_even_when_few_columns_are_read(spark):
    d = tempfile.mkdtemp(prefix="schedlens-csv-")
    _write(d, "part-00000-of-00001.csv", ["1,2,3,4,5"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest.read_trace(spark, d, "task_usage").select("start_time").collect()
    _write(d, "part-00000-of-00001.csv", ["10,,,4,5,0,,,,,,,0"])
    with pytest.raises((PySparkException, Py4JJavaError)):
        ingest.read_trace(spark, d, "task_event").select("time").collect()


def test_lines_that_differ_past_the_last_column_both_stay(spark):
    d = tempfile.mkdtemp(prefix="schedlens-csv-")
    line = "10,2,7,4,5,0,,,,,,,0"
    _write(d, "part-00000-of-00001.csv", [line + ",x", line + ",y", line + ",x"])
    assert ingest.read_trace(spark, d, "task_event").count() == 2


def test_a_cluster_needs_a_shared_folder():
    from schedlens.session import _is_local

    assert _is_local("local") and _is_local("local[8]")
    assert not _is_local("local-cluster[3,2,1000]") and not _is_local("yarn")


def test_distinct_lines_shuffle_whole_lines_only_where_fingerprints_repeat(spark):
    from pyspark.sql import functions as F

    lines = [f"{i},{'x' * 300}" for i in range(500)] + ["7," + "x" * 300] * 400 + ["", "", "a,b"]
    df = spark.createDataFrame([(x,) for x in lines], "value string").repartition(6)
    want = sorted(set(lines))
    assert sorted(r.value for r in ingest.distinct_lines(df).collect()) == want
    # forced collisions: lines of equal length share a fingerprint, and all of them do
    for fingerprint in (lambda c: [F.length(c)], lambda c: [F.lit(0)]):
        assert sorted(r.value for r in ingest.distinct_lines(df, fingerprint).collect()) == want
    # more repeated fingerprints than may be broadcast
    assert sorted(r.value for r in ingest.distinct_lines(df, broadcast_rows=1).collect()) == want
    single = df.dropDuplicates()
    plan = ingest.distinct_lines(single.where("value <> ''"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert ingest.distinct_lines(df.limit(0)).collect() == []
