"""Stored trace tables: typed Parquet read / write, resharding and co-partitioned tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens import schemas as S
from schedlens.functions import zero

KINDS = tuple(S.TABLE_SCHEMAS)


def write_table(df: DataFrame, kind: str, path: str, mode: str = "overwrite",
                partitions: int | None = None) -> str:
    """Store a typed table as Parquet (``partitions`` reshards to that many files)."""
    if kind not in S.TABLE_SCHEMAS:
        raise ValueError(f"unknown table kind {kind!r}")
    if partitions:
        df = reshard(df, partitions)
    df.write.mode(mode).parquet(path)
    return path


def read_table(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Read a stored table; the typed columns come back with the declared schema
    (extra columns written alongside, such as ``tie``, are kept)."""
    if kind not in S.TABLE_SCHEMAS:
        raise ValueError(f"unknown table kind {kind!r}")
    df = spark.read.parquet(path)
    schema = S.TABLE_SCHEMAS[kind]
    cols = [df[f.name].cast(f.dataType).alias(f.name) if f.name in df.columns else None
            for f in schema.fields]
    missing = [f.name for f, c in zip(schema.fields, cols) if c is None]
    if missing:
        raise ValueError(f"{path}: missing columns {missing} for {kind}")
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)


def reshard(df: DataFrame, n: int) -> DataFrame:
    """Redistribute rows evenly over ``n`` partitions (keeps duplicates)."""
    return df.repartition(n)


TASK_KEYS = ("job_key", "task_key")
#: Where the tables of tasks keep their job id and task index.
_TASK_KEY_FIELDS = {
    "task_usage": ("task_info.job.id", "task_info.task_index"),
    "task_event": ("info.job.id", "info.task_index"),
    "task_utilization": ("info.job.id", "info.task_index"),
    "task_usage_with_avg": ("usage.task_info.job.id", "usage.task_info.task_index"),
}


def write_by_task(df: DataFrame, kind: str, path: str, buckets: int) -> str:
    """Store a table with its task key in front (``job_key``, ``task_key``; unset reads 0),
    bucketed and sorted by it, so joins and aggregates by task over such tables need no
    shuffle. Returns the folder, ``<path>.by-task-<buckets>``, which names the layout.

    A bucket is read by one task, so this form is only for tables whose tasks are all small:
    a table with a task of more than ``schedlens.store.taskRows`` rows (1,000,000; a month of
    5-minute records is 8,928) is stored in ``<path>.by-task-0``, with the keys but not in
    buckets. Its joins shuffle and AQE splits the hot task."""
    spark = df.sparkSession
    job, index = _TASK_KEY_FIELDS[kind]
    keyed = df.select(zero(job, 0).alias(TASK_KEYS[0]), zero(index, 0).alias(TASK_KEYS[1]), *[F.col(f"`{c}`") for c in df.columns if c not in TASK_KEYS])
    limit = int(spark.conf.get("schedlens.store.taskRows", "1000000"))
    largest = keyed.groupBy(*TASK_KEYS).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > limit:
        buckets = 0
    folder = f"{path.rstrip('/')}.by-task-{buckets}"
    if not buckets:
        keyed.write.mode("overwrite").parquet(folder)
        return folder
    name = _table_name(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # the entry; an external table's files stay
    (keyed.repartition(buckets, *TASK_KEYS).write.mode("overwrite").format("parquet")  # the same hash: one file a bucket
     .bucketBy(buckets, *TASK_KEYS).sortBy(*TASK_KEYS).option("path", folder).saveAsTable(name))
    return folder


def read_by_task(spark: SparkSession, kind: str, folder: str) -> DataFrame:
    """Read what :func:`write_by_task` stored, in any session: the layout is in the folder's name."""
    found = re.search(r"\.by-task-(\d+)$", folder)
    if not found or kind not in _TASK_KEY_FIELDS:
        raise ValueError(f"{folder}: not a table by task of kind {kind!r}")
    if found[1] == "0":
        return read_table(spark, kind, folder)
    name, by = _table_name(folder), ", ".join(TASK_KEYS)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(folder).schema)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {found[1]} BUCKETS LOCATION '{folder}'")
    missing = [c for c in S.TABLE_SCHEMAS[kind].fieldNames() if c not in spark.table(name).columns]
    if missing:
        raise ValueError(f"{folder}: missing columns {missing} for {kind}")
    return spark.table(name)


def _table_name(folder: str) -> str:
    return "schedlens_" + hashlib.sha256(folder.encode()).hexdigest()[:24]
