"""Manifests of stored tables: what a table was made from and what it holds.

The manifest is a small JSON table beside the stored one (``<path>.manifest``). It is
written before the table without a digest and after it with one, so a table whose writing
was interrupted has none and is made again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.functions.digest import content_digest

FIELDS = "made_from string, n_rows long, digest string"


def _write(spark: SparkSession, path: str, made_from: str, n_rows: int | None, digest: str | None) -> None:
    (spark.createDataFrame([(made_from, n_rows, digest)], FIELDS).coalesce(1)
     .write.mode("overwrite").json(f"{path.rstrip('/')}.manifest"))


def start(spark: SparkSession, path: str, made_from: str) -> None:
    """Say that the table is about to be written."""
    _write(spark, path, made_from, None, None)


def finish(spark: SparkSession, path: str, made_from: str, stored: DataFrame) -> str:
    """Digest the stored table (one scan) and say that it is whole; returns the digest."""
    row = content_digest(stored).first()
    _write(spark, path, made_from, row.n_rows, row.digest)
    return row.digest


def digest_of(spark: SparkSession, path: str, made_from: str | None = None) -> str | None:
    """The digest of a finished table, None without one or when it was made from something else."""
    try:
        rows = spark.read.schema(FIELDS).json(f"{path.rstrip('/')}.manifest").collect()  # one row
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if len(rows) != 1 or (made_from is not None and rows[0].made_from != made_from):
        return None
    return rows[0].digest


def intact(spark: SparkSession, path: str, stored: DataFrame) -> bool:
    """Whether a stored table still holds what its manifest says (one scan)."""
    return digest_of(spark, path) == content_digest(stored).first().digest


def files_digest(spark: SparkSession, folder: str, pattern: str) -> str:
    """Digest of the names, sizes and times of the files of a raw table; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return content_digest(files.select("path", "length", F.col("modificationTime").cast("double").alias("time"))).first().digest


def made_from(stage: str, *inputs: str | Sequence[str]) -> str:
    return "|".join([stage, *map(str, inputs)])
