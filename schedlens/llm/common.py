"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import schedlens
from schedlens.session import cut

#: Largest piece of text, in bytes, that a task puts into one Arrow batch.
BATCH_BYTES = 8 << 20

#: Java and Python class of the six ASCII blanks every operator splits words at.
BLANKS = r"[\x20\x09-\x0D]"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives the tasks of this application the package, as ``--py-files`` would, once.
    Nothing to do where it is already imported from an archive."""
    sc, home = spark.sparkContext, os.path.dirname(os.path.abspath(schedlens.__file__))
    if sc.applicationId in _SHIPPED or not os.path.isdir(home):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="schedlens-"), "schedlens.zip")  # the driver serves it
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as (doc_id long, text string); a null
    text counts as empty. All other columns, whatever their names, are left out."""
    ship_package(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back (lineage cut)."""
    return cut(df, f"llm-{name}")


def sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hex16(col: Column) -> Column:
    """Sixteen lowercase hex digits of a long read as unsigned."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


def text_rows(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of a string column, row by row."""
    for x in batch.column(column).cast(pa.binary()):
        yield x.as_py()


class RowWriter:
    """Collects rows column-wise and hands out Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, max_rows: int = 20_000, max_bytes: int = BATCH_BYTES):
        self.schema, self.max_rows, self.max_bytes = schema, max_rows, max_bytes
        self._reset()

    def _reset(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        """True when the batch is full and should be taken."""
        self.rows.append(row)
        self.size += size
        return len(self.rows) >= self.max_rows or self.size >= self.max_bytes

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(cols, self.schema)], schema=self.schema)
        self._reset()
        return out


def batched(rows: Iterable[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches from (row, byte size) pairs."""
    w = RowWriter(schema)
    for row, size in rows:
        if w.add(row, size):
            yield w.take()
    if w.rows:
        yield w.take()
