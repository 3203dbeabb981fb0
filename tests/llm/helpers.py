"""Small document tables with the awkward cases every operator must take."""

from __future__ import annotations

import duckdb
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """rows: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def awkward():
    long = "word " * 30_000
    return [
        (1, None), (2, ""), (3, " "), (4, "a"), (5, "a"), (6, "a\tb  c\n"), (7, "a b c "), (8, long), (9, long),
        (10, "x" * 50_000), (None, "a"), (11, "é ü   z"), (12, "A B C d"), (12, "A B C d"), (13, "\n\n"),
    ]


def clashing(df):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    names = ["fp", "n", "key", "row_key", "rep_key", "score", "component_id", "keep_id", "kept", "spans", "bucket", "slot"]
    return df.select("*", *[F.lit("x").alias(c) for c in names])


def sample(sf="/root/testdata/sf0.001", name="documents"):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/{name}.parquet'").fetchall()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


__all__ = ["DOCS", "Row", "awkward", "clashing", "docs", "rows", "sample"]
