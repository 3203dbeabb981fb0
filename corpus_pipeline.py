"""The corpus pipeline: five stages, each one operator of ``schedlens.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; all
but the last return the columns of ``documents``. Rows that share an id (or have none)
are one document to the classifier and to near deduplication: they stay together when
one of them stays. Exact deduplication tells them apart by their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schedlens.llm import exact_dedup, packing, pii, quality, simhash
from schedlens.llm.common import BLANKS, stage, table


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept``; rows that share an id stay together."""
    ids = kept.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__id"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return _only(docs, scored.filter("predicted = 1"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays."""
    kept = exact_dedup.exact_duplicates(docs).filter("kept")
    repeated = docs.groupBy("doc_id").count().filter((F.col("count") > 1) | F.col("doc_id").isNull())
    if repeated.limit(1).count() == 0:
        return _only(docs, kept)
    # ids do not tell the rows apart: texts do
    same = kept.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__kept"))
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS + "+", " ")
    rows = docs.withColumn("__sha", F.sha2(norm, 256))
    rows = rows.join(same, rows["doc_id"].eqNullSafe(same["__id"]) & (rows["__sha"] == same["__kept"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "__sha"]).drop("__sha")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    groups = simhash.near_duplicates(docs)
    return _only(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in batches of their length buckets."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: No SQL: the classifier and the span model are trained iteratively.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
