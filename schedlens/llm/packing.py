"""Packing into optimal length buckets.

Every document becomes pieces of at most ``max_len`` tokens (its words and one end
token; a longer one is split, nothing is cut off). The global histogram of piece
lengths has at most ``max_len`` rows, so the driver can run an exact dynamic program
over it: the ``buckets`` upper bounds that minimise the total padding (of equal
solutions the one with the smallest lower bounds). Inside a bucket of bound b, batches
hold ``token_budget // b`` pieces (at least one), in the order of (salt, id, piece).

A bucket may hold a third of all rows, and one id (or null) too: rows are numbered inside
ranges of about ``GROUP_ROWS`` of that order, whose running totals give the offsets. A
stored row number is the last part of the order, so rows that are equal in all others are
divided as well: no task sees a bucket or an id whole, and the numbering is contiguous.

Defined results: a null or empty text is its end token, one piece of length 1. Null
ids sort as -1. Repeated rows are packed like any others. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from schedlens.llm.common import stage, table, texts

MAX_LEN = 2048
BUCKETS = 8
TOKEN_BUDGET = 16_384
GROUP_ROWS = 50_000


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds (ascending, the last is the largest length) with the least padding."""
    m = len(lengths)
    if m == 0:
        return []
    k = min(buckets, m)
    n = np.concatenate(([0], np.cumsum(counts)))
    s = np.concatenate(([0], np.cumsum(counts * lengths)))
    cost, prev = lengths * n[1:] - s[1:], []
    for used in range(1, k):  # cost[j]: least padding of lengths[:j + 1] in ``used`` buckets, from j = used - 1
        best, arg = cost.copy(), np.zeros(m, dtype=np.int64)
        for j in range(used, m):
            at = np.arange(used - 1, j)
            c = cost[at] + lengths[j] * (n[j + 1] - n[at + 1]) - (s[j + 1] - s[at + 1])
            a = int(np.argmin(c))
            best[j], arg[j] = c[a], at[a]
        cost = best
        prev.append(arg)
    bounds, j = [int(lengths[m - 1])], m - 1
    for arg in reversed(prev):
        j = int(arg[j])
        bounds.append(int(lengths[j]))
    return bounds[::-1]


def word_tokens(text: Column) -> Column:
    """Words and one end token."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


ORDER = ("bucket", "salt", "order", "piece", "length", "row")


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """The rows with the number of their range, of ``n`` of about equal size in ``ORDER``."""
    return stage(rows.repartitionByRange(n, *ORDER).withColumn("range", F.spark_partition_id()), "ranges")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
         max_len: int = MAX_LEN, buckets: int = BUCKETS, token_budget: int = TOKEN_BUDGET,
         group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, length, bucket (its bound), batch and slot
    inside the bucket. ``tokens`` overrides how a row's tokens are counted."""
    if tokens is None:
        sized = texts(docs, id_col, text_col).select("doc_id", word_tokens(F.col("text")).alias("tokens"))
    else:
        sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), tokens.cast("long").alias("tokens"))
    pieces = stage(sized.select("doc_id", "tokens", F.explode(F.sequence(
        F.lit(0), F.floor((F.greatest("tokens", F.lit(1)) - 1) / F.lit(max_len)).cast("int"))).alias("piece"))
        .select("doc_id", "piece", F.greatest(F.lit(1), F.least(F.lit(max_len), F.col("tokens") - F.col("piece") * max_len))
                .cast("int").alias("length"), F.monotonically_increasing_id().alias("row")), "pieces")
    histogram = sorted((r.length, r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect())  # <= max_len rows
    lengths, counts = (np.array([h[i] for h in histogram], dtype=np.int64) for i in (0, 1))
    bounds = optimal_bounds(lengths, counts, buckets)
    bucket, groups, low = F.lit(bounds[-1] if bounds else 1), F.lit(1), 0
    for b in reversed(bounds):  # the smallest bound is tested first
        bucket = F.when(F.col("length") <= b, b).otherwise(bucket)
    for b in bounds:
        held = int(counts[(lengths > low) & (lengths <= b)].sum())
        groups = F.when(F.col("bucket") == b, max(1, -(-held // group_rows))).otherwise(groups)
        low = b
    order = F.coalesce("doc_id", F.lit(-1))
    rows = pieces.withColumn("bucket", bucket).withColumn("groups", groups).withColumn(
        "salt", F.pmod(F.pmod(order, F.col("groups")) + F.col("piece"), F.col("groups")))
    rows = _ranges(rows.select("doc_id", "piece", "length", "bucket", "salt", order.alias("order"), "row"),
                   max(1, -(-int(counts.sum()) // group_rows)))
    totals = rows.groupBy("bucket", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("bucket", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("bucket", "range").orderBy(*ORDER[1:])
    rank = F.col("start") + F.col("nth") - 1
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket")))
    return (rows.withColumn("nth", F.row_number().over(inside)).join(starts, ["bucket", "range"])
            .select("doc_id", "piece", "length", "bucket", F.floor(rank / per_batch).cast("long").alias("batch"),
                    F.pmod(rank, per_batch).cast("int").alias("slot")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    steps = ["d1 AS (SELECT i, b * n - s AS cost, 0 AS prev FROM h)"]
    for k in range(2, BUCKETS + 1):
        steps.append(f"""d{k} AS (SELECT i, min(c) AS cost, arg_min(p, (c, p)) AS prev FROM (
  SELECT h.i, g.i AS p, d{k - 1}.cost + h.b * (h.n - g.n) - (h.s - g.s) AS c
  FROM h JOIN h g ON g.i < h.i JOIN d{k - 1} ON d{k - 1}.i = g.i) GROUP BY i)""")
    # walk back from the largest length; with fewer lengths than buckets all are bounds
    back = [f"e{BUCKETS} AS (SELECT max(i) AS i FROM h)"]
    for k in range(BUCKETS, 1, -1):
        back.append(f"e{k - 1} AS (SELECT d{k}.prev AS i FROM d{k} JOIN e{k} USING (i))")
    ends = " UNION ".join(f"SELECT i FROM e{k}" for k in range(1, BUCKETS + 1))
    return rf"""
WITH t AS (SELECT doc_id, 1 + len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents),
p AS (SELECT doc_id, piece::INT AS piece, least({MAX_LEN}, tokens - piece * {MAX_LEN})::INT AS length
      FROM (SELECT doc_id, tokens, unnest(range((tokens - 1) // {MAX_LEN} + 1)) AS piece FROM t)),
l AS (SELECT length AS b, count(*) AS c FROM p GROUP BY length),
h AS (SELECT row_number() OVER (ORDER BY b) AS i, b::BIGINT AS b, (sum(c) OVER (ORDER BY b))::BIGINT AS n,
             (sum(c * b) OVER (ORDER BY b))::BIGINT AS s FROM l),
{", ".join(steps)}, {", ".join(back)},
bounds AS (SELECT h.b::INT AS bucket FROM h WHERE (SELECT count(*) FROM h) <= {BUCKETS} OR h.i IN ({ends})),
placed AS (SELECT p.*, (SELECT min(bucket) FROM bounds WHERE bucket >= p.length) AS bucket FROM p),
sized AS (SELECT *, greatest(1, (count(*) OVER (PARTITION BY bucket) + {GROUP_ROWS - 1}) // {GROUP_ROWS}) AS groups FROM placed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ((doc_id % groups) + piece) % groups, doc_id, piece, length) - 1 AS r,
           greatest(1, {TOKEN_BUDGET} // bucket) AS per_batch FROM sized)
SELECT doc_id, piece, length, bucket, (r // per_batch)::BIGINT AS batch, (r % per_batch)::INT AS slot FROM ranked
"""


ORACLE = _oracle()
