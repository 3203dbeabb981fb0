"""Weighted discrete percentiles, exact, as a sort-based window plan.

Definition: sort a group's values; the cumulative weight of a value is the
total weight of all values up to and including it (equal values pool their
weight). For percentile ``p`` the place is ``total * p`` (compared in float32,
as the trace tools do); the answer is the value with the smallest cumulative
weight ``>= place``; among values with the same cumulative weight (zero-weight
values) the largest wins; if rounding puts the place beyond the total, the
largest value. No interpolation. With unit weights this is the
``ceil(n * p)``-th smallest value, i.e. ``percentile_disc``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlens.operators.keys import shuffled
from schedlens.session import cut


def unpivot_measures(df: DataFrame, by: Sequence[str | Column], measures: Mapping[str, Column],
                     weight: Column) -> DataFrame:
    """Long form ``(by..., measure, v, w)``: one sort serves every measure."""
    by_cols = [F.col(b) if isinstance(b, str) else b for b in by]
    pairs = F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("double").alias("v"))
                      for name, c in measures.items()])
    return df.select(*by_cols, weight.alias("w"), F.explode(pairs).alias("__m")).select(
        *[F.col(f"`{c}`") for c in df.select(*by_cols).columns], "__m.measure", "__m.v", "w")


# Value chunks: contiguous, order-preserving ranges of about 1 % relative width
# (64 per power of two), so one group's running sum is split over many tasks.
CHUNKS_PER_OCTAVE = 64
_CHUNK_OFFSET = 1 << 20


def value_chunk(v: Column) -> Column:
    """A non-decreasing function of ``v`` with ~1 % wide steps (0 for zero);
    infinities and NaN, which sorts last, have end chunks of their own."""
    end = 2 * _CHUNK_OFFSET
    mag = F.floor(F.log2(F.abs(v)) * F.lit(CHUNKS_PER_OCTAVE)).cast("bigint") + F.lit(_CHUNK_OFFSET)
    return (F.when(F.isnan(v), end + 1).when(v == float("inf"), end).when(v == float("-inf"), -end)
            .when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0).cast("bigint")))


def percentile_columns(long: DataFrame, by: Sequence[str], ps: Sequence[float],
                       value: str = "v", weight: str = "w") -> DataFrame:
    """``(by..., __p0, __p1, ...)``: one row per group of ``by``, a column per ``ps[i]``.

    Plan: pre-aggregate equal values (partial aggregation map-side); split each
    group's values into contiguous value chunks; chunk totals, aggregated from the
    pooled values (whose exchange is reused, so the input is scanned and expanded
    once), give each chunk's offset (a window over at most one row per chunk); the
    running weight inside a chunk is a window over that chunk only. So the exact
    cumulative weight of a hot group is computed by many tasks. The offsets are as many
    as the groups' chunks, so they join by a shuffle. One aggregate with a filtered
    ``min_by`` per percentile picks the answers.
    """
    by = list(by)
    # weights may be as long as the "after the trace" time: their sums need more than 64 bits
    long = long.withColumn(weight, F.col(weight).cast("decimal(20,0)"))
    pooled = (long.groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).cast("decimal(38,0)").alias("w"))
              .withColumn("__c", value_chunk(F.col("v"))))
    chunks = pooled.groupBy(*by, "__c").agg(F.sum("w").cast("decimal(38,0)").alias("__cw"))
    w_before = (Window.partitionBy(*by).orderBy("__c")
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = chunks.select(*by, "__c",
                            F.coalesce(F.sum("__cw").over(w_before), F.lit(0)).cast("decimal(38,0)").alias("__off"),
                            F.sum("__cw").over(Window.partitionBy(*by)).alias("tw"))
    w_run = (Window.partitionBy(*by, "__c").orderBy("v")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    same = F.col("__c") == F.col("__oc")
    for b in by:  # a group may have unset keys
        same = same & F.col(f"`{b}`").eqNullSafe(F.col(f"__o_{b}"))
    offsets = offsets.select(*[F.col(b).alias(f"__o_{b}") for b in by], F.col("__c").alias("__oc"), "__off", "tw")
    ranked = pooled.join(shuffled(offsets), same).select(
        *by, "v", (F.col("__off") + F.sum("w").over(w_run)).alias("cw"), "tw")
    cw_f = F.col("cw").cast("float")
    picks = []
    for i, p in enumerate(ps):
        place = (F.col("tw").cast("double") * F.lit(float(p))).cast("float")
        picks.append(F.coalesce(
            F.min_by(F.when(cw_f >= place, F.col("v")),
                     F.when(cw_f >= place, F.struct(F.col("cw"), -F.col("v")))),
            F.max("v")).alias(f"__p{i}"))
    return ranked.groupBy(*by).agg(*picks)


def weighted_percentiles(long: DataFrame, by: Sequence[str], ps: Sequence[float],
                         value: str = "v", weight: str = "w") -> DataFrame:
    """``(by..., pi, p, value)`` for each group of ``by`` and each ``ps[pi]``."""
    wide = percentile_columns(long, by, ps, value, weight)
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(i).alias("pi"), F.lit(float(p)).alias("p"), F.col(f"__p{i}").alias("value"))
        for i, p in enumerate(ps)])).alias("__x")).select(*by, "__x.pi", "__x.p", "__x.value")


GROUP_ROWS_CONF = "schedlens.percentile.groupRows"
DEFAULT_GROUP_ROWS = 500_000


def measure_percentiles(df: DataFrame, by: Sequence[str], measures: Mapping[str, Column], weight: Column,
                        ps: Sequence[float]) -> DataFrame:
    """``(by..., <measure>_0, <measure>_1, ...)``: the percentiles of :func:`percentile_columns`
    for several measures of the same rows, one row per group of ``by`` (set keys).

    The rows are shuffled once, as they are: each measure's running weight is a window over the
    group, and the aggregate that picks the answers has the same key. A group is in one task, so
    those of more than ``schedlens.percentile.groupRows`` rows (found by a count of all groups)
    go through the chunks of :func:`percentile_columns` instead."""
    by = list(by)
    limit = int(df.sparkSession.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*by)
    large = cut(sizes, "large-groups")
    rows = df.select(*by, weight.cast("decimal(20,0)").alias("w"),
                     *[(c.cast("double") + F.lit(0.0)).alias(m) for m, c in measures.items()])  # no -0.0
    if large.isEmpty():
        return _windowed_percentiles(rows, by, list(measures), ps)
    small = _windowed_percentiles(rows.join(F.broadcast(large), by, "left_anti"), by, list(measures), ps)
    long = unpivot_measures(rows.join(F.broadcast(large), by, "left_semi"), by, {m: F.col(m) for m in measures}, F.col("w"))
    wide = percentile_columns(long, [*by, "measure"], ps)
    return small.unionByName(wide.groupBy(*by).agg(*[
        F.max(F.when(F.col("measure") == m, F.col(f"__p{i}"))).alias(f"{m}_{i}") for m in measures for i in range(len(ps))]))


def _windowed_percentiles(rows: DataFrame, by: list[str], measures: list[str], ps: Sequence[float]) -> DataFrame:
    total = F.sum("w").over(Window.partitionBy(*by)).cast("decimal(38,0)")
    rows = rows.withColumn("tw", total)
    for m in measures:  # equal values are peers and have one cumulative weight
        upto = Window.partitionBy(*by).orderBy(m).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        chunk = value_chunk(F.col(m))
        # as in percentile_columns, no cumulative weight before the first set weight of a chunk
        weighed = F.max(F.when(F.col("w").isNotNull(), chunk)).over(upto) == chunk
        rows = rows.withColumn(f"cw_{m}", F.when(weighed, F.sum("w").over(upto).cast("decimal(38,0)")))
    picks = []
    for m in measures:
        cw = F.col(f"cw_{m}")
        for i, p in enumerate(ps):
            reached = cw.cast("float") >= (F.col("tw").cast("double") * F.lit(float(p))).cast("float")
            picks.append(F.coalesce(F.min_by(F.when(reached, F.col(m)), F.when(reached, F.struct(cw, -F.col(m)))),
                                    F.max(m)).alias(f"{m}_{i}"))
    return rows.groupBy(*by).agg(*picks)
