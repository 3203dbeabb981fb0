"""Key and tie-order columns of the trace tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from schedlens import schemas as S


def task_key_of_event(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}info.job.id"), F.col(f"{prefix}info.task_index")]


def task_key_of_usage(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}task_info.job.id"), F.col(f"{prefix}task_info.task_index")]


def shuffled(df: DataFrame) -> DataFrame:
    """A side of an equi-join that grows with the trace: it is shuffled, never broadcast. Spark
    takes the size of a plan from its compressed files and does not count the rows that an
    explode adds, so it would send through the driver what only looks small."""
    return df.hint("merge")


# An order packed into one decimal keeps ``max`` and ``max_by`` in hash aggregation: the
# time takes the digits from the 20th on, the tie the 19 below.
_TIE_RANGE = "1" + "0" * 19
_HASH_RANGE = 10**16


def _row_hash(df: DataFrame, exclude: tuple[str, ...]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c not in exclude])


def _packed_tie(df: DataFrame, exclude: tuple[str, ...]) -> Column:
    """Order of rows with equal times without a ``tie`` column, below 10**19: for events
    SCHEDULE last, then the type, then the first part of one hash of the row."""
    sub = F.pmod(_row_hash(df, exclude), F.lit(_HASH_RANGE))
    if "type" in df.columns:
        sub = sub + ((F.col("type") == S.SCHEDULE).cast("bigint") * 10 + F.coalesce(F.col("type"), F.lit(0))) * F.lit(_HASH_RANGE)
    return sub


def tie_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[Column]:
    """The explicit tie-break after time, the same in joins and aggregates. The ``tie``
    column when the table has one (the driver views); else the packed order of the row and,
    behind it, the whole hash: scalars only, so the row is not carried twice."""
    if "tie" in df.columns:
        return [F.col("tie")]
    return [_packed_tie(df, exclude), _row_hash(df, exclude)]


def _scalar_tie(df: DataFrame) -> bool:
    return isinstance(df.schema["tie"].dataType, (LongType, IntegerType))


def event_order(df: DataFrame) -> Column:
    """Order of task/job/machine events as one DECIMAL(38): raw time, then the tie. Rows that
    still share it are told apart by :func:`event_tie`."""
    time = F.col("time").cast("decimal(38,0)") * F.lit(_TIE_RANGE).cast("decimal(20,0)")
    if "tie" not in df.columns:
        sub = _packed_tie(df, ("time",))
    elif _scalar_tie(df):
        sub = F.col("tie")
    else:
        sub = F.lit(0)
    return (time + sub.cast("decimal(20,0)")).cast("decimal(38,0)")


def event_tie(df: DataFrame) -> Column:
    """What decides between events with equal :func:`event_order`."""
    return tie_columns(df, ("time",))[-1]


def time_order(start: Column, end: Column) -> Column:
    """Order by start, then end, as one DECIMAL(38)."""
    wide = lambda c: c.cast("decimal(38,0)")
    return wide(wide(start) * F.lit(_TIE_RANGE).cast("decimal(20,0)") + wide(end))


def extreme_rows(df: DataFrame, keys: dict[str, Column], order: Column, tie: Column, last: bool = True) -> DataFrame:
    """The whole row of each key that comes last (or first) in (order, tie), with the key
    columns in front. A hash aggregate picks the winning order, a scalar; the wide rows are
    fetched by key and order, so neither the aggregate nor its shuffle carries them, and a
    hot key's rows are spread over the join by their order. Rows without an order have no
    part; of rows that are equal in all of it any one is taken."""
    cols = df.columns
    rows = df.select(*[c.alias(f"__k_{k}") for k, c in keys.items()], order.alias("__o"), tie.alias("__tie"), "*").where(F.col("__o").isNotNull())
    best = rows.groupBy(*[F.col(f"__k_{k}").alias(f"__b_{k}") for k in keys]).agg((F.max if last else F.min)("__o").alias("__best"))
    cond = F.col("__o") == F.col("__best")
    for k in keys:
        cond = cond & F.col(f"__k_{k}").eqNullSafe(F.col(f"__b_{k}"))
    found = rows.join(best, cond)
    by = Window.partitionBy(*[f"__k_{k}" for k in keys]).orderBy(F.col("__tie").desc() if last else F.col("__tie").asc())
    return found.withColumn("__n", F.row_number().over(by)).where("__n = 1").select(
        *[F.col(f"__k_{k}").alias(k) for k in keys], *[F.col(f"`{c}`") for c in cols])


def usage_tie(df: DataFrame) -> Column:
    """What decides between usage records with equal start and end."""
    return tie_columns(df, ("start_time", "end_time"))[-1]
