"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from schedlens import schemas as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero(c: Column | str, value: float | int = 0.0) -> Column:
    """Read an optional field the way the trace format does: unset means 0."""
    return F.coalesce(col(c), F.lit(value))


def idiv(c: Column | str, d: int | Column) -> Column:
    """Integral division truncating toward zero (SQL ``div``, like the JVM)."""
    d = d if isinstance(d, Column) else F.lit(int(d)).cast("bigint")
    return F.call_function("div", col(c).cast("bigint"), d)


def saturating_add(t: Column | str, offset: int) -> Column:
    """``t + offset`` that sticks at Long.MAX_VALUE instead of wrapping.

    The "after the trace" sentinel is Long.MAX_VALUE; adding a join offset to it
    must keep it last (ANSI mode would raise on the overflow).
    """
    t = col(t)
    return F.when(t > F.lit(S.LONG_MAX - int(offset)), F.lit(S.LONG_MAX)).otherwise(
        t + F.lit(int(offset)).cast("bigint"))


def event_join_time(time: Column | str = "time", type_: Column | str = "type") -> Column:
    """Join time of a task or job event: SCHEDULE counts 1 us later, so a SUBMIT
    at the same instant is seen first."""
    return F.when(col(type_) == S.SCHEDULE, saturating_add(time, 1)).otherwise(col(time))


def machine_event_join_time(time: Column | str = "time") -> Column:
    return col(time)


def usage_join_time(start_time: Column | str = "start_time") -> Column:
    """Join time of a usage record: one second after its start, so the record
    sees an event that happened right at its start."""
    return saturating_add(start_time, S.SECOND)


def bucket_5min(t: Column | str) -> Column:
    """Five-minute tumbling bucket."""
    return idiv(t, S.FIVE_MIN)


def bucket_daily(t: Column | str) -> Column:
    """Five-minute slot within the day, 0..287 for non-negative times."""
    return idiv(col(t) % F.lit(S.DAY), S.FIVE_MIN)


def clamped_period(t: Column | str, period: int, max_time: int | None) -> Column:
    """``min(t / period, max_time / period)``; no clamp when ``max_time`` is None."""
    p = idiv(t, period)
    if max_time is None:
        return p
    return F.least(p, F.lit(max_time // period).cast("bigint"))


def typed_struct(schema: StructType, values: Mapping[str, Column] | None = None) -> Column:
    """A struct of ``schema`` with the given field values and NULL elsewhere.

    Nested structs may be given as Columns already of the right type.
    """
    values = dict(values or {})
    unknown = set(values) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"fields not in schema: {sorted(unknown)}")
    return F.struct(*[
        (values[f.name].cast(f.dataType) if f.name in values else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ])


def merge_struct(left: Column, right: Column, dtype: DataType) -> Column:
    """Protocol-buffer style merge of ``right`` into ``left``.

    A field set on the right overwrites, an unset one keeps the left value,
    nested structs merge recursively and arrays concatenate. A NULL side leaves
    the other unchanged.
    """
    if isinstance(dtype, StructType):
        fields = [
            merge_struct(left.getField(f.name), right.getField(f.name), f.dataType).alias(f.name)
            for f in dtype.fields
        ]
        return (F.when(right.isNull(), left)
                .when(left.isNull(), right)
                .otherwise(F.struct(*fields)))
    if isinstance(dtype, ArrayType):
        return (F.when(right.isNull(), left)
                .when(left.isNull(), right)
                .otherwise(F.concat(left, right)))
    return F.coalesce(right, left)
