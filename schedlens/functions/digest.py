"""An order-free digest of all columns of a table.

Every row becomes one text of its leaf values (struct fields in schema order, a flag for
each struct, arrays as JSON), each with its length in front, so different rows have
different texts; the two halves of its MD5 are added up. Sums do not depend on the order or
the partitioning of the rows and count repeated ones. Native expressions, one hash
aggregate, one row per task in the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType


def _leaves(c: Column, t: DataType) -> list[Column]:
    if isinstance(t, StructType):
        return [c.isNotNull().cast("string")] + [x for f in t.fields for x in _leaves(c.getField(f.name), f.dataType)]
    if isinstance(t, MapType):  # equal maps may hold their entries in any order
        return _leaves(F.array_sort(F.map_entries(c)), ArrayType(StructType().add("key", t.keyType).add("value", t.valueType)))
    if isinstance(t, ArrayType):
        return [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})]
    if isinstance(t, BinaryType):
        return [F.hex(c)]
    return [c.cast("string")]


def row_text(df: DataFrame) -> Column:
    """The row as one text: ``length:value`` of each leaf (``-`` for null), comma-joined."""
    leaves = [x for f in df.schema.fields for x in _leaves(F.col(f"`{f.name}`"), f.dataType)]
    return F.concat_ws(",", *[F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in leaves])


def content_digest(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` and ``digest`` (two decimal sums; ``0-0`` for an empty table)."""
    def half(begin: int) -> Column:
        number = F.conv(F.substring("md5", begin, 15), 16, 10).cast("decimal(28,0)")
        return F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string")

    return (df.select(F.md5(row_text(df).cast("binary")).alias("md5"))
            .agg(F.count(F.lit(1)).alias("n_rows"), F.concat(half(1), F.lit("-"), half(16)).alias("digest")))
