"""Sums of doubles that do not depend on the order of the rows.

Adding doubles rounds after every step, so a sum depends on how rows met in tasks. Here each
addend is split, without error, into whole multiples of four fixed powers of two; the
multiples are added as DECIMAL, which is exact, and the four totals are rounded to a double
once. The result is the double nearest to the true sum, whatever the partitioning. It is
all in built-in expressions: a hash aggregate with partial aggregation, and a projection.

The totals are an accumulator: :func:`accumulate` makes one (five columns), :func:`merge`
adds accumulators, also stored ones, and :func:`finish` rounds. :func:`exact_sums` does all.

Addends below ``2 ** 100`` in magnitude are exact down to bits of ``2 ** -140``, far beyond
times (up to ``2 ** 63``) times resources. What lies outside (larger addends, smaller bits,
infinities, NaN) is added as doubles and joins the result at the end. NULL is not counted;
the sum of no values is NULL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

#: Exponents of the bins; each holds whole multiples of its power of two.
SHIFTS = (40, -20, -80, -140)
WIDTH = SHIFTS[0] - SHIFTS[1]
LIMIT = 2.0 ** 100
_LAST = len(SHIFTS) - 1


def _wide(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def columns(name: str) -> list[str]:
    """The columns of the accumulator ``name``: the bins and the rest."""
    return [*[f"{name}__{i}" for i in range(_LAST + 1)], f"{name}__r"]


def _split(c: Column) -> tuple[list[Column], Column]:
    """The multiples of an addend, as longs, and what is left of it."""
    x = c.cast("double")
    inside = F.abs(x) < F.lit(LIMIT)  # false for NaN, which sorts above everything
    rest, parts = F.when(inside, x).when(x.isNotNull(), F.lit(0.0)), []
    for s in SHIFTS:
        part = (rest * F.lit(2.0 ** -s)).cast("bigint")
        parts.append(part)
        rest = rest - part.cast("double") * F.lit(2.0 ** s)
    return parts, F.when(inside, rest).otherwise(x)


def accumulate(name: str, c: Column) -> list[Column]:
    """Aggregates that add the values of ``c``; 28 digits leave room for ``10 ** 10`` rows a bit."""
    parts, rest = _split(c)
    bins = [F.sum(p.cast("decimal(28,0)")) for p in parts]
    return [x.alias(n) for x, n in zip([*bins, F.sum(rest)], columns(name))]


def merge(name: str) -> list[Column]:
    """Aggregates that add accumulators."""
    return [_wide(F.sum(n)).alias(n) if i <= _LAST else F.sum(n).alias(n) for i, n in enumerate(columns(name))]


_BASE = f"CAST('{2 ** WIDTH}' AS DECIMAL(38,0))"


def _let(value: str, name: str, body: str) -> str:
    """SQL in which ``name`` stands for ``value``, computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(*values: str) -> str:
    return "named_struct(" + ", ".join(f"'d{i}', CAST({v} AS DECIMAL(38,0))" for i, v in enumerate(values)) + ")"


def _carried(digits: str) -> str:
    """Brings all but the first digit into 0 .. 2 ** WIDTH - 1; the excess moves up."""
    steps = []
    for i in range(_LAST):
        x, at = f"v{i}", _LAST - i
        low = f"pmod({x}.d{at}, {_BASE})"
        steps.append(_digits(*[f"{x}.d{k} + ({x}.d{at} - {low}) div {_BASE}" if k == at - 1 else low if k == at else f"{x}.d{k}"
                               for k in range(_LAST + 1)]))
    body = steps[-1]
    for i in range(_LAST - 1, 0, -1):
        body = _let(steps[i - 1], f"v{i}", body)
    return _let(digits, "v0", body)


def _nearest(digits: str) -> str:
    """The double nearest to the carried digits. Digits are put together from the highest
    until they fill a double with room to spare; whether any bit follows decides ties."""
    full, cases, whole = 2 ** (WIDTH - 3), [], f"{digits}.d0"
    for i, scale in enumerate(SHIFTS):
        follows = " + ".join(f"{digits}.d{k}" for k in range(i + 1, _LAST + 1))
        odd = f"if({follows} > 0, 1, 0)" if follows else "0"
        value = f"CAST(CAST({whole} * 2 + {odd} AS DECIMAL(38,0)) AS DOUBLE) * CAST('{2.0 ** (scale - 1)!r}' AS DOUBLE)"
        cases.append((whole, f"if(abs({whole}) >= {full}, {value}, " if i < _LAST else value))
        whole = f"w{i}"
    out = cases[-1][1]
    for i in range(_LAST - 1, -1, -1):
        out = cases[i][1] + _let(f"CAST({cases[i][0]} * {_BASE} + {digits}.d{i + 1} AS DECIMAL(38,0))", f"w{i}", out) + ")"
    return out


def _sum(n: str) -> Column:
    *bins, rest = [f"`{c}`" for c in columns(n)]
    return F.expr(_let(_carried(_digits(*bins)), "m", _nearest("m")) + f" + {rest}")


def finish(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replaces the accumulators ``names`` by their sums, after the other columns."""
    kept = [c for c in df.columns if c not in {x for n in names for x in columns(n)}]
    return df.select(*[F.col(f"`{c}`") for c in kept], *[_sum(n).alias(n) for n in names])


def exact_sums(groups: GroupedData, sums: Mapping[str, Column], *others: Column) -> DataFrame:
    """``groups.agg(*others, ...)`` with an exact sum of every column of ``sums``."""
    return finish(groups.agg(*others, *[c for n, x in sums.items() for c in accumulate(n, x)]), list(sums))
