"""As-of joins: attach to each left row the right row of the same key that was
current at the left row's time.

``direction='backward'``: the right row with the largest ``(time, ties)`` such
that ``right_time <= left_time`` (inclusive). ``direction='forward'``: the right
row with the smallest ``right_time >= left_time``; among equal times the smallest
tie wins. Left rows without a match are kept unchanged (left outer).

Three physical strategies give the same answer:

``window``    union both sides, one window per key, ``last(ignorenulls)``.
              One shuffle. A hot key would land in one task: when there is one, the
              time-split form runs instead, also when asked for by name.
``bucketed``  time-split for hot keys: their times are cut at quantiles of their own
              rows, one window per (key, cell) plus a carry-in from earlier cells
              computed on a table with one row per (key, cell). Work per task is
              bounded by the rows of one cell, however hot the key and however
              narrow a burst; without a hot key it is the ``window`` form.
``broadcast`` right side turned into validity intervals ``[t, next t)`` and
              broadcast; a map-side range probe, no shuffle of the left side.
              Only used when the right side's size is checked small; beyond the
              bound the time-split form runs instead, also when asked for by name.
``auto``      the same check: broadcast within the bound, otherwise bucketed.

Of the right rows of one key and time only the last tie can be matched. Where the right side
is too big to broadcast or has hot keys, and its rows share their times, the others are left
out first (:func:`_distinct_times`).

Each side is read once by the join itself. Left rows that skip the join and rows with an
unset key go through the same scan and shuffle under a spread partition key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, StringType, StructType

from schedlens import schemas as S
from schedlens.functions import clamped_period
from schedlens.session import cut

BROADCAST_MAX_BYTES_CONF = "schedlens.asof.broadcastMaxBytes"
DEFAULT_BROADCAST_MAX_BYTES = 64 << 20
CELL_ROWS_CONF = "schedlens.asof.cellRows"
DEFAULT_CELL_ROWS = 500_000
MAX_SPLITTERS = 1 << 20
MIN_ROWS_PER_TIME = 4

Merge = Callable[[Column], dict]


def _cols(xs: Sequence[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def broadcast_max_bytes(spark) -> int:
    v = spark.conf.get(BROADCAST_MAX_BYTES_CONF, None)
    return int(v) if v else DEFAULT_BROADCAST_MAX_BYTES


def cell_rows_of(spark) -> int:
    v = spark.conf.get(CELL_ROWS_CONF, None)
    return int(v) if v else DEFAULT_CELL_ROWS


class RightStats:
    """Size facts of the right side, from one small aggregate over it."""

    def __init__(self, n: int, n_keys: int, n_bytes: int, t_min, t_max):
        self.n, self.n_keys, self.n_bytes = n, n_keys, n_bytes
        self.t_min, self.t_max = t_min, t_max

    def probe_period(self) -> int:
        """Period that keeps each broadcast probe to a few candidates: about one
        right row per (key, period) on average, so the exploded interval table
        holds at most ``2 n + keys`` rows."""
        span = max(1, (self.t_max or 0) - (self.t_min or 0))
        return max(1, (span * max(1, self.n_keys)) // max(1, self.n))

    def broadcast_bytes(self) -> int:
        """Upper estimate of what both broadcast tables hold."""
        return 3 * self.n_bytes


def _value_bytes(c: Column, t: DataType) -> Column:
    """Estimated bytes of one value; strings and lists by their own length."""
    if isinstance(t, StructType):
        total = F.lit(8)
        for f in t.fields:
            total = total + _value_bytes(c.getField(f.name), f.dataType)
        return total
    if isinstance(t, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(t, ArrayType):
        inner = t.elementType
        if isinstance(inner, (StructType, StringType, BinaryType, ArrayType)):
            return F.coalesce(F.aggregate(c, F.lit(16), lambda a, x: a + _value_bytes(x, inner)), F.lit(16))
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    return F.lit(16 if isinstance(t, DecimalType) else 8)


def right_stats(R: DataFrame, kn: list[str]) -> RightStats:
    finite = F.when(F.col("__t") < F.lit(S.LONG_MAX), F.col("__t"))
    row_bytes = sum((_value_bytes(F.col(f.name), f.dataType) for f in R.schema.fields), F.lit(16))
    per_key = R.groupBy(*kn).agg(F.count(F.lit(1)).alias("c"), F.sum(row_bytes.cast("bigint")).alias("b"),
                                 F.min("__t").alias("lo"), F.max(finite).alias("hi"))
    r = per_key.agg(F.sum("c"), F.count(F.lit(1)), F.sum("b"), F.min("lo"), F.max("hi")).first()
    return RightStats(int(r[0] or 0), int(r[1] or 0), int(r[2] or 0), r[3], r[4])


def choose_strategy(stats: RightStats, max_bytes: int) -> str:
    """Broadcast only behind a checked bound on the right side's bytes."""
    return "broadcast" if stats.broadcast_bytes() <= max_bytes else "bucketed"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    left_keys: Sequence[Column | str],
    right_keys: Sequence[Column | str],
    left_time: Column,
    right_time: Column,
    merge: Merge,
    direction: str = "backward",
    strategy: str = "auto",
    ties: Sequence[Column | str] = (),
    passthrough: Column | None = None,
    period: int = S.TIME_PERIOD,
    max_time: int | None = None,
    broadcast_bytes: int | None = None,
    cell_rows: int | None = None,
    right_payload: Sequence[str] | None = None,
) -> DataFrame:
    """Left as-of join with struct merge.

    ``merge(r)`` receives the matched right row as a struct column ``r`` (all
    columns of ``right``) and returns ``{column: expression}``; existing left
    columns are replaced, new names are added. Rows without a match keep their
    left values (new columns are NULL). Rows where ``passthrough`` holds skip the
    join entirely. ``right_payload`` limits the right columns carried in ``r``.
    ``cell_rows`` is about the number of rows of a hot key that one task sorts. ``period``
    and ``max_time`` are accepted from callers that cut by the clock; cells follow the data.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction!r}")
    left_keys, right_keys, ties = _cols(left_keys), _cols(right_keys), _cols(ties)
    if len(left_keys) != len(right_keys) or not left_keys:
        raise ValueError("left_keys and right_keys must be non-empty and of equal length")
    out_cols = left.columns
    kn = [f"__k{i}" for i in range(len(left_keys))]

    L = left.select("*", *[k.alias(n) for k, n in zip(left_keys, kn)], left_time.alias("__t"))
    R = right.select(
        *[k.alias(n) for k, n in zip(right_keys, kn)],
        right_time.alias("__t"),
        (F.struct(*ties) if ties else F.lit(None).cast("int")).alias("__o"),
        F.struct(*[F.col(f"`{c}`") for c in (right_payload or right.columns)]).alias("__r"),
    ).where(F.expr(" AND ".join(f"{n} IS NOT NULL" for n in kn)))

    stats = None
    if strategy in ("auto", "broadcast"):
        bound = broadcast_max_bytes(left.sparkSession) if broadcast_bytes is None else broadcast_bytes
        stats = right_stats(R, kn)
        strategy = choose_strategy(stats, bound)
        if strategy != "broadcast":
            fewer = _distinct_times(R, kn, direction)
            if fewer is not R:
                R, stats = fewer, right_stats(fewer, kn)
                strategy = choose_strategy(stats, bound)

    pt = F.coalesce(passthrough, F.lit(False)) if passthrough is not None else F.lit(False)
    unset = F.lit(False)
    for n in kn:
        unset = unset | F.col(n).isNull()
    L = L.withColumn("__free", pt | unset)

    if strategy == "broadcast":
        matched = _broadcast(L, R, kn, direction, stats)
    elif strategy in ("window", "bucketed"):
        matched = _bucketed(L, R, kn, direction, cell_rows or cell_rows_of(left.sparkSession))
    else:
        raise ValueError(f"unknown strategy {strategy!r}")

    m = F.col("__m")
    updates = merge(m)
    exprs = []
    for c in out_cols:
        if c in updates:
            exprs.append(F.when(m.isNull(), F.col(f"`{c}`")).otherwise(updates[c]).alias(c))
        else:
            exprs.append(F.col(f"`{c}`"))
    for c, e in updates.items():
        if c not in out_cols:
            exprs.append(F.when(m.isNotNull(), e).alias(c))
    return matched.select(*exprs)


def _order(direction: str) -> list[Column]:
    if direction == "backward":
        return [F.col("__t").asc(), F.col("__side").asc(), F.col("__o").asc_nulls_first()]
    return [F.col("__t").desc(), F.col("__side").asc(), F.col("__o").desc_nulls_last()]


def _union(L: DataFrame, R: DataFrame) -> DataFrame:
    return L.withColumn("__side", F.lit(1)).unionByName(
        R.withColumn("__side", F.lit(0)), allowMissingColumns=True)


def _windowed(U: DataFrame, by: list[str], direction: str) -> DataFrame:
    w = (Window.partitionBy(*by).orderBy(*_order(direction))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (U.withColumn("__ml", F.last("__r", ignorenulls=True).over(w))
            .where(F.col("__side") == 1))


def _spread(loose: Column) -> Column:
    """A spread partition key for left rows that need no right row in their window, NULL for
    the others. A retried task gives the same value, identical rows of different input
    partitions do not meet."""
    return F.when(loose, F.xxhash64(F.spark_partition_id(), F.col("__t")))


def _window(L: DataFrame, R: DataFrame, kn: list[str], direction: str) -> DataFrame:
    U = _union(L, R).withColumn("__z", _spread(F.coalesce(F.col("__free"), F.lit(False))))
    return _windowed(U, [*kn, "__z"], direction).withColumn("__m", F.col("__ml"))


def _lead(c: Column, t: DataType) -> Column:
    """The first scalar in a (nested) struct, which decides most comparisons of it."""
    while isinstance(t, StructType) and t.fields:
        c, t = c.getField(t.fields[0].name), t.fields[0].dataType
    return c


def _distinct_times(R: DataFrame, kn: list[str], direction: str) -> DataFrame:
    """The right rows that can be matched: of equal key and time the last tie (``forward``: the
    first). A hash aggregate over scalars finds each time's best leading tie; the rows that have
    it are fetched and compared whole. Where most rows have a time of their own (fewer than
    ``MIN_ROWS_PER_TIME`` rows a time) ``R`` itself is returned. The result is stored."""
    tie = _lead(F.col("__o"), R.schema["__o"].dataType)
    rows = R.withColumn("__lead", tie)
    best = F.max("__lead") if direction == "backward" else F.when(F.count_if(F.col("__lead").isNull()) == 0, F.min("__lead"))
    times = cut(rows.groupBy(*kn, "__t").agg(best.alias("__best"), F.count(F.lit(1)).alias("__rows")), "asof-times")
    n, n_times = times.agg(F.sum("__rows"), F.count(F.lit(1))).first()
    if not n or n < MIN_ROWS_PER_TIME * n_times:
        return R
    at = [*kn, "__t"]
    times = times.select(*[F.col(k).alias(f"{k}_b") for k in at], "__best")
    same = _and([F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in at] + [F.col("__lead").eqNullSafe(F.col("__best"))])
    pick = F.max_by if direction == "backward" else F.min_by  # an unset tie is the smallest
    won = rows.join(times, same, "left_semi").groupBy(*at).agg(
        pick(F.struct("__o", "__r"), F.struct("__o")).alias("__w"))
    return cut(won.select(*at, "__w.__o", "__w.__r"), "asof-right")


def find_splits(L: DataFrame, R: DataFrame, kn: list[str], cell_rows: int) -> DataFrame | None:
    """(keys, sorted splitter times) of the keys that have more than about one cell of rows.

    One narrow pass: every row of either side is drawn with probability ``1 / cell_rows``, so
    a key of n rows gets about ``n / cell_rows`` splitters at the quantiles of its own times,
    and keys drawn less than twice stay whole. The drawn times are stored, so a rerun sees
    the same splitters; any splitters give the same answer. Beyond ``MAX_SPLITTERS`` every
    f-th is kept (cells grow by f), which bounds the broadcast. ``None`` without a hot key."""
    times = L.where(~F.col("__free")).select(*kn, "__t").unionByName(R.select(*kn, "__t"))
    drawn = times.where(F.col("__t").isNotNull() & (F.rand(7) < 1.0 / cell_rows))
    hot = cut(drawn.groupBy(*kn).agg(F.count(F.lit(1)).alias("__n"), F.sort_array(F.collect_set("__t")).alias("__s"))
              .where("__n > 1").drop("__n"), "asof-splits")
    total = hot.agg(F.sum(F.size("__s"))).first()[0]
    if not total:
        return None
    step = -(-total // MAX_SPLITTERS)
    return hot.withColumn("__s", F.filter("__s", lambda x, i: i % step == 0)) if step > 1 else hot


def _cell(s: Column, t: Column) -> Column:
    """Number of a time among sorted splitters: ``2 i`` between the splitters i - 1 and i,
    ``2 i + 1`` at splitter i; 0 without splitters. Binary search."""
    def halve(a, _):
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = (a["lo"] < a["hi"]) & (F.get(s, mid) < t)
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"),
                        F.when((a["lo"] < a["hi"]) & ~below, mid).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(s) + 1)).cast("int"))
    found = F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(s).alias("hi")), halve, lambda a: a["lo"])
    place = F.element_at(F.transform(F.array(found), lambda i: i * 2 + F.coalesce((F.get(s, i) == t).cast("int"), F.lit(0))), 1)
    return F.when(s.isNull() | t.isNull(), 0).otherwise(place)


def _bucketed(L: DataFrame, R: DataFrame, kn: list[str], direction: str, cell_rows: int) -> DataFrame:
    """Time split at the data's own quantiles. Keys within a cell's size take one window, one
    shuffle and no carry. Of a hot key each interval between splitters is a cell of its own and
    so is each splitter instant; the rows that cells hand on are kept per (key, cell). At one
    instant all left rows have the same answer, which is the carry itself: they are spread
    freely, and the right rows there pre-aggregate, so a burst at one time divides as well."""
    splits = find_splits(L, R, kn, cell_rows)
    if splits is None:
        return _window(L, R, kn, direction)
    R = _distinct_times(R, kn, direction)

    def celled(df: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(splits), kn, how).withColumn("__c", _cell(F.col("__s"), F.col("__t"))).drop("__s")

    at = F.col("__c") % 2 == 1
    U = celled(_union(L, R), "left").where((F.col("__side") == 1) | ~at)
    U = U.withColumn("__z", _spread(F.coalesce(F.col("__free"), F.lit(False)) | at))
    local = _windowed(U, [*kn, "__c", "__z"], direction)
    pick = F.max_by if direction == "backward" else F.min_by
    handed = celled(R, "inner").groupBy(*kn, "__c").agg(pick("__r", F.struct("__t", "__o")).alias("__own"))
    cells = splits.select(*kn, F.explode(F.sequence(F.lit(0), F.size("__s") * 2)).alias("__c"))
    order = F.col("__c").asc() if direction == "backward" else F.col("__c").desc()
    before = Window.partitionBy(*kn).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.join(handed, [*kn, "__c"], "left").withColumn("__before", F.last("__own", ignorenulls=True).over(before))
    carry = carry.select(*kn, "__c", F.when(at, F.coalesce("__own", "__before")).otherwise(F.col("__before")).alias("__carry"))
    return (local.join(carry.where("__carry IS NOT NULL"), [*kn, "__c"], "left")
            .withColumn("__m", F.when(~F.col("__free"), F.coalesce("__ml", "__carry"))))


def _broadcast(L: DataFrame, R: DataFrame, kn: list[str], direction: str, stats: RightStats) -> DataFrame:
    """Map-side range probe against validity intervals of the right side.

    A key with many right rows (a hot machine) would make each probe scan all of
    them, so the bounded intervals are keyed by a time period as well (each listed
    under every period it overlaps) and the open-ended interval of each key is
    probed separately: two broadcast joins, a few candidates per probe.
    """
    w = Window.partitionBy(*kn).orderBy(F.col("__t").asc(), F.col("__o").asc_nulls_first())
    if direction == "backward":
        # valid on [t, next t): of equal times only the last tie is non-empty
        bound = F.lead("__t").over(w)
    else:
        # valid on (previous t, t]: of equal times only the first tie is non-empty
        bound = F.lag("__t").over(w)
    rn = [f"__rk{i}" for i in range(len(kn))]
    Rv = R.select(*[F.col(k).alias(r) for k, r in zip(kn, rn)],
                  F.col("__t").alias("__rt"), bound.alias("__rb"), F.col("__r").alias("__m"))
    t, rt, rb = F.col("__t"), F.col("__rt"), F.col("__rb")
    keys_eq = [F.col(k) == F.col(r) for k, r in zip(kn, rn)]
    inside = [t >= rt, t < rb] if direction == "backward" else [t <= rt, t > rb]
    extra = [~F.col("__free")]

    period = stats.probe_period()
    # periods are clamped to the right side's finite time range on both sides,
    # which keeps the lists finite even for sentinel times
    lo_p = (stats.t_min or 0) // period
    hi_p = max(lo_p, (stats.t_max or 0) // period)

    def per(c: Column) -> Column:
        return F.least(F.greatest(F.call_function("div", c, F.lit(period).cast("bigint")),
                                  F.lit(lo_p)), F.lit(hi_p))
    if direction == "backward":
        first, last = per(rt), per(rb - F.lit(1))
    else:
        first, last = per(F.when(rb < F.lit(S.LONG_MAX), rb + F.lit(1)).otherwise(rb)), per(rt)
    bounded = (Rv.where(rb.isNotNull() & (first <= last))
               .withColumn("__rp", F.explode(F.sequence(first, last))))
    opened = Rv.where(rb.isNull()).drop("__rb").withColumnRenamed("__m", "__mo") \
        .withColumnRenamed("__rt", "__rto")
    probe = L.withColumn("__lp", per(t))
    m1 = probe.join(F.broadcast(bounded), _and(keys_eq + [F.col("__lp") == F.col("__rp")] + inside + extra),
                    "left").drop(*rn, "__rt", "__rb", "__rp", "__lp")
    o_cond = [F.col(k) == F.col(r) for k, r in zip(kn, rn)] + \
        ([t >= F.col("__rto")] if direction == "backward" else [t <= F.col("__rto")]) + extra
    m2 = m1.join(F.broadcast(opened), _and(o_cond), "left").drop(*rn, "__rto")
    return m2.withColumn("__m", F.coalesce("__m", "__mo")).drop("__mo")


def _and(conds: list[Column]) -> Column:
    c = conds[0]
    for x in conds[1:]:
        c = c & x
    return c


def carry_partition(
    df: DataFrame,
    *,
    keys: Sequence[str],
    time: Column,
    period: int = S.TIME_PERIOD,
    max_time: int = S.MAX_TIME,
    ties: Sequence[Column | str] = (),
) -> DataFrame:
    """Divide rows into (period, key) cells along the time axis.

    Each cell holds (a) the rows of that period and (b) for every later period up
    to the last, the latest row of the key from an earlier period
    (``is_carry = true``). Periods are ``min(t / period, max_time / period)``.
    Output: ``period``, the input columns, ``is_carry``. An empty input gives an
    empty output. The number of carried rows per key is bounded by the number of
    periods, never by the data.
    """
    ties = _cols(ties)
    last_p = max_time // period
    cols = df.columns
    base = df.withColumn("period", clamped_period(time, period, max_time)).withColumn("__t", time)
    latest = base.groupBy(*keys, "period").agg(
        F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]),
                 F.struct(F.col("__t"), *ties)).alias("__row"))
    nxt = F.lead("period").over(Window.partitionBy(*keys).orderBy("period"))
    stop = F.coalesce(nxt, F.lit(last_p).cast("bigint"))
    carried = (latest.withColumn("__stop", stop)
               .where(F.col("__stop") > F.col("period"))
               .select(F.explode(F.sequence(F.col("period") + 1, F.col("__stop"))).alias("period"),
                       "__row")
               .select("period", *[F.col(f"__row.`{c}`").alias(c) for c in cols])
               .withColumn("is_carry", F.lit(True)))
    own = base.drop("__t").withColumn("is_carry", F.lit(False))
    return own.select("period", *cols, "is_carry").unionByName(carried)
