"""As-of lookups and date spines.

Spark has no as-of join.  Two shapes are used, both bounded by days rather
than by the number of postings:

* :func:`explode_intervals` (the main one): a step series - one row per
  change date per key, e.g. running units or prices - gets its next change
  date with ``lead`` in one window; each row then emits the spine dates of
  its interval ``[date, next)`` (an array ``filter``, or ``sequence`` for a
  daily spine).  One pass, no union, no cross join; the window holds one key's
  change dates.
* :func:`asof_lookup`: "union + last non-null" for probe points that are not
  on a spine - tag series rows and distinct probe points, union them and carry
  the latest value forward with ``last(..., ignorenulls)`` over a window
  partitioned by the key and ordered by date.
* :func:`asof_join`: for unaggregated rows, when one key may hold a large share
  of them.  Time is cut into buckets; every bucket knows the series points in
  it and the value carried into it, so rows only need an equi-join by (key,
  bucket) and no window ever holds them.

Spines are ARRAY<DATE> columns (a parameter list, a generated ``sequence``, or
a small DataFrame turned into a scalar subquery) or a symbolic
:class:`DailySpine`.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAG = "__asof_tag"
_VAL = "__asof_val"


def asof_lookup(
    points: DataFrame,
    series: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    on: str = "date",
    *,
    inclusive: bool = True,
) -> DataFrame:
    """For every row of ``points`` (columns ``by`` + ``on``) attach the
    ``values`` of the latest ``series`` row with the same ``by`` key and
    ``series.on <= points.on`` (``<`` when ``inclusive`` is false).

    ``series`` must have at most one row per (by, on); dedup it first.
    Missing history gives NULL values.  Points keep any extra columns.
    """
    by = list(by)
    values = list(values)
    extra = [c for c in points.columns if c not in by + [on]]
    s = series.select(
        *by, on, F.struct(*values).alias(_VAL), F.lit(0 if inclusive else 2).alias(_TAG),
        *[F.lit(None).alias(c) for c in extra],
    )
    p = points.select(
        *by, on, F.lit(None).cast(s.schema[_VAL].dataType).alias(_VAL), F.lit(1).alias(_TAG), *extra
    )
    w = (
        Window.partitionBy(*by)
        .orderBy(F.col(on), F.col(_TAG))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = F.last(_VAL, ignorenulls=True).over(w)
    return (
        s.unionByName(p, allowMissingColumns=False)
        .withColumn(_VAL, found)
        .where(F.col(_TAG) == 1)
        .select(*by, on, *extra, *[F.col(f"{_VAL}.{v}").alias(v) for v in values])
    )


def _instant(df: DataFrame, on: str) -> Column:
    """A date or time column as a number: days or microseconds."""
    kind = df.schema[on].dataType
    return F.unix_date(on).cast("long") if isinstance(kind, T.DateType) else F.unix_micros(F.col(on).cast("timestamp"))


def asof_join(points: DataFrame, series: DataFrame, by: Sequence[str], values: Sequence[str], on: str = "date", *,
              inclusive: bool = True, days: float = 32, spread: int = 8) -> DataFrame:
    """:func:`asof_lookup` for rows of any number and skew.

    Buckets are ``days`` long.  The series' points are gathered by (key,
    bucket), and one window over *buckets* (not rows) carries each key's last
    value before a bucket into every bucket that has rows.  Rows then join that
    table by (key, bucket) and pick the last point not after them from its
    short array.  Each entry is copied ``spread`` times and the rows of a bucket
    are dealt over the copies, so that one key's busiest bucket is still many
    tasks.  What one task holds is the series' points of one bucket: choose
    ``days`` so that they are few (32 for a daily series).

    ``series`` must have at most one row per (by, on) and its ``on`` column the
    same type as that of ``points``.  Rows with a null key or time, and rows
    before a key's first point, get NULL values; series rows with a null time
    play no part.
    """
    by, values = list(by), list(values)
    width = max(1, round(days * (1 if isinstance(points.schema[on].dataType, T.DateType) else 86_400_000_000)))
    s = series.where(F.col(on).isNotNull()).select(*by, _instant(series, on).alias("__at"), F.struct(*values).alias(_VAL))
    held = s.withColumn("__b", F.col("__at") - F.pmod("__at", F.lit(width))).groupBy(*by, "__b").agg(
        F.array_sort(F.collect_list(F.struct("__at", _VAL))).alias("__pts"))
    rows = points.withColumn("__at", _instant(points, on))
    rows = rows.withColumn("__b", F.col("__at") - F.pmod("__at", F.lit(width)))
    wanted = rows.select(*by, "__b").distinct().withColumn("__want", F.lit(True))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    final = F.get(F.col("__pts"), F.size("__pts") - 1)[_VAL]
    table = wanted.join(held, [*by, "__b"], "full").withColumn("__carry", F.last(final, ignorenulls=True).over(w)).where("__want") \
        .select(*by, "__b", "__pts", "__carry", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("__s"))
    found = rows.withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.lit(spread)).cast("int")) \
        .join(table, [*by, "__b", "__s"], "left")
    before = F.filter("__pts", lambda p: (p["__at"] <= F.col("__at")) if inclusive else (p["__at"] < F.col("__at")))
    value = F.coalesce(F.get(before, F.size(before) - 1)[_VAL], F.col("__carry"))
    return found.withColumn(_VAL, value).select(*points.columns, *(F.col(f"{_VAL}.{v}").alias(v) for v in values))


def latest_value(series: DataFrame, by: Sequence[str], values: Sequence[str], on: str = "date") -> DataFrame:
    """The last row of each ``by`` group (an as-of lookup at +infinity);
    a plain aggregation with partial (map-side) combine."""
    best = F.max_by(F.struct(*values), F.col(on))
    return series.groupBy(*by).agg(best.alias(_VAL), F.max(on).alias(on)).select(
        *by, on, *[F.col(f"{_VAL}.{v}").alias(v) for v in values]
    )


# ---------------------------------------------------------------- spines

def _as_date(d) -> dt.date:
    if isinstance(d, dt.datetime):
        return d.date()
    if isinstance(d, dt.date):
        return d
    return dt.date.fromisoformat(str(d))


def dates_array(dates) -> Column:
    """Normalise a spine specification to an ARRAY<DATE> column.

    Accepts a Python iterable of dates/ISO strings (a parameter, as the
    reference passes a list of dates), a Column that already yields
    ARRAY<DATE>, or a small DataFrame with a ``date`` column (turned into a
    scalar subquery, evaluated once, so no cross join is planned).
    """
    if isinstance(dates, Column):
        return dates
    if isinstance(dates, DailySpine):
        return dates.array()
    if isinstance(dates, DataFrame):
        return dates.select(F.array_sort(F.collect_set(F.col("date").cast("date")))).scalar()
    ds = sorted({_as_date(d) for d in dates})
    if not ds:
        return F.array().cast("array<date>")
    return F.array(*[F.lit(d) for d in ds])


class DailySpine:
    """Every day from ``start`` to ``end`` (inclusive) - kept symbolic so a
    range of it can be generated with ``sequence`` instead of filtering a
    long array."""

    def __init__(self, start: Column, end: Column):
        self.start, self.end = start, end

    def array(self) -> Column:
        return _day_range(self.start, self.end)

    def between(self, lo: Column | None, hi: Column | None) -> Column:
        s = self.start if lo is None else F.greatest(lo, self.start)
        e = self.end if hi is None else F.least(F.date_sub(hi, 1), self.end)
        return _day_range(s, F.coalesce(e, self.end))


def _day_range(s: Column, e: Column) -> Column:
    return F.when(e >= s, F.sequence(s, e, F.expr("INTERVAL 1 DAY"))).otherwise(
        F.array().cast("array<date>")
    )


def daily_spine(start, end, *, inclusive: bool = True) -> DailySpine:
    """Every day from ``start`` to ``end``; the end day is dropped when
    ``inclusive`` is false (the reference's ``daterange``)."""
    s = start if isinstance(start, Column) else F.lit(_as_date(start))
    e = end if isinstance(end, Column) else F.lit(_as_date(end))
    if not inclusive:
        e = F.date_sub(e, 1)
    return DailySpine(s, e)


def spine_between(dates, lo: Column | None, hi: Column | None) -> Column:
    """Spine dates d with lo <= d < hi (a NULL bound is open)."""
    if isinstance(dates, DailySpine):
        return dates.between(lo, hi)
    arr = dates_array(dates)

    def keep(x):
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (lo.isNull() | (x >= lo))
        if hi is not None:
            cond = cond & (hi.isNull() | (x < hi))
        return cond

    return F.filter(arr, keep)


def explode_intervals(df: DataFrame, by: Sequence[str], dates, values: Sequence[str], *,
                      on: str = "date", fill_before: dict | None = None) -> DataFrame:
    """Turn a step series (one row per change date) into one row per spine
    date: each row holds its values on [on, next on) within its ``by`` group.

    ``fill_before`` (column -> value) also emits the spine dates before the
    group's first change with those constant values; otherwise they are
    absent.  The window is partitioned by ``by``; its size is the number of
    change dates of one group.
    """
    by = list(by)
    w = Window.partitionBy(*by).orderBy(on)
    nxt = F.lead(F.col(on)).over(w)
    first = F.lag(F.col(on)).over(w).isNull()
    # Spine bounds are projected into columns first: they may be scalar
    # subqueries, which Spark does not allow inside higher-order functions.
    if isinstance(dates, DailySpine):
        pre = [dates.start.alias("__sp_s"), dates.end.alias("__sp_e")]
        dates = DailySpine(F.col("__sp_s"), F.col("__sp_e"))
    else:
        pre = [dates_array(dates).alias("__sp")]
        dates = F.col("__sp")
    stepped = df.select(*by, on, *values, nxt.alias("__next"), first.alias("__first"), *pre)
    cur = F.transform(
        spine_between(dates, F.col(on), F.col("__next")),
        lambda d: F.struct(d.alias(on), *[F.col(v).alias(v) for v in values]),
    )
    if fill_before is not None:
        before = F.transform(
            F.when(F.col("__first"), spine_between(dates, None, F.col(on))).otherwise(
                F.array().cast("array<date>")
            ),
            lambda d: F.struct(
                d.alias(on),
                *[F.lit(fill_before[v]).cast(df.schema[v].dataType).alias(v) for v in values],
            ),
        )
        cur = F.concat(before, cur)
    return stepped.select(*by, F.inline(cur))


def month_start_spine(start_year: int | Column, end_year: int | Column) -> Column:
    """First day of every month from Jan 1 of ``start_year`` through Dec 1
    of ``end_year`` (the monthly rule of the P&L notebook)."""
    sy = start_year if isinstance(start_year, Column) else F.lit(start_year)
    ey = end_year if isinstance(end_year, Column) else F.lit(end_year)
    return F.sequence(F.make_date(sy, F.lit(1), F.lit(1)), F.make_date(ey, F.lit(12), F.lit(1)),
                      F.expr("INTERVAL 1 MONTH"))


def month_end_spine(start, end) -> Column:
    """Last day of every month between the months of ``start`` and ``end``.

    Built from month starts and ``last_day`` so it never drifts (stepping a
    month from the 31st would)."""
    s = start if isinstance(start, Column) else F.lit(_as_date(start))
    e = end if isinstance(end, Column) else F.lit(_as_date(end))
    starts = F.sequence(F.trunc(s, "month"), F.trunc(e, "month"), F.expr("INTERVAL 1 MONTH"))
    return F.transform(starts, lambda d: F.last_day(d))
