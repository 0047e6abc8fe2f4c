"""Running and as-of balances (units held on a date).

Rule for scale: postings are first pre-aggregated to one delta per
(key, currency[, account], day) - a ``groupBy`` with map-side partial
aggregation - so a hot currency or account holding a third of all postings
costs one row per day in the window, not one row per posting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators.asof import DailySpine, dates_array, explode_intervals


def daily_deltas(postings: DataFrame, by: Sequence[str], *, keys: Sequence[str] = ("ledger_id",),
                 number: str = "number") -> DataFrame:
    return postings.groupBy(*keys, *by, "date").agg(F.sum(number).alias("delta"))


def running_units(postings: DataFrame, by: Sequence[str] = ("currency",), *,
                  keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Cumulative units after each posting day: (keys, by, date, delta, units)."""
    d = daily_deltas(postings, by, keys=keys)
    w = Window.partitionBy(*keys, *by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("units", F.sum("delta").over(w))


def asof_balances(postings: DataFrame, dates, by: Sequence[str] = ("currency",), *,
                  keys: Sequence[str] = ("ledger_id",), from_first: bool = False) -> DataFrame:
    """Units per ``keys + by`` at every spine date (postings dated on or
    before it).

    One pass.  With a daily spine: daily deltas -> running sum with the next
    change date in the same window -> each change row emits the spine dates
    of its interval [date, next date).  With a list of dates: every daily
    delta goes to the slot of the first spine date on or after it and is
    summed there, so the window holds a row per slot with a change and each
    emits the slice of the spine up to the next.  Keys with no posting yet get 0 units on the earlier
    spine dates, unless ``from_first`` leaves those dates out.  No union with
    a separately computed key list, so the postings are read once.
    """
    key = [*keys, *by]
    d = daily_deltas(postings, by, keys=keys)
    if not isinstance(dates, DailySpine):
        return _slot_balances(d, dates, key, from_first)
    w = Window.partitionBy(*key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    steps = d.select(*key, "date", F.sum("delta").over(w).alias("units"))
    return explode_intervals(steps, key, dates, ["units"],
                             fill_before=None if from_first else {"units": 0})


def _slot_balances(deltas: DataFrame, dates, key: Sequence[str], from_first: bool) -> DataFrame:
    """:func:`asof_balances` of daily deltas on an ascending list of dates."""
    spine = dates_array(dates).alias("__sp")
    slot = F.size(F.filter("__sp", lambda x: x < F.col("date"))).alias("__slot")
    # one exchange by key serves the sum per slot and the window
    slots = deltas.repartition(*key).select(*key, "date", "delta", spine).select(*key, slot, "delta") \
        .groupBy(*key, "__slot").agg(F.sum("delta").alias("delta"))
    w = Window.partitionBy(*key).orderBy("__slot")
    steps = slots.select(*key, "__slot", spine, F.lead("__slot").over(w).alias("__next"),
                         F.lag("__slot").over(w).isNull().alias("__first"),
                         F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("units"))
    upto = F.coalesce("__next", F.size("__sp")) - F.col("__slot")
    emit = F.transform(F.slice("__sp", F.col("__slot") + 1, F.greatest(upto, F.lit(0))),
                       lambda d: F.struct(d.alias("date"), F.col("units").alias("units")))
    if not from_first:
        before = F.when(F.col("__first"), F.slice("__sp", F.lit(1), F.col("__slot"))).otherwise(F.array().cast("array<date>"))
        zero = F.lit(0).cast(steps.schema["units"].dataType)
        emit = F.concat(F.transform(before, lambda d: F.struct(d.alias("date"), zero.alias("units"))), emit)
    return steps.select(*key, F.inline(emit))
