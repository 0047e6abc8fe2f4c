"""Missing price days.

Neither operator builds the (spine x currency) grid: each price row knows the
next price date of its currency, and the gap between them is generated
directly with ``sequence``.  Output size is the number of missing days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_match
from tallyframe.operators.asof import DailySpine, explode_intervals
from tallyframe.operators.prices import price_keys


def missing_prices(prices: DataFrame, start=None, end=None, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """([keys,] date, currency) for every day in [start, end] on which a
    currency of the price table has no price.  ``start``/``end`` default to
    the first and last price dates of the table, per ledger where the table
    holds each ledger's own prices."""
    own = price_keys(prices, keys)
    days = prices.select(*own, "currency", "date").distinct()
    if own:
        bounds = days.groupBy(*own).agg(F.min("date").alias("__lo"), F.max("date").alias("__hi"))
        days = days.join(bounds, own)
        lo, hi = F.col("__lo"), F.col("__hi")
    else:
        lo, hi = prices.select(F.min("date")).scalar(), prices.select(F.max("date")).scalar()
    lo = F.lit(start).cast("date") if start is not None else lo
    hi = F.lit(end).cast("date") if end is not None else hi
    w = Window.partitionBy(*own, "currency").orderBy("date")
    steps = days.select(
        *own, "currency", "date",
        F.lead("date").over(w).alias("next"),
        F.lag("date").over(w).isNull().alias("first"),
        lo.alias("lo"), hi.alias("hi"),          # bounds evaluated once, then columns
    )
    lo, hi = F.col("lo"), F.col("hi")
    # days strictly between this price and the next (or the end of the range)
    gap_lo = F.greatest(F.date_add("date", 1), lo)
    gap_hi = F.least(F.coalesce(F.date_sub("next", 1), hi), hi)
    between = F.when(gap_hi >= gap_lo, F.sequence(gap_lo, gap_hi)).otherwise(F.array().cast("array<date>"))
    # days before the currency's first price
    head_hi = F.least(F.date_sub("date", 1), hi)
    head = F.when(F.col("first") & (head_hi >= lo), F.sequence(lo, head_hi)).otherwise(
        F.array().cast("array<date>")
    )
    return steps.select(*own, F.explode(F.concat(head, between)).alias("date"), "currency")


def missing_prices_held(postings: DataFrame, prices: DataFrame, *, target: str = "USD",
                        account_re: str = "^Assets:", keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Missing price days restricted to the days a commodity is held (units
    of the matching accounts != 0 at the end of the day), per key.  Running
    units give holding intervals; the held days are anti-joined with the
    price days on ([keys,] currency, date).  Days are listed up to the last
    price date of the whole table."""
    p = postings.where(account_match(account_re) & (F.col("currency") != target))
    d = p.groupBy(*keys, "currency", "date").agg(F.sum("number").alias("delta"))
    w = Window.partitionBy(*keys, "currency").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    steps = d.select(*keys, "currency", "date", F.sum("delta").over(w).alias("units"))
    hi = prices.select(F.max("date")).scalar()
    held = explode_intervals(
        steps, [*keys, "currency"], DailySpine(F.lit(None).cast("date"), hi), ["units"]
    ).where(F.col("units") != 0)
    on = [*price_keys(prices, keys), "currency", "date"]
    return held.join(prices.select(*on).distinct(), on, "left_anti").select(*keys, "date", "currency")
