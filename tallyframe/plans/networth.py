"""Net worth over time.

Plan shape of :func:`networth_series` (the flagship):

1. filter postings by account regex, pre-aggregate to daily deltas per
   (ledger, currency)                        -> shuffle 1 (partial agg)
2. running sum + next change date per key    -> one window, same partitioning;
   each change row emits the spine dates of its [date, next date) interval
3. price at each spine date per currency     -> the same interval explode over
   the price table alone, independent of the postings
4. equi-join units to prices on (currency, date) and sum per (ledger, date)
   -> the price side is tiny (currencies x spine), AQE broadcasts it.

No step has a partition that grows with the number of postings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_match, classify_account
from tallyframe.operators.asof import explode_intervals
from tallyframe.operators.balances import asof_balances
from tallyframe.operators.prices import convert, dedup_prices, price_keys


def direct_prices_at(prices: DataFrame, dates, target: str, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """([keys,] currency, date, price): latest direct price in ``target`` on or before
    each spine date, for every currency priced in ``target``."""
    px = (
        dedup_prices(prices, keys)
        .where((F.col("quote") == target) & (F.col("currency") != target))
        .select(*price_keys(prices, keys), "currency", "date", F.col("amount").alias("price"))
    )
    return explode_intervals(px, [*price_keys(prices, keys), "currency"], dates, ["price"])


def _priced_units(units: DataFrame, prices: DataFrame, dates, target: str, keys: Sequence[str]) -> DataFrame:
    px = direct_prices_at(prices, dates, target, keys)
    j = units.join(px, [*price_keys(prices, keys), "currency", "date"], "left")
    price = F.when(F.col("currency") == target, F.lit(1).cast(j.schema["price"].dataType)).otherwise(
        F.col("price")
    )
    return j.withColumn("price", price)


def networth_series(
    postings: DataFrame,
    prices: DataFrame,
    dates,
    target: str = "USD",
    account_re: str = "Assets|Liabilities",
    *,
    keys: Sequence[str] = ("ledger_id",),
    ignore_case: bool = False,
) -> DataFrame:
    """Net worth at each spine date: sum over currencies of units held x the
    latest direct price in ``target`` (1 for ``target`` itself).  Currencies
    with no price yet contribute 0.  Lots are ignored (units only).

    Returns (keys..., date, net_worth DECIMAL).  Every key gets every date.
    """
    p = postings.where(account_match(account_re, ignore_case=ignore_case))
    units = asof_balances(p, dates, ["currency"], keys=keys)
    v = _priced_units(units, prices, dates, target, keys)
    value = F.when((F.col("units") != 0) & F.col("price").isNotNull(), F.col("units") * F.col("price"))
    return v.groupBy(*keys, "date").agg(
        F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")).alias("net_worth")
    )


def networth_held(units: DataFrame, prices: DataFrame, date, target: str = "USD", *,
                  keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """(keys, date, net_worth) of given units (keys, currency, units), e.g. of a
    stored balance, at the prices of a date, as :func:`networth_series`."""
    v = _priced_units(units.withColumn("date", F.lit(date).cast("date")), prices, [date], target, keys)
    value = F.when((F.col("units") != 0) & F.col("price").isNotNull(), F.col("units") * F.col("price"))
    return v.groupBy(*keys, "date").agg(F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")).alias("net_worth"))


def networth_detail(
    postings: DataFrame,
    prices: DataFrame,
    dates,
    target: str = "USD",
    account_re: str = "Assets|Liabilities",
    *,
    rules=None,
    keys: Sequence[str] = ("ledger_id",),
    ignore_case: bool = False,
) -> DataFrame:
    """Per date, account and currency: units, price, value and category, for
    holdings with units != 0 and a price.  Summing ``value`` per date gives
    :func:`networth_series`.  Dates before an account's first posting are not
    generated (change points only, no spine x all-accounts grid)."""
    p = postings.where(account_match(account_re, ignore_case=ignore_case))
    units = asof_balances(p, dates, ["account", "currency"], keys=keys, from_first=True)
    v = _priced_units(units, prices, dates, target, keys)
    return v.where((F.col("units") != 0) & F.col("price").isNotNull()).select(
        *keys, "date", "account", "currency", "units", "price",
        (F.col("units") * F.col("price")).alias("value"),
        classify_account("account", rules).alias("category"),
    )


def networth_converted(
    postings: DataFrame,
    prices: DataFrame,
    dates,
    target: str = "USD",
    account_re: str = "Assets|Liabilities",
    *,
    keys: Sequence[str] = ("ledger_id",),
    ignore_case: bool = False,
) -> DataFrame:
    """Net worth with full conversion rules (direct, inverse, via the cost
    currency), lots taken into account; positions that cannot be converted
    are left out of the ``target`` total."""
    p = postings.where(account_match(account_re, ignore_case=ignore_case))
    by = ["currency", "cost_currency"] if "cost_currency" in p.columns else ["currency"]
    units = asof_balances(p, dates, by, keys=keys)
    conv = convert(units.withColumnRenamed("units", "number"), prices, target, spine=dates,
                   via="cost_currency" if "cost_currency" in by else None, keys=keys)
    value = F.when(F.col("conv_currency") == target, F.col("conv_number"))
    return conv.groupBy(*keys, "date").agg(
        F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")).alias("net_worth")
    )


def networth_daily(postings, prices, start, end, target="USD", account_re="Assets|Liabilities", *,
                   inclusive: bool = False, keys=("ledger_id",)) -> DataFrame:
    """:func:`networth_series` on a daily spine; the end day is excluded by
    default, as in the reference's date range."""
    from tallyframe.operators.asof import daily_spine

    return networth_series(postings, prices, daily_spine(start, end, inclusive=inclusive), target,
                           account_re, keys=keys)


def pct_change(df: DataFrame, value: str, *, keys: Sequence[str] = ("ledger_id",), order: str = "date",
               out: str = "percent_change") -> DataFrame:
    """value / previous value - 1 per key in date order; NULL for the first
    row and when the previous value is 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(F.col(value)).over(w)
    return df.withColumn(out, F.try_divide(F.col(value).cast("double"), prev.cast("double")) - 1)


def networth_monthly(postings, prices, start_year: int, end_year: int, target="USD",
                     account_re="Assets|Liabilities", *, keys=("ledger_id",)) -> DataFrame:
    """Converted net worth on the first of each month from Jan 1 of
    ``start_year`` to Dec 1 of ``end_year`` (postings dated on or before the
    day), with the month-over-month change.  One pass instead of one query
    per month.  Account match is case-insensitive like the query language."""
    from tallyframe.operators.asof import month_start_spine

    nw = networth_converted(postings, prices, month_start_spine(start_year, end_year), target,
                            account_re, keys=keys, ignore_case=True)
    return pct_change(nw.withColumnRenamed("net_worth", "amount"), "amount", keys=keys)


def networth_summator(postings, prices, start, end, target="USD", account_re="Assets|Liabilities", *,
                      keys=("ledger_id",)) -> DataFrame:
    """Daily converted net worth from ``start`` to the day before ``end``
    (case-sensitive regex, lots converted individually)."""
    from tallyframe.operators.asof import daily_spine

    return networth_converted(postings, prices, daily_spine(start, end, inclusive=False), target,
                              account_re, keys=keys)


def networth_at(postings, prices, as_of, target="USD", account_re="Assets:", *, keys=("ledger_id",),
                postings_until=None) -> DataFrame:
    """Single-date converted net worth per key.  Like the dashboard query it
    sums all matching postings and converts at ``as_of``; pass
    ``postings_until`` to also cut postings by date."""
    p = postings.where(account_match(account_re, ignore_case=True))
    if postings_until is not None:
        p = p.where(F.col("date") <= F.lit(postings_until).cast("date"))
    by = ["currency", "cost_currency"] if "cost_currency" in p.columns else ["currency"]
    inv = p.groupBy(*keys, *by).agg(F.sum("number").alias("number"))
    conv = convert(inv.withColumn("date", F.lit(as_of).cast("date")), prices, target, spine=[as_of],
                   via="cost_currency" if "cost_currency" in by else None, keys=keys)
    value = F.when(F.col("conv_currency") == target, F.col("conv_number"))
    return conv.groupBy(*keys).agg(
        F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,6)")).alias("net_worth")
    )
