"""Holdings (A9, A10, A19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_match, account_sortkey, is_balance_sheet
from tallyframe.operators.prices import broadcast_if_small, latest_rates, price_keys, rate_table

# Currencies the missing-price notebook leaves out of its
# holdings snapshot.
IGNORED_SNAPSHOT_CURRENCIES = ["USD", "IRAUSD", "VACHR"]


def holdings(postings: DataFrame, prices: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Lots of the balance-sheet accounts grouped by (account, cost date,
    currency, cost currency, cost number): units, cost, the latest price of
    the currency in its cost currency, book value (units x cost) and market
    value (units x latest price; the units when there is no cost or price)."""
    p = postings.where(is_balance_sheet("account"))
    lots = p.groupBy(*keys, "account", "cost_date", "currency", "cost_currency", "cost_number").agg(
        F.sum("number").alias("units")
    )
    rates = latest_rates(rate_table(prices, keys=keys), keys)
    own = price_keys(rates, keys)
    last = broadcast_if_small(rates.select(
        *own, F.col("base").alias("currency"), F.col("quote").alias("cost_currency"), F.col("rate").alias("price")
    ))
    j = lots.join(last, [*own, "currency", "cost_currency"], "left")
    has_cost = F.col("cost_number").isNotNull()
    priced = has_cost & F.col("price").isNotNull()
    return j.select(
        *keys, "account", "currency", "units", F.col("cost_number").alias("cost"), "price",
        F.when(has_cost, F.col("units") * F.col("cost_number")).otherwise(F.col("units")).alias("book_value"),
        F.when(has_cost, F.col("cost_currency")).otherwise(F.col("currency")).alias("book_currency"),
        F.when(priced, F.col("units") * F.col("price")).otherwise(F.col("units")).alias("market_value"),
        F.when(priced, F.col("cost_currency")).otherwise(F.col("currency")).alias("market_currency"),
        F.col("cost_date").alias("acquisition_date"),
        account_sortkey("account").alias("sortkey"),
    )


def holdings_ordered(h: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    return h.orderBy(*keys, "sortkey", "currency", "acquisition_date")


def units_by_commodity(postings: DataFrame, account_re: str = "Assets:", *,
                       keys: Sequence[str] = ("ledger_id",), keep_zero: bool = False) -> DataFrame:
    """Total units per commodity over the matching accounts (zero dropped
    unless ``keep_zero``)."""
    out = (postings.where(account_match(account_re, ignore_case=True))
           .groupBy(*keys, "currency").agg(F.sum("number").alias("units")))
    return out if keep_zero else out.where(F.col("units") != 0)


def units_pivot(units: DataFrame, currencies: Sequence[str], *, keys: Sequence[str] = ("ledger_id",),
                others: str | None = None) -> DataFrame:
    """One column per currency (the wide presentation, U5); the currency list is
    explicit, so the pivot needs no extra pass.  Units of a currency outside the
    list are never lost: the query fails and names one, or, with ``others``,
    that column holds the rest as an array of (currency, units)."""
    listed = F.col("currency").isin(list(currencies))
    one = lambda c: F.first(F.when(F.col("currency") == c, F.col("units")), ignorenulls=True)
    if others is not None:
        rest = F.array_sort(F.collect_list(F.when(~F.coalesce(listed, F.lit(False)), F.struct("currency", "units"))))
        return units.groupBy(*keys).agg(*(one(c).alias(c) for c in currencies), rest.alias(others))
    stray = F.max(F.when(~F.coalesce(listed, F.lit(False)), F.coalesce("currency", F.lit("NULL"))))
    wide = units.groupBy(*keys).agg(*(one(c).alias(c) for c in currencies), stray.alias("__stray"))
    message = F.concat(F.lit("units_pivot: no column for currency "), F.col("__stray"))
    # in every column, so that no choice of columns prunes the check
    return wide.select(*keys, *(F.when(F.col("__stray").isNotNull(), F.raise_error(message)).otherwise(F.col(c)).alias(c)
                                for c in currencies))


def holdings_snapshot(postings: DataFrame, ignored: Sequence[str] = IGNORED_SNAPSHOT_CURRENCIES, *,
                      keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """For every day with a posting in a non-ignored currency: the units of
    every such commodity held after that day (all accounts), non-zero only.

    The key's posting days are numbered (``row_number`` per key over its
    distinct days).  A currency's running-units step starts on a posting
    day and lasts until its next step, so its range of day numbers comes
    from two equi-joins, and ``sequence`` over that range emits exactly the
    posting days it covers - no calendar days are generated and dropped.
    """
    p = postings.where(~F.col("currency").isin(list(ignored)))
    d = p.groupBy(*keys, "currency", "date").agg(F.sum("number").alias("delta"))
    w = Window.partitionBy(*keys, "currency").orderBy("date")
    steps = d.select(*keys, "currency", "date",
                     F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("units"),
                     F.lead("date").over(w).alias("next"))
    wd = Window.partitionBy(*keys).orderBy("date")
    days = d.select(*keys, "date").distinct().select(
        *keys, "date", F.row_number().over(wd).alias("k"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    lo = days.select(*keys, "date", F.col("k").alias("k_lo"), "n")
    hi = days.select(*keys, F.col("date").alias("next"), F.col("k").alias("k_hi"))
    ranged = steps.join(lo, [*keys, "date"]).join(hi, [*keys, "next"], "left")
    last_k = F.coalesce(F.col("k_hi") - 1, F.col("n"))
    covered = ranged.where(F.col("units") != 0).select(
        *keys, "currency", "units", F.explode(F.sequence(F.col("k_lo"), last_k)).alias("k"))
    return covered.join(days.select(*keys, "k", "date"), [*keys, "k"]).select(*keys, "currency", "date", "units")
