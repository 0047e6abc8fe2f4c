"""Income and spending flows.

All of them are filter -> ``groupBy`` (keys, date, currency) with map-side
partial aggregation -> conversion of the few rows left by equi-join to the
rate calendar -> final sum.  Year filters are rewritten as
date ranges so parquet statistics can prune row groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_match
from tallyframe.functions.money import cost_currency, cost_number
from tallyframe.operators.prices import convert

PERIOD_UNITS = {"Year": "year", "Quarter": "quarter", "Month": "month", "Week": "week"}


def year_range(years: tuple[int, int] | int) -> F.Column:
    lo, hi = (years, years) if isinstance(years, int) else years
    return (F.col("date") >= F.make_date(F.lit(lo), F.lit(1), F.lit(1))) & (
        F.col("date") < F.make_date(F.lit(hi + 1), F.lit(1), F.lit(1))
    )


def year_bounds(postings: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """First and last posting year per key (aggregates, no sort)."""
    return postings.groupBy(*keys).agg(
        F.year(F.min("date")).alias("first_year"), F.year(F.max("date")).alias("last_year")
    )


def at_cost(postings: DataFrame) -> DataFrame:
    """Replace each position by its amount at cost (``cost(position)``).

    The cost columns are dropped, not set to NULL: a NULL literal as the
    conversion's via-currency would turn its hop joins into nested loops."""
    out = postings.withColumn("number", cost_number()).withColumn("currency", cost_currency())
    return out.drop(*[c for c in ("cost_number", "cost_currency", "cost_date") if c in postings.columns])


def income_postings(postings: DataFrame, years: tuple[int, int], account_re: str = "Income") -> DataFrame:
    """All income postings in a year range (``account ~ 'Income'``)."""
    return postings.where(account_match(account_re, ignore_case=True) & year_range(years)).withColumn(
        "year", F.year("date")
    )


def expense_postings(postings: DataFrame, prices: DataFrame, target: str = "USD",
                     account_re: str = "^Expenses") -> DataFrame:
    """date, year, account, payee, narration and the posting converted to
    ``target`` at the latest price (``convert(position, 'USD')``)."""
    p = postings.where(account_match(account_re, ignore_case=True))
    conv = convert(p, prices, target, date=None, row_level=True)
    return conv.select(
        *[c for c in ("ledger_id",) if c in p.columns], "date", F.year("date").alias("year"), "account",
        "payee", "narration",
        F.when(F.col("conv_currency") == target, F.col("conv_number")).alias("amount"),
    )


def converted_cost_sum(postings: DataFrame, prices: DataFrame, target: str, *, group: Sequence[str],
                       keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """``sum(convert(cost(position), target, date))``: postings at cost,
    converted at their date; only the ``target`` part is summed (NULL when
    nothing converts).  Postings of one date and currency share their rate, so
    they are summed before the conversion."""
    by = [*keys, *(c for c in group if c != "date"), "date", "currency"]
    daily = at_cost(postings).groupBy(*by).agg(F.sum("number").alias("number"))
    conv = convert(daily, prices, target, date="date", keys=keys)
    amount = F.when(F.col("conv_currency") == target, F.col("conv_number"))
    return conv.groupBy(*keys, *group).agg(F.sum(amount).alias("amount"))


def total_spend(postings: DataFrame, prices: DataFrame, start, target: str = "USD", *,
                exclude_re: Sequence[str] = (), exclude_accounts: Sequence[str] = (),
                end=None, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Expenses at cost converted at the posting date, from ``start``."""
    p = postings.where(account_match("Expenses:", ignore_case=True) & (F.col("date") >= F.lit(start).cast("date")))
    if end is not None:
        p = p.where(F.col("date") <= F.lit(end).cast("date"))
    for rx in exclude_re:
        p = p.where(~account_match(rx, ignore_case=True))
    if exclude_accounts:
        p = p.where(~F.col("account").isin(list(exclude_accounts)))
    return converted_cost_sum(p, prices, target, group=(), keys=keys).withColumnRenamed("amount", "balance")


def income_total(postings: DataFrame, prices: DataFrame, accounts: Sequence[str], year: int,
                 target: str = "USD", *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """abs(sum(convert(cost(position), target, date))) over the given income
    accounts in ``year``; abs is applied after the sum."""
    p = postings.where(F.col("account").isin(list(accounts)) & year_range(year))
    s = converted_cost_sum(p, prices, target, group=(), keys=keys)
    return s.select(*keys, F.abs("amount").alias("income"))


def daily_flow(postings: DataFrame, prices: DataFrame, year: int, target: str = "USD", *,
               accounts: Sequence[str] | None = None, account_re: str | None = None,
               abs_per_day: bool = False, out: str = "cumulative",
               keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Per-day converted cost in ``year`` and its running total.

    Income (``abs_per_day``) takes abs of each day's sum before the running
    total, as the spending notebook does.  The running window is partitioned
    by key and year, ordered by date: one row per day, bounded by 366.
    """
    p = postings.where(year_range(year))
    if accounts is not None:
        p = p.where(F.col("account").isin(list(accounts)))
    if account_re is not None:
        p = p.where(account_match(account_re, ignore_case=True))
    day = converted_cost_sum(p, prices, target, group=("date",), keys=keys)
    if abs_per_day:
        day = day.withColumn("amount", F.abs("amount"))
    w = Window.partitionBy(*keys, F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn(out, F.sum("amount").over(w))


def expenses_by_period(postings: DataFrame, unit: str = "Month", currency: str = "USD", *,
                       years: tuple[int, int] | None = None, account_re: str = "Expenses",
                       keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Sum of the ``currency`` units of expense postings per calendar bucket
    (Year/Quarter/Month/Week; weeks start on Monday).  No conversion: other
    currencies add nothing, but a bucket with only such postings still
    appears with 0.  Empty buckets are absent."""
    p = postings.where(account_match(account_re, ignore_case=True))
    if years is not None:
        p = p.where(year_range(years))
    bucket = F.to_date(F.date_trunc(PERIOD_UNITS.get(unit, unit), F.col("date")))
    amt = F.when(F.col("currency") == currency, F.col("number"))
    return p.groupBy(*keys, bucket.alias("date")).agg(
        F.coalesce(F.sum(amt), F.lit(0).cast("decimal(28,2)")).alias("amount")
    )


def daily_income_spending(postings: DataFrame, prices: DataFrame, year: int, target: str = "USD", *,
                          income_accounts: Sequence[str], expense_re: str = "Expenses:",
                          keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Income (abs per day) and spending per day of ``year`` with their
    running totals, from one scan and one conversion: both flows are
    conditional sums of the same converted postings.  ``has_income`` /
    ``has_spending`` tell whether the day had postings of that flow."""
    is_inc = F.col("account").isin(list(income_accounts))
    is_exp = account_match(expense_re, ignore_case=True)
    p = postings.where(year_range(year) & (is_inc | is_exp)).withColumn("__inc", is_inc).withColumn("__exp", is_exp)
    daily = at_cost(p).groupBy(*keys, "date", "currency", "__inc", "__exp").agg(F.sum("number").alias("number"))
    conv = convert(daily, prices, target, date="date", keys=keys)
    amt = F.when(F.col("conv_currency") == target, F.col("conv_number"))
    day = conv.groupBy(*keys, "date").agg(
        F.abs(F.sum(F.when(F.col("__inc"), amt))).alias("income_amount"),
        F.sum(F.when(F.col("__exp"), amt)).alias("spending_amount"),
        F.max(F.col("__inc").cast("int")).cast("boolean").alias("has_income"),
        F.max(F.col("__exp").cast("int")).cast("boolean").alias("has_spending"),
    )
    w = Window.partitionBy(*keys, F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn("income", F.sum("income_amount").over(w)).withColumn(
        "spending", F.sum("spending_amount").over(w))


def conditional_cost_sums(postings: DataFrame, prices: DataFrame, target: str, sums: dict, *,
                          where=None, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Several ``sum(convert(cost(position), target, date))`` totals that
    differ only by a row predicate, from one scan and one conversion:
    ``sums`` maps output name -> Column predicate."""
    p = postings if where is None else postings.where(where)
    flags = {f"__c{i}": cond for i, cond in enumerate(sums.values())}
    p = p.select("*", *[c.alias(n) for n, c in flags.items()])
    daily = at_cost(p).groupBy(*keys, "date", "currency", *flags).agg(F.sum("number").alias("number"))
    conv = convert(daily, prices, target, date="date", keys=keys)
    amt = F.when(F.col("conv_currency") == target, F.col("conv_number"))
    return conv.groupBy(*keys).agg(*[F.sum(F.when(F.col(f), amt)).alias(name)
                                     for name, f in zip(sums, flags)])
