"""Spending targets from net worth.

Everything after the net-worth series is column arithmetic on one row per
(ledger, date): the three withdrawal variants are computed side by side in
one projection instead of three frames joined on date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.money import day_of_year, days_in_year, floor_thousand, least_of, pmt, pv
from tallyframe.operators.asof import asof_join

# Fixed values of the reference's spending notebooks.
WITHDRAWAL_RATE = 0.031
WITHDRAWAL_NPER = 72.335
PORTFOLIO_TARGET = 7_000_000
PORTFOLIO_TILT = 0.5
INCOME_TARGET = 225_000
INCOME_TILT = -0.5
DASH_PORTFOLIO_TARGET = 750_000
RATE_STEPS = [("01-01", 0.032), ("02-23", 0.031)]  # month-day from which a rate applies


def rate_schedule(date: str | Column = "date", steps=RATE_STEPS) -> Column:
    """Expected return for a date: a step function over the calendar year
    (0.032 before Feb 23, 0.031 from then on)."""
    d = F.col(date) if isinstance(date, str) else date
    expr = None
    for md, rate in sorted(steps):
        m, dd = (int(x) for x in md.split("-"))
        start = F.make_date(F.year(d), F.lit(m), F.lit(dd))
        expr = F.when(d >= start, F.lit(rate)) if expr is None else F.when(d >= start, F.lit(rate)).otherwise(expr)
    return expr


def rate_steps(points: DataFrame, steps: DataFrame, by: Sequence[str] = (), *, on: str = "date", effective: str = "effective",
               rate: str = "rate") -> DataFrame:
    """S13 / J8 in general: ``points`` with the ``rate`` of the step that holds
    at each row's date, from a table (by, effective, rate) of any number of
    steps on any dates; before the first step the rate is NULL.  Of steps of
    one ``by`` and date the largest rate holds."""
    one = steps.where(F.col(effective).isNotNull()).groupBy(*by, effective).agg(F.max(rate).alias(rate))
    keys = list(by) or ["__all"]
    if not by:  # a constant key; its rows are dealt over buckets and copies
        points, one = points.withColumn("__all", F.lit(0)), one.withColumn("__all", F.lit(0))
    out = asof_join(points, one.withColumnRenamed(effective, on), keys, [rate], on, days=366)
    return out.drop("__all")


def money2(c: Column) -> Column:
    """A double amount to DECIMAL(18,2), rounded half-up to cents.

    ``floor(x * 100 + 0.5)`` is exact IEEE arithmetic (the same in any
    engine), and whole cents x 0.01 is exact decimal arithmetic, so no
    engine-specific double-to-decimal rounding is involved."""
    cents_ = F.floor(c.cast("double") * 100 + 0.5).cast("decimal(20,0)")
    return (cents_ * F.lit(0.01).cast("decimal(3,2)")).cast("decimal(18,2)")


def pmt_withdrawal(networth: DataFrame, *, value: str = "net_worth", rate=WITHDRAWAL_RATE,
                   nper=WITHDRAWAL_NPER) -> DataFrame:
    """Annuity-due payment that spends ``value`` over ``nper`` years at
    ``rate`` (sign flipped to positive), with the day of year."""
    return networth.select(
        "*",
        F.lit(rate).alias("rate"), F.lit(nper).alias("nper"),
        money2(-pmt(F.lit(rate), F.lit(nper), F.col(value).cast("double"), 0.0, "begin")).alias("pmt"),
        day_of_year("date").alias("day_of_year"),
    )


def spend_target(pmt_col: Column, date: str = "date") -> tuple[Column, Column]:
    """(daily spend, year-to-date target) for an annual payment.  The target
    is exact decimal arithmetic, payment x day of year / days in year,
    rounded half-up to cents."""
    daily = pmt_col.cast("double") / days_in_year(date)
    target = F.round(pmt_col.cast("decimal(18,2)") * day_of_year(date) / days_in_year(date), 2)
    return daily, target


def tilt(pmt_col: Column, net_worth: Column, target: Column, tilt_amt: float) -> Column:
    """payment x (net worth / target) ** tilt; NULL unless the ratio is
    positive (a fractional power of a negative net worth is undefined)."""
    frac = F.try_divide(net_worth.cast("double"), target.cast("double"))
    return F.when(frac > 0, money2(pmt_col.cast("double") * F.pow(frac, F.lit(tilt_amt))))


def income_target_pv(rate=WITHDRAWAL_RATE, nper=WITHDRAWAL_NPER, income=INCOME_TARGET) -> Column:
    return pv(F.lit(rate), F.lit(nper), F.lit(-float(income)), 0.0)


def withdrawal_curves(networth: DataFrame, *, value: str = "net_worth") -> DataFrame:
    """Raw, portfolio-tilted and income-tilted payments and their year-to-date
    spending targets per (ledger, date), in one projection."""
    b = pmt_withdrawal(networth, value=value)
    nw = F.col(value)
    raw = F.col("pmt")
    port = tilt(raw, nw, F.lit(PORTFOLIO_TARGET), PORTFOLIO_TILT)
    inc = tilt(raw, nw, income_target_pv(), INCOME_TILT)
    out = b.select("*", port.alias("pmt_portfolio_tilt"), inc.alias("pmt_income_tilt"))
    _, t_raw = spend_target(F.col("pmt"))
    _, t_port = spend_target(F.col("pmt_portfolio_tilt"))
    _, t_inc = spend_target(F.col("pmt_income_tilt"))
    return out.select("*", t_raw.alias("target"), t_port.alias("target_portfolio_tilt"),
                      t_inc.alias("target_spending_tilt"))


def unpivot_series(df: DataFrame, ids: Sequence[str], values: Sequence[str],
                   variable: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), variable, value)


def pivot_series(df: DataFrame, ids: Sequence[str], variables: Sequence[str],
                 variable: str = "variable", value: str = "value") -> DataFrame:
    return df.groupBy(*ids).pivot(variable, list(variables)).agg(F.first(value))


def delta_trend(curves: DataFrame, income: DataFrame, spending: DataFrame | None = None, *,
                keys: Sequence[str] = ("ledger_id",), how: str = "inner", fill: bool = False) -> DataFrame:
    """How far spending is from the targets each day: tilt - spending,
    tilt - spending + income, raw target - spending + income, where tilt is
    the lower of the two tilted targets.  Inner joins (the reference's) keep
    only days with both income and spending.

    ``spending=None``: ``income`` is the combined frame of
    :func:`tallyframe.operators.flows.daily_income_spending` (one join
    instead of two).  With ``how="left"`` every target day is kept and
    ``fill`` carries the last running income / spending forward (0 before
    the first)."""
    t = curves.select(*keys, "date", "target", "target_portfolio_tilt", "target_spending_tilt",
                      least_of("target_portfolio_tilt", "target_spending_tilt").alias("tilt"))
    if spending is None:
        both = income
        if how == "inner":
            both = both.where(F.col("has_income") & F.col("has_spending"))
        t = t.join(both.select(*keys, "date", "income", "spending"), [*keys, "date"], how)
    else:
        t = t.join(income.select(*keys, "date", "income"), [*keys, "date"], how)
        t = t.join(spending.select(*keys, "date", "spending"), [*keys, "date"], how)
    if fill:
        wf = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        for c in ("income", "spending"):
            t = t.withColumn(c, F.coalesce(F.last(c, ignorenulls=True).over(wf), F.lit(0)))
    inc = F.col("income")
    sp = F.col("spending")
    return t.select(
        *keys, "date",
        (F.col("tilt") - sp).alias("tilt_trend"),
        (F.col("tilt") - sp + inc).alias("tilt_income_trend"),
        (F.col("target") - sp + inc).alias("notilt_income_trend"),
    )


def latest_points(df: DataFrame, *, keys: Sequence[str] = ("ledger_id",), order: str = "date") -> DataFrame:
    """Rows at the latest date of each key (ties kept)."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("__rk", F.rank().over(w)).where(F.col("__rk") == 1).drop("__rk")


def tilt_pmt_dashboard(networth: DataFrame, life_expectancy: Column | float, *, value: str = "net_worth",
                       date: str = "date", bequest: float = 0.0) -> DataFrame:
    """Raw and tilted payment for one date per ledger, floored to thousands.
    Rate from :func:`rate_schedule`, periods = household life expectancy,
    payment at the start of each period."""
    le = life_expectancy if isinstance(life_expectancy, Column) else F.lit(float(life_expectancy))
    er = rate_schedule(date)
    nw = F.col(value).cast("double")
    raw = -pmt(er, le, nw, F.lit(bequest), 1)
    port = raw * F.pow(nw / DASH_PORTFOLIO_TARGET, F.lit(PORTFOLIO_TILT))
    inc_pv = pv(er, le, F.lit(-float(INCOME_TARGET)), 0.0)
    inc = raw * F.pow(F.try_divide(nw, inc_pv), F.lit(INCOME_TILT))
    tilt_pmt = least_of(port, inc)
    return networth.select(
        "*", er.alias("rate"), floor_thousand(tilt_pmt).alias("tilt_pmt"), floor_thousand(raw).alias("raw_pmt")
    )


def spend_progress(ytd_spend: Column, tilt_pmt: Column, date: Column) -> tuple[Column, Column, Column]:
    """(% of the year gone, % of the tilted payment spent, on track) with the
    reference's 365-day year; percentages round half to even, like Python's
    ``round``."""
    doy_pct = F.bround(F.dayofyear(date) / 365 * 100, 0)
    spend_pct = F.bround(F.try_divide(ytd_spend.cast("double"), tilt_pmt.cast("double")) * 100, 0)
    return doy_pct, spend_pct, doy_pct >= spend_pct


def projected_spend(ytd: Column, total: Column, today: Column, trend_start: Column) -> Column:
    """YTD spend plus the average daily required spend since ``trend_start``
    times the days left in a 365-day year."""
    days_since = F.datediff(today, trend_start)
    daily = F.try_divide(total.cast("double"), days_since.cast("double"))
    return ytd.cast("double") + daily * (F.lit(365) - F.dayofyear(today))
