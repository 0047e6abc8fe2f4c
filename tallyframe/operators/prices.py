"""Price tables, as-of prices and currency conversion.

``prices``: (date, currency, amount, quote[, line_no]) - one unit of
``currency`` costs ``amount`` of ``quote`` on ``date``.

Conversion of a position (units ``number`` of ``currency``, optional cost in
``cost_currency``) to a target currency at a date follows the ledger tool's
rules: the target currency itself converts at 1; otherwise the latest direct
or inverse rate on or before the date; otherwise a hop through the cost
currency (currency -> cost currency -> target); otherwise the position is
left unconverted in its own currency.

Rates are resolved per day from the price table alone (a "rate calendar",
bounded by currency pairs x days) and equi-joined to the positions on
(base, quote, date).  Callers aggregate to (keys, date, currency, cost
currency) first - a rate depends on nothing else - so what is joined is a row
per day and currency, not a row per posting.

A price table that has the ledger's key columns holds each ledger's own
prices and is joined on them; one without them (``shared_prices``) is one
price list for all ledgers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from tallyframe.operators.asof import asof_join, explode_intervals, latest_value

RATE = "decimal(38,18)"
CONVERTED = "decimal(38,6)"  # converted amounts: exact for 2-decimal units x 4-decimal prices
# Two rates below HOP_LIMIT multiply to DECIMAL(38,23).  The product of two
# DECIMAL(38,18) has only 6 decimals; larger rates take it.
HOP_RATE, HOP_LIMIT = "decimal(25,18)", 10_000_000
BROADCAST_RATES = 100_000  # latest-rate tables of up to so many rows are broadcast to row-level conversions


def shared_prices(prices: DataFrame, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """The table as one price list for all ledgers."""
    return prices.drop(*keys)


def price_keys(prices: DataFrame, keys: Sequence[str] = ("ledger_id",)) -> list[str]:
    """The ledger keys that a price (or rate) table has."""
    return [k for k in keys if k in prices.columns]


def dedup_prices(prices: DataFrame, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """One price per ([keys,] currency, quote, date): the last one in file order
    (largest ``line_no``) when there is a ``line_no``, else the largest."""
    pick = (
        F.max_by("amount", "line_no") if "line_no" in prices.columns else F.max("amount")
    )
    return prices.groupBy(*price_keys(prices, keys), "currency", "quote", "date").agg(pick.alias("amount"))


def rate_table(prices: DataFrame, *, inverse: bool = True, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """([keys,] base, quote, date, rate): direct rates plus, when ``inverse``, the
    reciprocal of each rate for the opposite direction.  A direct
    observation wins over an inverted one on the same day.  Both directions
    come from one pass over the de-duplicated prices."""
    own = price_keys(prices, keys)
    p = dedup_prices(prices, keys).where(F.col("amount").isNotNull())
    direct = F.struct(F.col("currency").alias("base"), F.col("quote").alias("quote"),
                      F.col("amount").cast(RATE).alias("rate"), F.lit(0).alias("inv"))
    if not inverse:
        return p.select(*own, F.col("currency").alias("base"), "quote", "date", F.col("amount").cast(RATE).alias("rate"))
    inv = F.struct(F.col("quote").alias("base"), F.col("currency").alias("quote"),
                   (F.lit(1).cast(RATE) / F.col("amount")).cast(RATE).alias("rate"), F.lit(1).alias("inv"))
    both = p.select(*own, "date", F.inline(F.when(F.col("amount") != 0, F.array(direct, inv)).otherwise(F.array(direct))))
    return both.groupBy(*own, "base", "quote", "date").agg(F.min_by("rate", "inv").alias("rate"))


def latest_rates(rates: DataFrame, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """([keys,] base, quote, rate): the last rate of each pair."""
    return latest_value(rates, [*price_keys(rates, keys), "base", "quote"], ["rate"]).drop("date")


def broadcast_if_small(rates: DataFrame, most: int = BROADCAST_RATES) -> DataFrame:
    """``rates`` with a broadcast hint if it is counted to have at most
    ``most`` rows, for joins with unaggregated rows (hot currencies)."""
    return F.broadcast(rates) if rates.limit(most + 1).count() <= most else rates


def rate_calendar(rates: DataFrame, dates=None, *, keys: Sequence[str] = ("ledger_id",)) -> tuple[DataFrame, DataFrame | None]:
    """Rates resolved per day, computed from the price table alone.

    With a spine ``dates``: (base, quote, date, rate) for every spine date on
    or after a pair's first price; nothing else is needed.
    Without: a dense daily calendar of each pair from its first to its last
    price date, plus a ``tail`` (base, quote, last_date, last_rate) for probe
    dates after that.  Both are bounded by pairs x days and independent of
    the data being converted, so the wide side is scanned once and only
    equi-joined.
    """
    pair = [*price_keys(rates, keys), "base", "quote"]
    if dates is not None:
        return explode_intervals(rates, pair, dates, ["rate"]), None
    w = Window.partitionBy(*pair).orderBy("date")
    upto = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date"))
    dense = rates.select(*pair, "rate", "date", upto.alias("upto")).select(
        *pair, "rate", F.explode(F.sequence(F.col("date"), F.col("upto"))).alias("date"))
    tail = latest_value(rates, pair, ["rate"]).select(
        *pair, F.col("date").alias("last_date"), F.col("rate").alias("last_rate")
    )
    return dense, tail


def convert(
    df: DataFrame,
    prices: DataFrame,
    target: str,
    *,
    date: str | None = "date",
    spine=None,
    number: str = "number",
    currency: str = "currency",
    via: str | None = "cost_currency",
    inverse: bool = True,
    out_number: str = "conv_number",
    out_currency: str = "conv_currency",
    keys: Sequence[str] = ("ledger_id",),
    row_level: bool = False,
) -> DataFrame:
    """Add ``out_number``/``out_currency``: the position converted to
    ``target`` at the row's ``date`` column (``date=None``: latest price),
    unchanged when no conversion path exists.

    When every row's date is a date of a known spine, pass it as ``spine``
    so the rate calendar is built only for those dates.  ``row_level``: the
    rows are not aggregated, and no currency's rows may meet in one task: a
    latest-rate table counted to be small is then broadcast, and rates at the
    rows' dates are found by the bucketed :func:`asof_join`.

    The calendar (and tail) DataFrames are joined once per role (direct, and
    the two hops through ``via``) under different aliases of the *same*
    plan, so Spark builds and ships each of them once (reused exchange).
    """
    rates = rate_table(prices, inverse=inverse, keys=keys)
    own = price_keys(rates, keys)
    tgt = F.lit(target)
    # a via column that is a NULL literal would make the hop joins nested
    # loops; only a real column of currencies takes part
    has_via = (via is not None and via in df.columns
               and not isinstance(df.schema[via].dataType, T.NullType))
    if date is None:
        cal, tail = latest_rates(rates, keys), None
        if row_level:
            cal = broadcast_if_small(cal)
    elif row_level:
        cal, tail = rates, None
    else:
        cal, tail = rate_calendar(rates, spine, keys=keys)

    def lookup_rows(frame: DataFrame, base_col: str, quote, name: str) -> DataFrame:
        at = frame.withColumns({"__base": F.col(base_col), "__quote": frame[quote] if isinstance(quote, str) else quote,
                                "__on": F.col(date).cast("date")})
        series = rates.select(*own, F.col("base").alias("__base"), F.col("quote").alias("__quote"), F.col("date").alias("__on"),
                              F.col("rate").alias(name))
        return asof_join(at, series, [*own, "__base", "__quote"], [name], on="__on").drop("__base", "__quote", "__on")

    def lookup(frame: DataFrame, base_col: str, quote, name: str, tag: str) -> DataFrame:
        if row_level and date is not None:
            return lookup_rows(frame, base_col, quote, name)
        c = cal.alias(f"c_{tag}")
        q = frame[quote] if isinstance(quote, str) else quote
        cond = (frame[base_col] == F.col(f"c_{tag}.base")) & (q == F.col(f"c_{tag}.quote"))
        for k in own:
            cond = cond & (frame[k] == F.col(f"c_{tag}.{k}"))
        if date is not None:
            cond = cond & (frame[date] == F.col(f"c_{tag}.date"))
        out = frame.join(c, cond, "left").select(*[frame[x] for x in frame.columns],
                                                 F.col(f"c_{tag}.rate").alias(name))
        if tail is None:
            return out
        t = tail.alias(f"t_{tag}")
        q = out[quote] if isinstance(quote, str) else quote
        cond = (out[base_col] == F.col(f"t_{tag}.base")) & (q == F.col(f"t_{tag}.quote"))
        for k in own:
            cond = cond & (out[k] == F.col(f"t_{tag}.{k}"))
        fill = F.when(out[date] > F.col(f"t_{tag}.last_date"), F.col(f"t_{tag}.last_rate"))
        return out.join(t, cond, "left").select(
            *[out[x] for x in out.columns if x != name], F.coalesce(out[name], fill).alias(name))

    rows = lookup(df, currency, tgt, "__r_direct", "d")
    # Every product is cast to one explicit type: left to type coercion, a
    # CASE over DECIMAL(38,2) units and a DECIMAL(38,6) product widens by
    # keeping integer digits and silently rounds every product to cents.
    num_t = df.schema[number].dataType
    units = (F.col(number).cast(T.DecimalType(min(num_t.precision, 28), num_t.scale))
             if isinstance(num_t, T.DecimalType) else F.col(number))
    by = lambda rate: (units * rate).cast(CONVERTED)
    hop = F.lit(None).cast(CONVERTED)
    if has_via:
        rows = lookup(rows, currency, via, "__r1", "h1")
        rows = lookup(rows, via, tgt, "__r2", "h2")
        r1, r2 = F.col("__r1"), F.col("__r2")
        small = (r1 < HOP_LIMIT) & (r2 < HOP_LIMIT)
        exact = F.when(small, r1).cast(HOP_RATE) * F.when(small, r2).cast(HOP_RATE)
        hop = F.when(F.col(via).isNotNull() & (F.col(via) != tgt), F.when(small, by(exact)).otherwise(by(r1 * r2)))
    same = F.col(currency) == tgt
    converted = F.when(same, F.col(number).cast(CONVERTED)).otherwise(F.coalesce(by(F.col("__r_direct")), hop))
    return rows.select(
        *df.columns,
        F.coalesce(converted, F.col(number).cast(CONVERTED)).alias(out_number),
        F.when(same | converted.isNotNull(), tgt).otherwise(F.col(currency)).alias(out_currency),
    )
