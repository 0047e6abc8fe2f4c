"""Column builders for amounts, annuities and formatting.  No Python UDFs:
annuity formulas are closed-form column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def cost_number(number="number", cost_number="cost_number") -> Column:
    """Amount at cost: units x cost per unit; the units when there is no cost."""
    return F.when(_c(cost_number).isNotNull(), _c(number) * _c(cost_number)).otherwise(_c(number))


def cost_currency(currency="currency", cost_currency="cost_currency") -> Column:
    return F.coalesce(_c(cost_currency), _c(currency))


# A weight has 16 decimals: the product of two amounts of 8.  Amounts and prices
# too large for an exact product are multiplied to 6 decimals.
WEIGHT = "decimal(38,16)"
EXACT_UNITS, EXACT_PRICE = "decimal(19,8)", "decimal(18,8)"


def _product(n: Column, price: Column) -> Column:
    small = (F.abs(n) < 10**11) & (F.abs(price) < 10**10)
    exact = F.when(small, n).cast(EXACT_UNITS) * F.when(small, price).cast(EXACT_PRICE)
    return F.when(small, exact).otherwise((n * price).cast(WEIGHT))


def weight_number() -> Column:
    """What a posting counts toward its transaction's balance: units at cost,
    else at price, else the units.  DECIMAL(38,16)."""
    n, price = F.col("number"), F.col("price_number")
    total = F.when(n < 0, -price).when(n > 0, price).otherwise(F.lit(0))
    return F.when(F.col("cost_number").isNotNull(), _product(n, F.col("cost_number"))) \
        .when(price.isNotNull() & F.col("price_is_total"), total.cast(WEIGHT)) \
        .when(price.isNotNull(), _product(n, price)).otherwise(n.cast(WEIGHT))


def weight_currency() -> Column:
    return F.coalesce("cost_currency", "price_currency", "currency")


def coerce_amount(x) -> Column:
    """NULL -> 0.0 as a double."""
    return F.coalesce(_c(x).cast("double"), F.lit(0.0))


def floor_thousand(x) -> Column:
    return F.floor(_c(x) / 1000) * 1000


def round_thousand(x) -> Column:
    """Nearest thousand, halves to even (Python ``round(x, -3)``)."""
    return F.bround(_c(x), -3).cast("long")


def days_in_year(date="date") -> Column:
    return F.dayofyear(F.make_date(F.year(_c(date)), F.lit(12), F.lit(31)))


def day_of_year(date="date") -> Column:
    return F.dayofyear(_c(date))


def least_of(*cols) -> Column:
    """Row-wise minimum with NULLs skipped."""
    return F.least(*[_c(c) for c in cols])


def _annuity_fact(rate: Column, nper: Column, when: Column) -> Column:
    q = F.pow(F.lit(1.0) + rate, nper)
    return F.when(rate == 0, nper).otherwise((F.lit(1.0) + rate * when) * (q - 1) / rate)


def _when_flag(when) -> Column:
    if isinstance(when, str) and when in ("begin", "end"):
        return F.lit(1.0 if when == "begin" else 0.0)
    return _c(when).cast("double")


def pmt(rate, nper, pv, fv=0.0, when="end") -> Column:
    """Annuity payment, numpy-financial convention (negative for a positive pv).

    ``when`` is ``'begin'``/``'end'`` or a 1/0 column.
    """
    r, n = _c(rate).cast("double"), _c(nper).cast("double")
    p, f = _c(pv).cast("double"), _c(fv).cast("double")
    q = F.pow(F.lit(1.0) + r, n)
    return -(f + p * q) / _annuity_fact(r, n, _when_flag(when))


def pv(rate, nper, payment, fv=0.0, when="end") -> Column:
    """Present value of an annuity, numpy-financial convention."""
    r, n = _c(rate).cast("double"), _c(nper).cast("double")
    a, f = _c(payment).cast("double"), _c(fv).cast("double")
    q = F.pow(F.lit(1.0) + r, n)
    return -(f + a * _annuity_fact(r, n, _when_flag(when))) / q


def format_amount(x, show_sign: bool = False) -> Column:
    """Rounded half-to-even to a whole number with thousands separators;
    with ``show_sign`` a leading + (also for zero) or -."""
    rounded = F.bround(_c(x).cast("double"), 0)
    body = F.format_number(F.abs(rounded), 0)
    if not show_sign:
        return F.when(rounded < 0, F.concat(F.lit("-"), body)).otherwise(body)
    return F.concat(F.when(rounded >= 0, F.lit("+")).otherwise(F.lit("-")), body)
