"""Inventories as long rows.

An inventory is a multiset of positions (currency, cost lot) -> units.  Here it
is a DataFrame of rows ``keys + [account] + [currency] + LOT + [number]``,
never a MAP, so every operation is a plain (partially pre-aggregated)
``groupBy``.  Lot columns are compared null-safely by ``groupBy``.  A zero
position does not exist in an inventory, so sums drop zero rows unless asked
to keep them.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_match, account_root
from tallyframe.operators.prices import broadcast_if_small, convert
from tallyframe.session import scratch_path

LOT = ["cost_number", "cost_currency", "cost_date"]


def _lot_cols(df: DataFrame, lots: bool) -> list[str]:
    return [c for c in LOT if lots and c in df.columns]


def inventory_sum(
    postings: DataFrame,
    by: Sequence[str] = ("account",),
    *,
    keys: Sequence[str] = ("ledger_id",),
    lots: bool = True,
    as_of=None,
    account_re: str | None = None,
    ignore_case: bool = False,
    root_n: int | None = None,
    keep_zero: bool = False,
) -> DataFrame:
    """``sum(position)`` grouped by ``keys + by``: units per (currency, lot).

    ``as_of`` keeps postings dated on or before it; ``account_re`` is an
    unanchored regex filter; ``root_n`` truncates the account to its first
    ``n`` components before grouping (``root(n, account)``).
    """
    p = postings
    if account_re is not None:
        p = p.where(account_match(account_re, ignore_case=ignore_case))
    if as_of is not None:
        p = p.where(F.col("date") <= F.lit(as_of).cast("date"))
    if root_n is not None and "account" in by:
        p = p.withColumn("account", account_root(root_n))
    group = [*keys, *by, "currency", *_lot_cols(p, lots)]
    out = p.groupBy(*group).agg(F.sum("number").alias("number"))
    return out if keep_zero else out.where(F.col("number") != 0)


def sum_by_root(postings: DataFrame, as_of, account_re: str, root_n: int = 100, *,
                keys: Sequence[str] = ("ledger_id",), ignore_case: bool = False) -> DataFrame:
    """Balances by the first ``root_n`` account components of the accounts
    matching ``account_re`` (case-sensitive by default), dated on or before
    ``as_of``; lots kept."""
    return inventory_sum(postings, ("account",), keys=keys, as_of=as_of, account_re=account_re,
                         ignore_case=ignore_case, root_n=root_n)


def sum_all(inventory: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """One inventory over all accounts of each key."""
    lots = [c for c in inventory.columns if c in LOT or c == "tracked_at_cost"]
    return (
        inventory.groupBy(*keys, "currency", *lots)
        .agg(F.sum("number").alias("number"))
        .where(F.col("number") != 0)
    )


def currency_set(inventory: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    return inventory.select(*keys, "currency").distinct()


def inventory_diff(left: DataFrame, right: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """``left - right`` per (keys, account) over the union of accounts.

    A negated union plus one aggregation (one shuffle, no full outer join).
    Accounts that net to nothing stay listed with zero positions; use
    :func:`clean_empty` to drop them.
    """
    group = [c for c in left.columns if c != "number"]
    neg = right.select(*group, (-F.col("number")).alias("number"))
    return left.select(*group, "number").unionByName(neg).groupBy(*group).agg(
        F.sum("number").alias("number")
    )


def currency_positions(inventory: DataFrame, currency: str) -> DataFrame:
    """Only the positions in ``currency`` (cost kept); accounts left empty vanish."""
    return inventory.where((F.col("currency") == currency) & (F.col("number") != 0))


def clean_empty(inventory: DataFrame) -> DataFrame:
    """Drop zero positions, so accounts whose inventory is empty vanish."""
    return inventory.where(F.col("number") != 0)


def is_empty(inventory: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Per key: true when every inventory is empty."""
    return inventory.groupBy(*keys).agg(
        (F.count_if(F.col("number") != 0) == 0).alias("is_empty")
    )


def _tolerance(tolerance: float | Mapping[str, float]) -> Column:
    if isinstance(tolerance, Mapping):
        if not tolerance:
            return F.lit(0).cast("decimal(38,18)")
        m = F.create_map(*[x for k, v in sorted(tolerance.items())
                           for x in (F.lit(k), F.lit(str(v)).cast("decimal(38,18)"))])
        return F.coalesce(F.try_element_at(m, F.col("currency")), F.lit(0).cast("decimal(38,18)"))
    return F.lit(str(tolerance)).cast("decimal(38,18)")


def _with_tolerance(inventory: DataFrame, tolerance: float | Mapping[str, float] | DataFrame) -> tuple[DataFrame, Column]:
    """The inventory and each row's tolerance.  A table (currency, tolerance),
    or with key columns of the inventory too, is joined; the largest value
    holds where a currency has several, and it is broadcast if counted small."""
    if not isinstance(tolerance, DataFrame):
        return inventory, _tolerance(tolerance)
    on = [c for c in tolerance.columns if c != "tolerance"]
    table = tolerance.groupBy(*on).agg(F.max("tolerance").cast("decimal(38,18)").alias("__tol"))
    return inventory.join(broadcast_if_small(table), on, "left"), F.coalesce("__tol", F.lit(0).cast("decimal(38,18)"))


def clean_small(inventory: DataFrame, tolerance: float | Mapping[str, float] | DataFrame, *,
                keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Drop accounts whose every position is within ``tolerance``: a number, or
    a per-currency map or table where missing currencies get 0."""
    inv, tol = _with_tolerance(inventory, tolerance)
    big = inv.groupBy(*keys, "account").agg(
        F.bool_or(F.abs(F.col("number")) > tol).alias("__big")
    ).where("__big").drop("__big")
    return inventory.join(big, [*keys, "account"], "left_semi")


def is_small(inventory: DataFrame, tolerance: float | Mapping[str, float] | DataFrame, *,
             keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    inv, tol = _with_tolerance(inventory, tolerance)
    return inv.groupBy(*keys).agg(
        F.coalesce(F.bool_and(F.abs(F.col("number")) <= tol), F.lit(True)).alias("is_small")
    )


def inventory_convert(inventory: DataFrame, prices: DataFrame, target: str, as_of=None, *,
                      keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Convert every position to ``target`` at ``as_of`` (latest price when
    None).  Positions held at cost are flagged ``tracked_at_cost`` instead of
    keeping their lot, so gains on cost-tracked holdings stay separable.
    Positions without a conversion path stay in their currency."""
    inv = inventory
    if as_of is not None:
        inv = inv.withColumn("date", F.lit(as_of).cast("date"))
    conv = convert(inv, prices, target, date=None if as_of is None else "date",
                   spine=None if as_of is None else [as_of], keys=keys)
    tracked = (F.col("cost_number").isNotNull() if "cost_number" in inventory.columns else F.lit(False))
    return (
        conv.groupBy(*keys, "account", F.col("conv_currency").alias("currency"),
                     tracked.alias("tracked_at_cost"))
        .agg(F.sum("conv_number").alias("number"))
        .where(F.col("number") != 0)
    )


def accounts_sorted(inventory: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    return inventory.orderBy(*keys, "account", "currency")


class BalanceCursor:
    """Forward-only ``sum_till_date`` over one set of postings (the batch twin
    of the streaming balances).

    The running inventory is a written table (one row per account root,
    currency and lot, zeros included) in the shared checkpoint folder; a call
    reads it and the postings after the last date only, up to the new one,
    and writes their sum.  Asking for an earlier date than the previous call
    raises ``ValueError``.  For many dates at once prefer
    :func:`tallyframe.operators.balances.asof_balances`, which answers a whole
    spine in one pass instead of one job per date.
    """

    def __init__(self, postings: DataFrame, account_re: str, root_n: int = 100, *,
                 keys: Sequence[str] = ("ledger_id",)):
        self.postings, self.account_re, self.root_n, self.keys = postings, account_re, root_n, tuple(keys)
        self.last_date, self.state = None, None

    def sum_till_date(self, date) -> DataFrame:
        d = date if isinstance(date, dt.date) else dt.date.fromisoformat(str(date))
        if self.last_date is not None and d < self.last_date:
            raise ValueError(f"sum_till_date({d}) after sum_till_date({self.last_date}): "
                             "a cursor only moves forward in time")
        new = self.postings if self.last_date is None else self.postings.where(F.col("date") > F.lit(self.last_date))
        total = inventory_sum(new, keys=self.keys, as_of=d, account_re=self.account_re, root_n=self.root_n, keep_zero=True)
        if self.state is not None:
            both = self.state.unionByName(total)
            total = both.groupBy(*[c for c in both.columns if c != "number"]).agg(F.sum("number").alias("number"))
        spark, schema = self.postings.sparkSession, total.schema
        path = scratch_path(spark, f"cursor-{uuid.uuid4().hex}")
        total.write.parquet(path)
        self.state, self.last_date = spark.read.schema(schema).parquet(path), d
        return self.state.where(F.col("number") != 0)
