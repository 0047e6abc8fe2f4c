"""Year-over-year expense tree.

The reference builds a nested dict in Python; here every account adds its
amount to all of its ancestor paths through one ``explode`` of the prefix
paths and one ``groupBy(path)`` with conditional sums for the two years.
Sibling order is a ``row_number`` over the parent.  Default years are picked
per ledger in Spark, never collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_component, account_match, ancestor_paths
from tallyframe.operators.prices import convert

# Categories excluded from the comparison by default (only
# those present in the data are applied).
DEFAULT_EXCLUDED = ["Taxes", "Interest"]


def expense_by_year_account(postings: DataFrame, prices: DataFrame, target: str = "USD", *,
                            account_re: str = "^Expenses", keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """``SUM(convert(position, target))`` by year and account, converted at the
    latest price; NULL when nothing in the group converts."""
    p = postings.where(account_match(account_re, ignore_case=True)).withColumn("year", F.year("date"))
    via = [c for c in ("cost_currency",) if c in p.columns]
    units = p.groupBy(*keys, "year", "account", "currency", *via).agg(F.sum("number").alias("number"))
    conv = convert(units, prices, target, date=None, keys=keys)
    amount = F.when(F.col("conv_currency") == target, F.col("conv_number"))
    return conv.groupBy(*keys, "year", "account").agg(F.sum(amount).alias("amount"))


def expense_accounts(postings: DataFrame, *, account_re: str = "^Expenses",
                     keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """(keys, year, account) of the expense postings: all that the lists of
    years, categories and leaves need, without any price."""
    p = postings.where(account_match(account_re, ignore_case=True))
    return p.select(*keys, F.year("date").alias("year"), "account").distinct()


def available_years(summary: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Distinct years per key with the current year (the latest) and the
    default comparison pair: the last two completed years; with one completed
    year both sides use it; with none, the last two years; with one year,
    that year twice."""
    years = summary.select(*keys, "year").distinct()
    w_desc = Window.partitionBy(*keys).orderBy(F.col("year").desc())
    ranked = years.withColumn("rk", F.row_number().over(w_desc))
    k = ranked.groupBy(*keys).agg(
        F.max("year").alias("current_year"),
        F.count("*").alias("n_years"),
        F.max(F.when(F.col("rk") == 2, F.col("year"))).alias("y2"),
        F.max(F.when(F.col("rk") == 3, F.col("year"))).alias("y3"),
    )
    completed = F.col("n_years") - 1
    left = (F.when(completed >= 2, F.col("y3")).when(completed == 1, F.col("y2"))
            .when(F.col("n_years") >= 2, F.col("y2")).otherwise(F.col("current_year")))
    right = (F.when(completed >= 1, F.col("y2")).otherwise(F.col("current_year")))
    defaults = k.select(*keys, "current_year", left.alias("default_left_year"),
                        right.alias("default_right_year"))
    return years.join(defaults, list(keys)).select(
        *keys, "year", (F.col("year") == F.col("current_year")).alias("is_current"),
        "default_left_year", "default_right_year",
    )


def expense_categories(summary: DataFrame, *, keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Distinct second components of the ``Expenses:`` accounts."""
    cat = account_component(1)
    return summary.where(F.col("account").startswith("Expenses:") & cat.isNotNull()).select(
        *keys, cat.alias("category")
    ).distinct()


def category_enabled(exclude: Sequence[str], invert: bool = False) -> Column:
    cat = account_component(1)
    inside = cat.isin(list(exclude)) if exclude else F.lit(False)
    return inside if invert else ~inside


def expense_tree(summary: DataFrame, left_year: int | str | Column | None = None,
                 right_year: int | str | Column | None = None, *, exclude: Sequence[str] | None = None,
                 invert: bool = False, keys: Sequence[str] = ("ledger_id",),
                 with_total: bool = True) -> DataFrame:
    """Every expense node (each prefix path from ``Expenses:X`` down to the
    leaves) with its left-year and right-year totals, the delta, its parent,
    depth and sibling rank (delta, then name, both descending).  A ``TOTAL``
    row (path ``__total__``) sums the top-level nodes.

    Years default to each ledger's default comparison pair.  ``exclude``
    defaults to Taxes and Interest; ``invert`` keeps only those categories.
    The default pair comes from a window over the summary (accounts x years
    rows per ledger), so the summary is computed once.
    """
    s = summary
    if left_year is None or right_year is None:
        ys = F.collect_set("year").over(Window.partitionBy(*keys))
        s = s.withColumn("__ys", F.sort_array(ys, asc=False))
    s = s.where(F.col("account").startswith("Expenses:"))
    if exclude is None:
        exclude = DEFAULT_EXCLUDED
    s = s.where(category_enabled(exclude, invert))
    if left_year is None or right_year is None:
        # the last two completed years, or what there is of them
        y = lambda k: F.get("__ys", F.least(F.lit(k), F.size("__ys") - 1))
        ly, ry = y(2), y(1)
    else:
        ly = left_year if isinstance(left_year, Column) else F.lit(int(left_year))
        ry = right_year if isinstance(right_year, Column) else F.lit(int(right_year))
    amt = F.coalesce(F.col("amount"), F.lit(0).cast(s.schema["amount"].dataType))
    s = s.select(
        *keys, F.explode(ancestor_paths("account", 2)).alias("path"),
        F.when(F.col("year") == ly, amt).alias("l"), F.when(F.col("year") == ry, amt).alias("r"),
    )
    zero = F.lit(0).cast(s.schema["l"].dataType)
    nodes = s.groupBy(*keys, "path").agg(
        F.coalesce(F.sum("l"), zero).alias("left_amount"), F.coalesce(F.sum("r"), zero).alias("right_amount")
    )
    parts = F.split("path", ":")
    nodes = nodes.select(
        *keys, "path", F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("depth"),
        F.array_join(F.slice(parts, 1, F.size(parts) - 1), ":").alias("parent"),
        "left_amount", "right_amount", (F.col("right_amount") - F.col("left_amount")).alias("delta"),
    )
    w = Window.partitionBy(*keys, "parent").orderBy(F.col("delta").desc(), F.col("name").desc())
    nodes = nodes.withColumn("sibling_rank", F.row_number().over(w))
    if not with_total:
        return nodes
    total = nodes.where(F.col("depth") == 1).groupBy(*keys).agg(
        F.sum("left_amount").alias("left_amount"), F.sum("right_amount").alias("right_amount"),
        F.sum("delta").alias("delta"),
    ).select(
        *keys, F.lit("__total__").alias("path"), F.lit("TOTAL").alias("name"), F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent"), "left_amount", "right_amount", "delta",
        F.lit(0).alias("sibling_rank"),
    )
    return total.unionByName(nodes)


def leaf_accounts(summary: DataFrame, *, exclude: Sequence[str] | None = None, invert: bool = False,
                  keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    s = summary.where(F.col("account").startswith("Expenses:"))
    s = s.where(category_enabled(DEFAULT_EXCLUDED if exclude is None else exclude, invert))
    return s.select(*keys, "account").distinct()


def drill_down(transactions: DataFrame, leaves: DataFrame, account: str, years: Sequence[int], *,
               keys: Sequence[str] = ("ledger_id",)) -> DataFrame:
    """Postings of one leaf account in the chosen years: date, payee,
    narration (NULL -> '') and amount; nothing when the account is not a leaf
    of the tree."""
    t = transactions.where((F.col("account") == account) & F.col("year").isin([int(y) for y in years]))
    t = t.join(leaves.where(F.col("account") == account), [*keys, "account"], "left_semi")
    return t.select(*keys, "date", F.coalesce("payee", F.lit("")).alias("payee"),
                    F.coalesce("narration", F.lit("")).alias("narration"), "amount")
