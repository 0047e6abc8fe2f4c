"""Column builders over account names (``Type:Sub:Leaf``).  All JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of account types used by the account sort key, and
# the default net-worth categories (name, regex) checked in order, first match
# wins, anything else is "Other".
ACCOUNT_TYPE_ORDER = ["Assets", "Liabilities", "Equity", "Income", "Expenses"]

DEFAULT_ACCOUNT_CATEGORIES = [
    ("Cash and Bank Accounts", r"^Assets:.*:(Banks|Cash):"),
    ("Investments", r"^Assets:.*:Investments:"),
    ("Other Assets", r"^Assets:"),
    ("Liabilities/Credit Cards", r"^Liabilities:.*:CreditCards:"),
    ("Other Liabilities", r"^Liabilities:"),
]
OTHER_CATEGORY = "Other"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def account_match(pattern: str, account: str | Column = "account", *, ignore_case: bool = False) -> Column:
    """Unanchored regex search on the account name.

    Query-language filters (``account ~ '...'``) are case-insensitive;
    programmatic filters are case-sensitive regex searches.
    """
    return _col(account).rlike(("(?i)" if ignore_case else "") + pattern)


def account_parts(account: str | Column = "account") -> Column:
    return F.split(_col(account), ":")


def account_root(n: int, account: str | Column = "account") -> Column:
    """First ``n`` components; the whole name if it is shorter."""
    return F.array_join(F.slice(account_parts(account), 1, n), ":")


def account_component(i: int, account: str | Column = "account") -> Column:
    """Zero-based component ``i``; NULL when the name is shorter (ANSI-safe)."""
    return F.get(account_parts(account), i)


def account_type_rank(account: str | Column = "account") -> Column:
    """0 Assets, 1 Liabilities, 2 Equity, 3 Income, 4 Expenses, 5 otherwise."""
    first = account_component(0, account)
    expr = F.lit(len(ACCOUNT_TYPE_ORDER))
    for i, name in reversed(list(enumerate(ACCOUNT_TYPE_ORDER))):
        expr = F.when(first == name, F.lit(i)).otherwise(expr)
    return expr


def account_sortkey(account: str | Column = "account") -> Column:
    """Type rank digit followed by the name: ``'0-Assets:Bank'``."""
    return F.concat(account_type_rank(account).cast("string"), F.lit("-"), _col(account))


def is_balance_sheet(account: str | Column = "account") -> Column:
    """Assets and liabilities: sort key starts with 0 or 1."""
    return account_type_rank(account) <= 1


def classify_account(
    account: str | Column = "account",
    rules: Sequence[tuple[str, str | re.Pattern]] | Callable[[Column], Column] | None = None,
    default: str = OTHER_CATEGORY,
) -> Column:
    """Ordered (category, regex) rules compiled to one CASE WHEN chain, or a
    function from the account column to the category column; accounts that it
    gives NULL are ``default``."""
    if callable(rules):
        return F.coalesce(rules(_col(account)), F.lit(default))
    rules = DEFAULT_ACCOUNT_CATEGORIES if rules is None else rules
    expr = F.lit(default)
    for name, pattern in reversed(list(rules)):
        pat = pattern.pattern if isinstance(pattern, re.Pattern) else pattern
        expr = F.when(_col(account).rlike(pat), F.lit(name)).otherwise(expr)
    return expr


def ancestor_paths(account: str | Column = "account", min_depth: int = 2) -> Column:
    """ARRAY of every prefix path of the account from ``min_depth`` components
    down to the account itself: ``A:B:C`` -> ``[A:B, A:B:C]`` for depth 2."""
    parts = account_parts(account)
    return F.transform(
        F.sequence(F.lit(min_depth), F.greatest(F.size(parts), F.lit(min_depth))),
        lambda n: F.array_join(F.slice(parts, 1, n), ":"),
    )
