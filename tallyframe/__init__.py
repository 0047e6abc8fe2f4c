"""tallyframe - double-entry ledger analytics on Spark DataFrames.

Typical use::

    from tallyframe import get_spark, load_ledger, networth_series, month_end_spine
    spark = get_spark()
    t = load_ledger(spark, ["ledgers/*.txt"])
    nw = networth_series(t.postings, t.prices, month_end_spine("2015-01-01", "2017-12-31"), "USD")

Every function takes and returns DataFrames (or Column builders); nothing is
collected to the driver.
"""

from tallyframe.functions.accounts import (  # noqa: F401
    account_component, account_match, account_root, account_sortkey, classify_account,
)
from tallyframe.functions.money import cost_number, format_amount, pmt, pv  # noqa: F401
from tallyframe.operators.actuarial import (  # noqa: F401
    conservative_life_expectancy, extend_life_table, improve, joint_life_percentile, life_table,
    load_life_table, survival_probs,
)
from tallyframe.operators.asof import (  # noqa: F401
    asof_lookup, daily_spine, explode_intervals, month_end_spine, month_start_spine,
)
from tallyframe.operators.balances import asof_balances, running_units  # noqa: F401
from tallyframe.operators.checks import ledger_errors  # noqa: F401
from tallyframe.operators.flows import (  # noqa: F401
    daily_flow, expense_postings, expenses_by_period, income_postings, income_total, total_spend,
)
from tallyframe.operators.gaps import missing_prices, missing_prices_held  # noqa: F401
from tallyframe.operators.holdings import holdings, holdings_snapshot, units_by_commodity  # noqa: F401
from tallyframe.operators.inventory import (  # noqa: F401
    BalanceCursor, clean_empty, clean_small, inventory_convert, inventory_diff, inventory_sum, sum_all,
    sum_by_root,
)
from tallyframe.operators.prices import convert, rate_table  # noqa: F401
from tallyframe.operators.tree import available_years, drill_down, expense_by_year_account, expense_tree  # noqa: F401
from tallyframe.plans.finance import delta_trend, pmt_withdrawal, withdrawal_curves  # noqa: F401
from tallyframe.plans.networth import (  # noqa: F401
    networth_at, networth_daily, networth_detail, networth_monthly, networth_series, networth_summator,
)
from tallyframe.session import get_spark  # noqa: F401
from tallyframe.sources.ledger_text import load_ledger, load_ledger_text  # noqa: F401
from tallyframe.streaming.balances import balances_stream, period_expenses_stream  # noqa: F401

__version__ = "0.1.0"
