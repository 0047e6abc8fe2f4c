"""Registered queries: one per operator of the survey inventory, each with a
DuckDB oracle.  Every query reads the driver's star tables through the
ledger views, so its work grows with the scale factor.

Report parameters (the reference's notebook inputs, fixed here):
reporting currency USD, the data's span 1995-01-01 .. 2001-08-31.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import accounts as acc
from tallyframe.operators import actuarial as act, checks, flows, gaps, holdings as hold, inventory as inv, tree
from tallyframe.operators.asof import month_end_spine
from tallyframe.operators.prices import broadcast_if_small, convert
from tallyframe.operators.ranking import global_rank
from tallyframe.plans import finance as fin, networth as nw
from tallyframe.plans.oracle import with_prelude
from tallyframe.plans.report import cents, money, ratio
from tallyframe.sources.star import star_balances, star_households

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TARGET = "USD"
BALANCE_SHEET = "Assets|Liabilities"
START, END = "1995-01-01", "2001-08-31"

# DuckDB: month ends of the report span, built from month starts.
SQL_MONTH_ENDS = (
    "SELECT CAST(last_day(CAST(d AS DATE)) AS DATE) AS date "
    "FROM generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 MONTH) t(d)"
)


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_prelude(sql)
        return fn
    return deco


_INGESTED: dict[tuple[str, str], str] = {}


_LEDGERS: dict[str, object] = {}


def ledger(spark, sf_dir):
    """The ledger tables of ``sf_dir``: ingested once per session into the
    shared checkpoint folder, then read as parquet by every query."""
    from tallyframe.sources.star import read_star_ledger

    path = ledger_path(spark, sf_dir)
    if path not in _LEDGERS:
        _LEDGERS[path] = read_star_ledger(spark, path)
    return _LEDGERS[path]


LEDGER_TABLES = ["region", "nation", "customer", "part", "orders", "lineitem"]


def ledger_key(spark, sf_dir) -> tuple[str, str]:
    """The session and the state of the tables of ``sf_dir``."""
    from tallyframe.session import file_stamps

    return spark.sparkContext.applicationId, file_stamps(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in LEDGER_TABLES])


def ledger_path(spark, sf_dir) -> str:
    """Folder of the ingested tables of ``sf_dir``; tables that were replaced
    under the same path are ingested again."""
    import hashlib

    from tallyframe.session import path_exists, scratch_path
    from tallyframe.sources.star import materialize_star_ledger

    app, stamp = key = ledger_key(spark, sf_dir)
    path = _INGESTED.get(key)
    if path is None or not path_exists(spark, f"{path}/postings/_SUCCESS"):
        digest = hashlib.sha1(f"{app}:{stamp}".encode()).hexdigest()[:16]
        path = scratch_path(spark, f"ledger-{digest}")
        materialize_star_ledger(spark, sf_dir, path)
        _LEDGERS.pop(path, None)
        _INGESTED[key] = path
    return path


# --------------------------------------------------------------- N1
@register("networth_series", f"""
, spine AS ({SQL_MONTH_ENDS}),
d AS (SELECT ledger_id, currency, date, SUM(number) AS delta FROM postings
      WHERE regexp_matches(account, 'Assets|Liabilities') GROUP BY ALL),
r AS (SELECT ledger_id, currency, date, SUM(delta) OVER (PARTITION BY ledger_id, currency ORDER BY date) AS units FROM d),
k AS (SELECT DISTINCT ledger_id, currency FROM d),
u AS (SELECT k.ledger_id, k.currency, s.date, COALESCE(r.units, 0) AS units
      FROM k CROSS JOIN spine s ASOF LEFT JOIN r ON r.ledger_id = k.ledger_id AND r.currency = k.currency AND r.date <= s.date),
px AS (SELECT currency, date, amount FROM prices WHERE quote = 'USD' AND currency <> 'USD'),
j AS (SELECT u.*, px.amount FROM u ASOF LEFT JOIN px ON px.currency = u.currency AND px.date <= u.date)
SELECT ledger_id, date,
  CAST(ROUND(SUM(CASE WHEN currency = 'USD' THEN CAST(units AS DECIMAL(38,6)) WHEN units <> 0 AND amount IS NOT NULL THEN CAST(CAST(units AS DECIMAL(20,2)) * amount AS DECIMAL(38,6)) ELSE CAST(0 AS DECIMAL(38,6)) END), 2) AS DOUBLE) AS net_worth
FROM j GROUP BY ledger_id, date
""")
def q_networth_series(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    out = nw.networth_series(L.postings, L.prices, month_end_spine(START, END), TARGET)
    return out.select("ledger_id", "date", money("net_worth"))


# ------------------------------------------------------------ shared SQL
def sql_units_at(spine_sql: str, where: str, by: str = "currency", *, from_first: bool = False) -> str:
    """CTEs ``spine``, ``d``, ``r``, ``k``, ``u``: units per (ledger, by) at
    each spine date."""
    join_spine = "JOIN spine s ON s.date >= k.first" if from_first else "CROSS JOIN spine s"
    keys = ", ".join(f"k.{c.strip()}" for c in by.split(","))
    conds = " AND ".join(f"r.{c.strip()} = k.{c.strip()}" for c in by.split(","))
    return f"""
, spine AS ({spine_sql}),
d AS (SELECT ledger_id, {by}, date, SUM(number) AS delta FROM postings WHERE {where} GROUP BY ALL),
r AS (SELECT ledger_id, {by}, date, SUM(delta) OVER (PARTITION BY ledger_id, {by} ORDER BY date) AS units FROM d),
k AS (SELECT ledger_id, {by}, MIN(date) AS first FROM d GROUP BY ALL),
u AS (SELECT k.ledger_id, {keys}, s.date, COALESCE(r.units, 0) AS units
      FROM k {join_spine} ASOF LEFT JOIN r ON r.ledger_id = k.ledger_id AND {conds} AND r.date <= s.date)"""


SQL_USD_PX = "px AS (SELECT currency, date, amount FROM prices WHERE quote = 'USD' AND currency <> 'USD')"
SQL_DAYS = ("SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 DAY) t(d)")
SQL_MONTH_STARTS = ("SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '{a}', DATE '{b}', INTERVAL 1 MONTH) t(d)")
SQL_ROOT2 = "array_to_string(list_slice(string_split(account, ':'), 1, 2), ':')"
SQL_CATEGORY = """CASE WHEN regexp_matches(account, '^Assets:.*:(Banks|Cash):') THEN 'Cash and Bank Accounts'
  WHEN regexp_matches(account, '^Assets:.*:Investments:') THEN 'Investments'
  WHEN regexp_matches(account, '^Assets:') THEN 'Other Assets'
  WHEN regexp_matches(account, '^Liabilities:.*:CreditCards:') THEN 'Liabilities/Credit Cards'
  WHEN regexp_matches(account, '^Liabilities:') THEN 'Other Liabilities' ELSE 'Other' END"""
# latest USD price per currency (no date limit)
SQL_LAST_PX = "lpx AS (SELECT currency, arg_max(amount, date) AS amount FROM prices WHERE quote = 'USD' GROUP BY currency)"
# USD price of each posting's currency on its date (as-of)
SQL_POSTING_PX = """pp AS (SELECT p.*, CASE WHEN p.currency = 'USD' THEN CAST(1 AS DECIMAL(18,4)) ELSE x.amount END AS rate
   FROM src p ASOF LEFT JOIN px x ON x.currency = p.currency AND x.date <= p.date)"""


def sql_networth(spine_sql: str, where: str, out: str = "net_worth") -> str:
    return sql_units_at(spine_sql, where) + f""",
{SQL_USD_PX},
j AS (SELECT u.*, px.amount FROM u ASOF LEFT JOIN px ON px.currency = u.currency AND px.date <= u.date),
n AS (SELECT ledger_id, date, SUM(CASE WHEN currency = 'USD' THEN CAST(units AS DECIMAL(38,6)) WHEN units <> 0 AND amount IS NOT NULL
        THEN CAST(CAST(units AS DECIMAL(20,2)) * amount AS DECIMAL(38,6)) ELSE CAST(0 AS DECIMAL(38,6)) END) AS v FROM j GROUP BY ledger_id, date)
"""


AS_OF, PREV = "1999-12-31", "1998-12-31"
YEAR = 2000
TODAY = "2000-06-30"
INCOME_ACCOUNTS = ["Income:BUILDING", "Income:MACHINERY", "Income:AUTOMOBILE"]
SQL_INCOME_ACCOUNTS = "('Income:BUILDING', 'Income:MACHINERY', 'Income:AUTOMOBILE')"
LEAF = "Expenses:LARGE:Brand4"
TOLERANCES = {"USD": 1000, "EUR": 500}

SQL_MONTH_ENDS_N = SQL_MONTH_ENDS
SQL_ASSETS_LIAB = "regexp_matches(account, 'Assets|Liabilities')"
SQL_ASSETS_LIAB_I = "regexp_matches(account, '(?i)Assets|Liabilities')"
DAILY_END_EXCL = "2001-08-30"


# --------------------------------------------------------------- N2
@register("networth_detail", sql_units_at(SQL_MONTH_ENDS, SQL_ASSETS_LIAB, "account, currency", from_first=True) + f""",
{SQL_USD_PX},
j AS (SELECT u.*, CASE WHEN u.currency = 'USD' THEN CAST(1 AS DECIMAL(18,4)) ELSE px.amount END AS price
      FROM u ASOF LEFT JOIN px ON px.currency = u.currency AND px.date <= u.date)
SELECT ledger_id, date, account, currency, CAST(ROUND(units, 2) AS DOUBLE) AS units, CAST(price AS DOUBLE) AS price,
  CAST(ROUND(CAST(units AS DECIMAL(20,2)) * price, 2) AS DOUBLE) AS value, {SQL_CATEGORY} AS category
FROM j WHERE units <> 0 AND price IS NOT NULL
""")
def q_networth_detail(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    d = nw.networth_detail(L.postings, L.prices, month_end_spine(START, END), TARGET)
    return d.select("ledger_id", "date", "account", "currency", money("units"),
                    F.col("price").cast("double").alias("price"), money("value"), "category")


# --------------------------------------------------------------- N3
@register("networth_daily", sql_networth(SQL_DAYS.format(a=START, b=DAILY_END_EXCL), SQL_ASSETS_LIAB)
          + "SELECT ledger_id, date, CAST(ROUND(v, 2) AS DOUBLE) AS net_worth FROM n")
def q_networth_daily(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    out = nw.networth_daily(L.postings, L.prices, START, END, TARGET)
    return out.select("ledger_id", "date", money("net_worth"))


# --------------------------------------------------------------- N4 + W5
@register("networth_monthly", sql_networth(SQL_MONTH_STARTS.format(a="1995-01-01", b="2001-12-01"), SQL_ASSETS_LIAB_I)
          + """SELECT ledger_id, date, CAST(ROUND(v, 2) AS DOUBLE) AS amount,
  ROUND(CAST(v AS DOUBLE) / NULLIF(CAST(LAG(v) OVER (PARTITION BY ledger_id ORDER BY date) AS DOUBLE), 0) - 1, 6) AS percent_change
FROM n""")
def q_networth_monthly(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET, ignore_case=True)
    out = nw.networth_monthly(L.postings, L.prices, 1995, 2001, TARGET)
    return out.select("ledger_id", "date", money("amount"), ratio("percent_change"))


# --------------------------------------------------------------- N5
@register("networth_summator", sql_networth(SQL_DAYS.format(a=START, b=DAILY_END_EXCL), SQL_ASSETS_LIAB)
          + "SELECT ledger_id, date, CAST(ROUND(v, 2) AS DOUBLE) AS net_worth FROM n")
def q_networth_summator(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    out = nw.networth_summator(L.postings, L.prices, START, END, TARGET)
    return out.select("ledger_id", "date", money("net_worth"))


# --------------------------------------------------------------- A2
@register("networth_at", f"""
, {SQL_USD_PX},
h AS (SELECT ledger_id, currency, SUM(number) AS units FROM postings WHERE regexp_matches(account, '(?i)Assets:') GROUP BY ALL),
lp AS (SELECT currency, arg_max(amount, date) AS amount FROM px WHERE date <= DATE '{TODAY}' GROUP BY currency)
SELECT ledger_id, CAST(ROUND(SUM(CASE WHEN h.currency = 'USD' THEN CAST(units AS DECIMAL(38,6)) WHEN lp.amount IS NOT NULL THEN CAST(CAST(units AS DECIMAL(20,2)) * lp.amount AS DECIMAL(38,6)) END), 2) AS DOUBLE) AS net_worth
FROM h LEFT JOIN lp USING (currency) GROUP BY ledger_id
""")
def q_networth_at(spark, sf_dir):
    L = ledger(spark, sf_dir).of("Assets:", ignore_case=True)
    return nw.networth_at(L.postings, L.prices, TODAY, TARGET).select("ledger_id", money("net_worth"))


# ------------------------------------------------------------ inventories
SQL_INV_AT = """SELECT ledger_id, {acct} AS account, currency, cost_number, cost_currency, cost_date, SUM(number) AS number
 FROM postings WHERE {where} GROUP BY ALL HAVING SUM(number) <> 0"""
INV_OUT = ("ledger_id, account, currency, CAST(cost_number AS DOUBLE) AS cost_number, cost_currency, cost_date, "
           "CAST(ROUND(number, 2) AS DOUBLE) AS number")


def _inv_out(df):
    return df.select("ledger_id", "account", "currency", F.col("cost_number").cast("double").alias("cost_number"),
                     "cost_currency", "cost_date", money("number"))


def _root_at(L, as_of):
    return inv.sum_by_root(L.of(BALANCE_SHEET, end=as_of).postings, as_of, BALANCE_SHEET, 2)


SQL_ROOT_AT = SQL_INV_AT.format(acct=SQL_ROOT2, where=f"{SQL_ASSETS_LIAB} AND date <= DATE '{{d}}'")


@register("inventory_sum", f"SELECT {INV_OUT} FROM ({SQL_INV_AT.format(acct='account', where='TRUE')})")
def q_inventory_sum(spark, sf_dir):
    return _inv_out(inv.inventory_sum(ledger(spark, sf_dir).postings))


@register("sum_by_root", f"SELECT {INV_OUT} FROM ({SQL_ROOT_AT.format(d=AS_OF)})")
def q_sum_by_root(spark, sf_dir):
    return _inv_out(_root_at(ledger(spark, sf_dir), AS_OF))


SNAPSHOT_DATES = ["1995-12-31", "1997-05-17", "2001-02-11"]


def balance_store(spark, sf_dir):
    """The ledger's posting store, its year-end balances written once."""
    store = ledger(spark, sf_dir).store
    if not store.snapshot_years():
        store.write_snapshots()
    return store


@register("sum_by_root_any_date", " UNION ALL ".join(
    f"SELECT DATE '{d}' AS date, {INV_OUT} FROM ({SQL_ROOT_AT.format(d=d)})" for d in SNAPSHOT_DATES))
def q_sum_by_root_any_date(spark, sf_dir):
    """A13 from stored history: the balances of the year end before each date
    and the postings after it."""
    store, out = balance_store(spark, sf_dir), None
    for d in SNAPSHOT_DATES:
        one = _inv_out(store.inventory_at(d, BALANCE_SHEET, root_n=2)).withColumn("date", F.lit(d).cast("date"))
        out = one if out is None else out.unionByName(one)
    return out


@register("networth_any_date", "".join(f""", u{i} AS (SELECT ledger_id, currency, SUM(number) AS units FROM postings
  WHERE {SQL_ASSETS_LIAB} AND date <= DATE '{d}' GROUP BY ALL),
p{i} AS (SELECT currency, arg_max(amount, date) AS amount FROM prices WHERE quote = 'USD' AND currency <> 'USD' AND date <= DATE '{d}' GROUP BY currency),
n{i} AS (SELECT ledger_id, DATE '{d}' AS date, CAST(ROUND(COALESCE(SUM(CASE WHEN currency = 'USD' THEN CAST(units AS DECIMAL(38,6)) WHEN units <> 0 AND amount IS NOT NULL
  THEN CAST(CAST(units AS DECIMAL(20,2)) * amount AS DECIMAL(38,6)) END), 0), 2) AS DOUBLE) AS net_worth FROM u{i} LEFT JOIN p{i} USING (currency) GROUP BY ledger_id)"""
    for i, d in enumerate(SNAPSHOT_DATES)) + "\n" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(len(SNAPSHOT_DATES))))
def q_networth_any_date(spark, sf_dir):
    """N3 for single dates from stored history."""
    L, store = ledger(spark, sf_dir), balance_store(spark, sf_dir)
    out = None
    for d in SNAPSHOT_DATES:
        held = store.balances_at(d, BALANCE_SHEET, lots=False)
        one = nw.networth_held(held.groupBy("ledger_id", "currency").agg(F.sum("number").alias("units")), L.prices, d, TARGET)
        out = one if out is None else out.unionByName(one)
    return out.select("ledger_id", "date", money("net_worth"))


SQL_CONVERTED_AT = f"""
, inv AS ({SQL_ROOT_AT.format(d=AS_OF)}),
lp AS (SELECT currency, arg_max(amount, date) AS amount FROM prices WHERE quote = 'USD' AND date <= DATE '{AS_OF}' GROUP BY currency),
c AS (SELECT inv.ledger_id, inv.account, inv.cost_number IS NOT NULL AS tracked_at_cost,
   CASE WHEN inv.currency = 'USD' THEN CAST(number AS DECIMAL(38,6)) WHEN lp.amount IS NOT NULL THEN CAST(CAST(number AS DECIMAL(20,2)) * lp.amount AS DECIMAL(38,6)) ELSE CAST(number AS DECIMAL(38,6)) END AS conv,
   CASE WHEN inv.currency = 'USD' OR lp.amount IS NOT NULL THEN 'USD' ELSE inv.currency END AS currency
   FROM inv LEFT JOIN lp USING (currency))"""


@register("inventory_convert", SQL_CONVERTED_AT + """
SELECT ledger_id, account, currency, tracked_at_cost, CAST(ROUND(SUM(conv), 2) AS DOUBLE) AS number
FROM c GROUP BY ALL HAVING SUM(conv) <> 0""")
def q_inventory_convert(spark, sf_dir):
    L = ledger(spark, sf_dir)
    c = inv.inventory_convert(_root_at(L, AS_OF), L.prices, TARGET, AS_OF)
    return c.select("ledger_id", "account", "currency", "tracked_at_cost", money("number"))


@register("sum_all", SQL_CONVERTED_AT + """
SELECT ledger_id, currency, tracked_at_cost, CAST(ROUND(SUM(conv), 2) AS DOUBLE) AS number
FROM (SELECT ledger_id, account, currency, tracked_at_cost, SUM(conv) AS conv FROM c GROUP BY ALL HAVING SUM(conv) <> 0)
GROUP BY ALL HAVING SUM(conv) <> 0""")
def q_sum_all(spark, sf_dir):
    L = ledger(spark, sf_dir)
    c = inv.inventory_convert(_root_at(L, AS_OF), L.prices, TARGET, AS_OF)
    return inv.sum_all(c).select("ledger_id", "currency", "tracked_at_cost", money("number"))


@register("currency_set", "SELECT DISTINCT ledger_id, currency FROM postings GROUP BY ledger_id, account, currency, "
          "cost_number, cost_currency, cost_date HAVING SUM(number) <> 0")
def q_currency_set(spark, sf_dir):
    return inv.currency_set(inv.inventory_sum(ledger(spark, sf_dir).postings))


SQL_DIFF = f"""
, a AS ({SQL_ROOT_AT.format(d=AS_OF)}), b AS ({SQL_ROOT_AT.format(d=PREV)}),
diff AS (SELECT ledger_id, account, currency, cost_number, cost_currency, cost_date, SUM(number) AS number FROM
  (SELECT * FROM a UNION ALL SELECT ledger_id, account, currency, cost_number, cost_currency, cost_date, -number FROM b)
  GROUP BY ALL)"""


def _diff(L):
    return inv.inventory_diff(_root_at(L, AS_OF), _root_at(L, PREV))


@register("inventory_diff", SQL_DIFF + f"\nSELECT {INV_OUT} FROM diff")
def q_inventory_diff(spark, sf_dir):
    return _inv_out(_diff(ledger(spark, sf_dir)))


@register("clean_empty", SQL_DIFF + f"\nSELECT {INV_OUT} FROM diff WHERE number <> 0")
def q_clean_empty(spark, sf_dir):
    return _inv_out(inv.clean_empty(_diff(ledger(spark, sf_dir))))


@register("is_empty", SQL_DIFF + "\nSELECT ledger_id, count_if(number <> 0) = 0 AS is_empty FROM diff GROUP BY ledger_id")
def q_is_empty(spark, sf_dir):
    return inv.is_empty(_diff(ledger(spark, sf_dir)))


@register("currency_positions", f"SELECT {INV_OUT} FROM ({SQL_ROOT_AT.format(d=AS_OF)}) WHERE currency = 'EUR'")
def q_currency_positions(spark, sf_dir):
    return _inv_out(inv.currency_positions(_root_at(ledger(spark, sf_dir), AS_OF), "EUR"))


SQL_TOL = "CASE currency WHEN 'USD' THEN 1000 WHEN 'EUR' THEN 500 ELSE 0 END"


@register("clean_small", f"""
, i AS ({SQL_ROOT_AT.format(d=AS_OF)}),
big AS (SELECT ledger_id, account FROM i GROUP BY ALL HAVING bool_or(abs(number) > {SQL_TOL}))
SELECT {INV_OUT} FROM i SEMI JOIN big USING (ledger_id, account)""")
def q_clean_small(spark, sf_dir):
    return _inv_out(inv.clean_small(_root_at(ledger(spark, sf_dir), AS_OF), TOLERANCES))


@register("is_small", f"""
, i AS ({SQL_ROOT_AT.format(d=AS_OF)})
SELECT ledger_id, bool_and(abs(number) <= 10000) AS is_small FROM i GROUP BY ledger_id""")
def q_is_small(spark, sf_dir):
    return inv.is_small(_root_at(ledger(spark, sf_dir), AS_OF), 10000)


# ------------------------------------------------------------ expense tree
SQL_SUMMARY = f"""
, {SQL_LAST_PX},
summary AS (SELECT p.ledger_id, year(p.date) AS year, p.account,
  SUM(CASE WHEN p.currency = 'USD' THEN CAST(p.number AS DECIMAL(38,6)) WHEN lpx.amount IS NOT NULL THEN CAST(p.number * lpx.amount AS DECIMAL(38,6)) END) AS amount
  FROM postings p LEFT JOIN lpx ON lpx.currency = p.currency WHERE regexp_matches(p.account, '(?i)^Expenses') GROUP BY ALL),
yrs AS (SELECT DISTINCT ledger_id, year FROM summary),
yk AS (SELECT ledger_id, max(year) AS cur, count(*) AS n,
   max(year) FILTER (WHERE rk = 2) AS y2, max(year) FILTER (WHERE rk = 3) AS y3
   FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id ORDER BY year DESC) AS rk FROM yrs) GROUP BY ledger_id),
dflt AS (SELECT ledger_id, cur,
   CASE WHEN n - 1 >= 2 THEN y3 WHEN n - 1 = 1 THEN y2 WHEN n >= 2 THEN y2 ELSE cur END AS ly,
   CASE WHEN n - 1 >= 1 THEN y2 ELSE cur END AS ry FROM yk)"""


def _summary(L):
    return tree.expense_by_year_account(L.of("^Expenses", ignore_case=True).postings, L.prices, TARGET)


@register("expense_by_year_account", SQL_SUMMARY + """
SELECT ledger_id, CAST(year AS INTEGER) AS year, account, CAST(ROUND(amount, 2) AS DOUBLE) AS amount FROM summary""")
def q_expense_by_year_account(spark, sf_dir):
    s = _summary(ledger(spark, sf_dir))
    return s.select("ledger_id", "year", "account", money("amount"))


@register("available_years", SQL_SUMMARY + """
SELECT y.ledger_id, CAST(y.year AS INTEGER) AS year, y.year = d.cur AS is_current,
  CAST(d.ly AS INTEGER) AS default_left_year, CAST(d.ry AS INTEGER) AS default_right_year
FROM yrs y JOIN dflt d USING (ledger_id)""")
def q_available_years(spark, sf_dir):
    return tree.available_years(tree.expense_accounts(ledger(spark, sf_dir).of("^Expenses", ignore_case=True).postings))


@register("expense_categories", SQL_SUMMARY + """
SELECT DISTINCT ledger_id, string_split(account, ':')[2] AS category FROM summary
WHERE starts_with(account, 'Expenses:') AND len(string_split(account, ':')) > 1""")
def q_expense_categories(spark, sf_dir):
    return tree.expense_categories(tree.expense_accounts(ledger(spark, sf_dir).of("^Expenses", ignore_case=True).postings))


@register("expense_tree", SQL_SUMMARY + """,
s AS (SELECT s.*, d.ly, d.ry FROM summary s JOIN dflt d USING (ledger_id)
      WHERE starts_with(account, 'Expenses:') AND string_split(account, ':')[2] NOT IN ('Taxes', 'Interest')),
e AS (SELECT ledger_id, array_to_string(list_slice(string_split(account, ':'), 1, n), ':') AS path,
        CASE WHEN year = ly THEN COALESCE(amount, 0) END AS l, CASE WHEN year = ry THEN COALESCE(amount, 0) END AS r
      FROM s, generate_series(2, len(string_split(account, ':'))) g(n)),
nodes AS (SELECT ledger_id, path, COALESCE(SUM(l), 0) AS left_amount, COALESCE(SUM(r), 0) AS right_amount FROM e GROUP BY ALL),
nd AS (SELECT ledger_id, path, string_split(path, ':')[-1] AS name, len(string_split(path, ':')) - 1 AS depth,
        array_to_string(list_slice(string_split(path, ':'), 1, len(string_split(path, ':')) - 1), ':') AS parent,
        left_amount, right_amount, right_amount - left_amount AS delta FROM nodes),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ledger_id, parent ORDER BY delta DESC, name DESC) AS sibling_rank FROM nd)
SELECT ledger_id, path, name, CAST(depth AS INTEGER) AS depth, parent, CAST(ROUND(left_amount, 2) AS DOUBLE) AS left_amount,
  CAST(ROUND(right_amount, 2) AS DOUBLE) AS right_amount, CAST(ROUND(delta, 2) AS DOUBLE) AS delta, CAST(sibling_rank AS INTEGER) AS sibling_rank FROM ranked
UNION ALL
SELECT ledger_id, '__total__', 'TOTAL', 0, NULL, CAST(ROUND(SUM(left_amount), 2) AS DOUBLE), CAST(ROUND(SUM(right_amount), 2) AS DOUBLE),
  CAST(ROUND(SUM(delta), 2) AS DOUBLE), 0 FROM nd WHERE depth = 1 GROUP BY ledger_id""")
def q_expense_tree(spark, sf_dir):
    L = ledger(spark, sf_dir)
    t = tree.expense_tree(_summary(L))
    return t.select("ledger_id", "path", "name", "depth", "parent", money("left_amount"), money("right_amount"),
                    money("delta"), "sibling_rank")


@register("drill_down", f"""
, {SQL_LAST_PX}
SELECT p.ledger_id, p.date, COALESCE(p.payee, '') AS payee, COALESCE(p.narration, '') AS narration,
  CAST(ROUND(CASE WHEN p.currency = 'USD' THEN CAST(p.number AS DECIMAL(38,6)) WHEN lpx.amount IS NOT NULL THEN CAST(p.number * lpx.amount AS DECIMAL(38,6)) END, 2) AS DOUBLE) AS amount
FROM postings p LEFT JOIN lpx ON lpx.currency = p.currency
WHERE p.account = '{LEAF}' AND year(p.date) IN (1999, 2000)""")
def q_drill_down(spark, sf_dir):
    L = ledger(spark, sf_dir)
    L = L.of("^Expenses", ignore_case=True)
    tx = flows.expense_postings(L.postings, L.prices, TARGET)
    leaves = tree.leaf_accounts(tree.expense_accounts(L.postings))
    return tree.drill_down(tx, leaves, LEAF, (1999, 2000)).select(
        "ledger_id", "date", "payee", "narration", money("amount"))


@register("expense_postings", f"""
, {SQL_LAST_PX}
SELECT p.ledger_id, p.date, CAST(year(p.date) AS INTEGER) AS year, p.account, p.payee, p.narration,
  CAST(ROUND(CASE WHEN p.currency = 'USD' THEN CAST(p.number AS DECIMAL(38,6)) WHEN lpx.amount IS NOT NULL THEN CAST(p.number * lpx.amount AS DECIMAL(38,6)) END, 2) AS DOUBLE) AS amount
FROM postings p LEFT JOIN lpx ON lpx.currency = p.currency WHERE regexp_matches(p.account, '(?i)^Expenses')""")
def q_expense_postings(spark, sf_dir):
    L = ledger(spark, sf_dir)
    L = L.of("^Expenses", ignore_case=True)
    tx = flows.expense_postings(L.postings, L.prices, TARGET)
    return tx.select("ledger_id", "date", "year", "account", "payee", "narration", money("amount"))


@register("income_postings", """
SELECT ledger_id, txn_id, line_no, date, CAST(year(date) AS INTEGER) AS year, account, payee, narration,
  CAST(number AS DOUBLE) AS number, currency FROM postings
WHERE regexp_matches(account, '(?i)Income') AND date >= DATE '1999-01-01' AND date < DATE '2001-01-01'""")
def q_income_postings(spark, sf_dir):
    p = flows.income_postings(ledger(spark, sf_dir).of("Income", "1999-01-01", "2000-12-31", ignore_case=True).postings, (1999, 2000))
    return p.select("ledger_id", "txn_id", "line_no", "date", "year", "account", "payee", "narration",
                    F.col("number").cast("double").alias("number"), "currency")


@register("year_bounds", "SELECT ledger_id, CAST(year(min(date)) AS INTEGER) AS first_year, CAST(year(max(date)) AS INTEGER) AS last_year FROM postings GROUP BY ledger_id")
def q_year_bounds(spark, sf_dir):
    return flows.year_bounds(ledger(spark, sf_dir).postings)


def _sql_period(unit: str) -> str:
    return f"""
SELECT ledger_id, CAST(date_trunc('{unit}', date) AS DATE) AS date,
  CAST(ROUND(COALESCE(SUM(CASE WHEN currency = 'USD' THEN number END), 0), 2) AS DOUBLE) AS amount
FROM postings WHERE regexp_matches(account, '(?i)Expenses') AND date >= DATE '1995-01-01' AND date < DATE '2002-01-01'
GROUP BY ALL"""


@register("expenses_by_period", _sql_period("month"))
def q_expenses_by_period(spark, sf_dir):
    e = flows.expenses_by_period(ledger(spark, sf_dir).of("Expenses", "1995-01-01", "2001-12-31", ignore_case=True).postings, "Month", TARGET, years=(1995, 2001))
    return e.select("ledger_id", "date", money("amount"))


@register("expenses_by_period_week", _sql_period("week"))
def q_expenses_by_week(spark, sf_dir):
    e = flows.expenses_by_period(ledger(spark, sf_dir).of("Expenses", "1995-01-01", "2001-12-31", ignore_case=True).postings, "Week", TARGET, years=(1995, 2001))
    return e.select("ledger_id", "date", money("amount"))


@register("expenses_by_period_quarter", _sql_period("quarter"))
def q_expenses_by_quarter(spark, sf_dir):
    e = flows.expenses_by_period(ledger(spark, sf_dir).of("Expenses", "1995-01-01", "2001-12-31", ignore_case=True).postings, "Quarter", TARGET, years=(1995, 2001))
    return e.select("ledger_id", "date", money("amount"))


# converted at cost on the posting date
def _sql_cost_src(where: str) -> str:
    return f"""
, {SQL_USD_PX},
src AS (SELECT ledger_id, date, account,
   CASE WHEN cost_number IS NOT NULL THEN CAST(number * cost_number AS DECIMAL(20,4)) ELSE CAST(number AS DECIMAL(20,4)) END AS number,
   COALESCE(cost_currency, currency) AS currency FROM postings WHERE {where}),
{SQL_POSTING_PX}"""


SQL_CONV = "CASE WHEN rate IS NOT NULL THEN number * rate END"


@register("total_spend", _sql_cost_src("regexp_matches(account, '(?i)Expenses:') AND date >= DATE '2000-01-01'") + f"""
SELECT ledger_id, CAST(ROUND(SUM({SQL_CONV}), 2) AS DOUBLE) AS balance FROM pp GROUP BY ledger_id""")
def q_total_spend(spark, sf_dir):
    L = ledger(spark, sf_dir)
    return flows.total_spend(L.of("Expenses:", "2000-01-01", ignore_case=True).postings, L.prices, "2000-01-01", TARGET).select("ledger_id", money("balance"))


@register("income_total", _sql_cost_src(f"account IN {SQL_INCOME_ACCOUNTS} AND year(date) = {YEAR}") + f"""
SELECT ledger_id, CAST(ROUND(abs(SUM({SQL_CONV})), 2) AS DOUBLE) AS income FROM pp GROUP BY ledger_id""")
def q_income_total(spark, sf_dir):
    L = ledger(spark, sf_dir)
    return flows.income_total(L.of("^Income:", f"{YEAR}-01-01", f"{YEAR}-12-31").postings, L.prices, INCOME_ACCOUNTS, YEAR, TARGET).select("ledger_id", money("income"))


@register("income_by_day", _sql_cost_src(f"account IN {SQL_INCOME_ACCOUNTS} AND year(date) = {YEAR}") + f""",
dd AS (SELECT ledger_id, date, abs(SUM({SQL_CONV})) AS amount FROM pp GROUP BY ALL)
SELECT ledger_id, date, CAST(ROUND(amount, 2) AS DOUBLE) AS amount,
  CAST(ROUND(SUM(amount) OVER (PARTITION BY ledger_id ORDER BY date), 2) AS DOUBLE) AS income FROM dd""")
def q_income_by_day(spark, sf_dir):
    L = ledger(spark, sf_dir)
    d = flows.daily_flow(L.postings, L.prices, YEAR, TARGET, accounts=INCOME_ACCOUNTS, abs_per_day=True, out="income")
    return d.select("ledger_id", "date", money("amount"), money("income"))


@register("spending_by_day", _sql_cost_src(f"regexp_matches(account, '(?i)Expenses:') AND year(date) = {YEAR}") + f""",
dd AS (SELECT ledger_id, date, SUM({SQL_CONV}) AS amount FROM pp GROUP BY ALL)
SELECT ledger_id, date, CAST(ROUND(amount, 2) AS DOUBLE) AS amount,
  CAST(ROUND(SUM(amount) OVER (PARTITION BY ledger_id ORDER BY date), 2) AS DOUBLE) AS spending FROM dd""")
def q_spending_by_day(spark, sf_dir):
    L = ledger(spark, sf_dir)
    d = flows.daily_flow(L.postings, L.prices, YEAR, TARGET, account_re="Expenses:", out="spending")
    return d.select("ledger_id", "date", money("amount"), money("spending"))


# ------------------------------------------------------------ holdings
@register("holdings", """
, lr AS (SELECT currency, quote, arg_max(amount, date) AS price FROM prices GROUP BY ALL),
lots AS (SELECT ledger_id, account, cost_date, currency, cost_currency, cost_number, SUM(number) AS units FROM postings
         WHERE split_part(account, ':', 1) IN ('Assets', 'Liabilities') GROUP BY ALL)
SELECT ledger_id, account, l.currency, CAST(ROUND(units, 2) AS DOUBLE) AS units, CAST(cost_number AS DOUBLE) AS cost,
  CAST(price AS DOUBLE) AS price,
  CAST(ROUND(CASE WHEN cost_number IS NOT NULL THEN CAST(CAST(units AS DECIMAL(20,2)) * cost_number AS DECIMAL(38,6)) ELSE CAST(units AS DECIMAL(38,6)) END, 2) AS DOUBLE) AS book_value,
  CASE WHEN cost_number IS NOT NULL THEN cost_currency ELSE l.currency END AS book_currency,
  CAST(ROUND(CASE WHEN cost_number IS NOT NULL AND price IS NOT NULL THEN CAST(CAST(units AS DECIMAL(20,2)) * price AS DECIMAL(38,6)) ELSE CAST(units AS DECIMAL(38,6)) END, 2) AS DOUBLE) AS market_value,
  CASE WHEN cost_number IS NOT NULL AND price IS NOT NULL THEN cost_currency ELSE l.currency END AS market_currency,
  cost_date AS acquisition_date
FROM lots l LEFT JOIN lr ON lr.currency = l.currency AND lr.quote = l.cost_currency""")
def q_holdings(spark, sf_dir):
    L = ledger(spark, sf_dir).of("^(Assets|Liabilities)(:|$)")
    h = hold.holdings(L.postings, L.prices)
    return h.select("ledger_id", "account", "currency", money("units"), F.col("cost").cast("double").alias("cost"),
                    F.col("price").cast("double").alias("price"), money("book_value"), "book_currency",
                    money("market_value"), "market_currency", "acquisition_date")


@register("units_by_commodity", """
SELECT ledger_id, currency, CAST(ROUND(SUM(number), 2) AS DOUBLE) AS units FROM postings
WHERE regexp_matches(account, '(?i)Assets:') GROUP BY ALL HAVING SUM(number) <> 0""")
def q_units_by_commodity(spark, sf_dir):
    u = hold.units_by_commodity(ledger(spark, sf_dir).of("Assets:", ignore_case=True).postings)
    return u.select("ledger_id", "currency", money("units"))


@register("holdings_snapshot", """
, d AS (SELECT ledger_id, currency, date, SUM(number) AS delta FROM postings
        WHERE currency NOT IN ('USD', 'IRAUSD', 'VACHR') GROUP BY ALL),
r AS (SELECT ledger_id, currency, date, SUM(delta) OVER (PARTITION BY ledger_id, currency ORDER BY date) AS units FROM d),
days AS (SELECT DISTINCT ledger_id, date FROM d),
cur AS (SELECT DISTINCT ledger_id, currency FROM d),
g AS (SELECT days.ledger_id, cur.currency, days.date FROM days JOIN cur USING (ledger_id)),
s AS (SELECT g.ledger_id, g.currency, g.date, r.units FROM g ASOF JOIN r ON r.ledger_id = g.ledger_id AND r.currency = g.currency AND r.date <= g.date)
SELECT ledger_id, currency, date, CAST(ROUND(units, 2) AS DOUBLE) AS units FROM s WHERE units <> 0""")
def q_holdings_snapshot(spark, sf_dir):
    s = hold.holdings_snapshot(ledger(spark, sf_dir).postings)
    return s.select("ledger_id", "currency", "date", money("units"))


# ------------------------------------------------------------ conversions off the direct USD path
# Rounding in words: an inverse rate is 1 / amount to 18 decimals, half up; a
# hop rate is the exact product of its two rates; a converted amount is
# rounded half up to 6 decimals.  The oracles count in integers (HUGEINT),
# because DuckDB divides decimals as doubles.
def sql_times(units: str, *rates: tuple[str, int]) -> str:
    """units (2 decimals) x rates (expression, decimals) in millionths, half up."""
    scale = 2 + sum(d for _, d in rates)
    x = f"CAST({units} * 100 AS HUGEINT)" + "".join(f" * {r}" for r, _ in rates)
    return (f"CASE WHEN {units} < 0 THEN -1 ELSE 1 END * ((abs({x}) + CAST('{5 * 10 ** (scale - 7)}' AS HUGEINT))"
            f" // CAST('{10 ** (scale - 6)}' AS HUGEINT))")


SQL_EUR = sql_units_at(SQL_MONTH_ENDS, SQL_ASSETS_LIAB, "currency") + f""",
{SQL_USD_PX},
eur AS (SELECT date, (CAST('10000000000000000000000' AS HUGEINT) + CAST(amount * 10000 AS HUGEINT) // 2)
          // CAST(amount * 10000 AS HUGEINT) AS inv FROM px WHERE currency = 'EUR'),
j AS (SELECT u.*, px.amount FROM u ASOF LEFT JOIN px ON px.currency = u.currency AND px.date <= u.date),
e AS (SELECT j.*, eur.inv FROM j ASOF LEFT JOIN eur ON eur.date <= j.date),
n AS (SELECT ledger_id, date, CASE WHEN currency = 'EUR' THEN CAST(units * 1000000 AS HUGEINT)
        WHEN currency = 'USD' THEN {sql_times("units", ("inv", 18))}
        ELSE {sql_times("units", ("CAST(amount * 10000 AS HUGEINT)", 4), ("inv", 18))} END AS v FROM e)
SELECT ledger_id, date, CAST(ROUND(CAST(SUM(COALESCE(v, 0)) AS DECIMAL(38,0)) / 1000000, 2) AS DOUBLE) AS net_worth
FROM n GROUP BY ledger_id, date"""


@register("networth_eur", SQL_EUR)
def q_networth_eur(spark, sf_dir):
    """Target EUR: USD by the inverse of EUR/USD, commodities through their
    cost currency (CM to USD to EUR)."""
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    out = nw.networth_converted(L.postings, L.prices, month_end_spine(START, END), "EUR")
    return out.select("ledger_id", "date", cents("net_worth"))


@register("convert_hop_small_rate", f"""
, {SQL_LAST_PX},
u AS (SELECT ledger_id, currency, SUM(number) AS units FROM postings WHERE starts_with(currency, 'CM') GROUP BY ALL)
SELECT u.ledger_id, u.currency, 'USD' AS conv_currency,
  CAST(CAST({sql_times("units", ("CAST(amount * 10000 AS HUGEINT)", 9), ("6", 5))} AS DECIMAL(38,0)) / 1000000 AS DOUBLE) AS conv_number
FROM u JOIN lpx USING (currency)""")
def q_convert_hop_small_rate(spark, sf_dir):
    """Commodities priced in a currency worth 0.00006 USD, a hundred
    thousandth of their price: both rates of the hop are small."""
    L = ledger(spark, sf_dir)
    in_small = L.prices.where((F.col("quote") == "USD") & F.col("currency").startswith("CM")).select(
        "date", "currency", (F.col("amount") * F.lit("0.00001").cast("decimal(6,5)")).cast("decimal(18,9)").alias("amount"),
        F.lit("IDR").alias("quote"))
    small = L.prices.agg(F.min("date").alias("date")).select(
        "date", F.lit("IDR").alias("currency"), F.lit("0.00006").cast("decimal(18,9)").alias("amount"), F.lit("USD").alias("quote"))
    units = L.postings.where(F.col("currency").startswith("CM")).groupBy("ledger_id", "currency").agg(
        F.sum("number").alias("number")).withColumn("cost_currency", F.regexp_replace("currency", "^CM.*", "IDR"))
    out = convert(units, in_small.unionByName(small), TARGET, date=None, inverse=False)
    return out.select("ledger_id", "currency", "conv_currency", F.col("conv_number").cast("double").alias("conv_number"))


# ------------------------------------------------------------ price gaps
@register("missing_prices", """
, b AS (SELECT min(date) AS lo, max(date) AS hi FROM prices),
cs AS (SELECT DISTINCT currency FROM prices),
g AS (SELECT CAST(d AS DATE) AS date, currency FROM b, cs, generate_series(b.lo, b.hi, INTERVAL 1 DAY) t(d))
SELECT date, currency FROM g ANTI JOIN (SELECT DISTINCT currency, date FROM prices) p USING (currency, date)""")
def q_missing_prices(spark, sf_dir):
    return gaps.missing_prices(ledger(spark, sf_dir).prices)


@register("missing_prices_held", """
, d AS (SELECT ledger_id, currency, date, SUM(number) AS delta FROM postings
        WHERE regexp_matches(account, '^Assets:') AND currency <> 'USD' GROUP BY ALL),
r AS (SELECT ledger_id, currency, date, SUM(delta) OVER (PARTITION BY ledger_id, currency ORDER BY date) AS units,
        LEAD(date) OVER (PARTITION BY ledger_id, currency ORDER BY date) AS nxt FROM d),
hi AS (SELECT max(date) AS hi FROM prices),
held AS (SELECT ledger_id, currency, CAST(x AS DATE) AS date FROM r, hi,
         generate_series(r.date, COALESCE(r.nxt - 1, hi.hi), INTERVAL 1 DAY) t(x)
         WHERE units <> 0 AND r.date <= hi.hi)
SELECT ledger_id, date, currency FROM held ANTI JOIN (SELECT DISTINCT currency, date FROM prices) p USING (currency, date)""")
def q_missing_prices_held(spark, sf_dir):
    L = ledger(spark, sf_dir)
    return gaps.missing_prices_held(L.postings, L.prices)


# ------------------------------------------------------------ finance
FIN_START, FIN_END = f"{YEAR}-01-01", f"{YEAR + 1}-01-01"
R, NPER = "CAST(0.031 AS DOUBLE)", "CAST(72.335 AS DOUBLE)"
SQL_Q = f"pow(1.0 + {R}, {NPER})"
SQL_PMT_BEGIN = f"(-(-(0.0 + CAST(v AS DOUBLE) * {SQL_Q}) / (((1.0 + {R} * 1.0) * ({SQL_Q} - 1)) / {R})))"
SQL_PV_INCOME = f"(-(0.0 + CAST(-225000.0 AS DOUBLE) * (((1.0 + {R} * 0.0) * ({SQL_Q} - 1)) / {R})) / {SQL_Q})"
SQL_DIY = "dayofyear(make_date(year(date), 12, 31))"


def sql_target(col: str) -> str:
    """pmt x day_of_year / days_in_year rounded half-up to cents, in integer
    cents (DuckDB divides decimals in DOUBLE)."""
    num = f"(CAST({col} * 100 AS BIGINT) * day_of_year)"
    return (f"(CAST(sign({num}) * ((2 * abs({num}) + {SQL_DIY}) // (2 * {SQL_DIY})) AS DECIMAL(38,2))"
            f" * CAST(0.01 AS DECIMAL(3,2)))")


def C2(expr: str) -> str:
    """DuckDB twin of ``report.cents``."""
    return f"(floor(CAST({expr} AS DOUBLE) * 100 + 0.5) / 100)"


def M2(expr: str) -> str:
    """DuckDB twin of ``finance.money2``."""
    return f"CAST(CAST(floor(CAST({expr} AS DOUBLE) * 100 + 0.5) AS DECIMAL(20,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"

SQL_CURVES = sql_networth(SQL_DAYS.format(a=FIN_START, b=f"{YEAR}-12-31"), SQL_ASSETS_LIAB) + f""",
b AS (SELECT ledger_id, date, v, {M2(SQL_PMT_BEGIN)} AS pmt, dayofyear(date) AS day_of_year FROM n),
c AS (SELECT *,
  CASE WHEN CAST(v AS DOUBLE) / CAST(7000000 AS DOUBLE) > 0 THEN
    {M2('CAST(pmt AS DOUBLE) * pow(CAST(v AS DOUBLE) / CAST(7000000 AS DOUBLE), 0.5)')} END AS pmt_portfolio_tilt,
  CASE WHEN CAST(v AS DOUBLE) / {SQL_PV_INCOME} > 0 THEN
    {M2(f'CAST(pmt AS DOUBLE) * pow(CAST(v AS DOUBLE) / {SQL_PV_INCOME}, -0.5)')} END AS pmt_income_tilt FROM b),
cv AS (SELECT *, {sql_target('pmt')} AS target, {sql_target('pmt_portfolio_tilt')} AS target_portfolio_tilt,
  {sql_target('pmt_income_tilt')} AS target_spending_tilt FROM c)"""


def _curves(L):
    n = nw.networth_summator(L.of(BALANCE_SHEET).postings, L.prices, FIN_START, FIN_END, TARGET)
    return fin.withdrawal_curves(n)


@register("pmt_withdrawal", SQL_CURVES + """
SELECT ledger_id, date, CAST(ROUND(v, 2) AS DOUBLE) AS net_worth, CAST(pmt AS DOUBLE) AS pmt, CAST(day_of_year AS INTEGER) AS day_of_year FROM b""")
def q_pmt_withdrawal(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    n = nw.networth_summator(L.postings, L.prices, FIN_START, FIN_END, TARGET)
    b = fin.pmt_withdrawal(n)
    return b.select("ledger_id", "date", money("net_worth"), F.col("pmt").cast("double").alias("pmt"), "day_of_year")


@register("withdrawal_curves", SQL_CURVES + f"""
SELECT ledger_id, date, CAST(pmt AS DOUBLE) AS pmt, CAST(pmt_portfolio_tilt AS DOUBLE) AS pmt_portfolio_tilt,
  CAST(pmt_income_tilt AS DOUBLE) AS pmt_income_tilt, CAST(ROUND(target, 2) AS DOUBLE) AS target,
  CAST(ROUND(target_portfolio_tilt, 2) AS DOUBLE) AS target_portfolio_tilt,
  CAST(ROUND(target_spending_tilt, 2) AS DOUBLE) AS target_spending_tilt FROM cv""")
def q_withdrawal_curves(spark, sf_dir):
    c = _curves(ledger(spark, sf_dir))
    return c.select("ledger_id", "date", *[F.col(x).cast("double").alias(x) for x in
                                           ("pmt", "pmt_portfolio_tilt", "pmt_income_tilt")],
                    *[money(x) for x in ("target", "target_portfolio_tilt", "target_spending_tilt")])


@register("withdrawal_curves_long", SQL_CURVES + """
SELECT ledger_id, date, variable, CAST(value AS DOUBLE) AS value FROM
 (SELECT ledger_id, date, pmt, pmt_portfolio_tilt, pmt_income_tilt FROM c)
 UNPIVOT INCLUDE NULLS (value FOR variable IN (pmt, pmt_portfolio_tilt, pmt_income_tilt))""")
def q_withdrawal_curves_long(spark, sf_dir):
    c = _curves(ledger(spark, sf_dir))
    u = fin.unpivot_series(c.select("ledger_id", "date", "pmt", "pmt_portfolio_tilt", "pmt_income_tilt"),
                           ["ledger_id", "date"], ["pmt", "pmt_portfolio_tilt", "pmt_income_tilt"])
    return u.select("ledger_id", "date", "variable", F.col("value").cast("double").alias("value"))


SQL_FLOW_DAYS = f""",
inc AS (SELECT ledger_id, date, SUM(abs(a)) OVER (PARTITION BY ledger_id ORDER BY date) AS income FROM
   (SELECT ledger_id, date, SUM({SQL_CONV}) AS a FROM pp WHERE account IN {SQL_INCOME_ACCOUNTS} GROUP BY ALL)),
spd AS (SELECT ledger_id, date, SUM(a) OVER (PARTITION BY ledger_id ORDER BY date) AS spending FROM
   (SELECT ledger_id, date, SUM({SQL_CONV}) AS a FROM pp WHERE regexp_matches(account, '(?i)Expenses:') GROUP BY ALL))"""


def _flows_sql() -> str:
    # posting-date conversion source over the year, without re-declaring px
    return f""",
src AS (SELECT ledger_id, date, account,
   CASE WHEN cost_number IS NOT NULL THEN CAST(number * cost_number AS DECIMAL(20,4)) ELSE CAST(number AS DECIMAL(20,4)) END AS number,
   COALESCE(cost_currency, currency) AS currency FROM postings WHERE year(date) = {YEAR}),
{SQL_POSTING_PX}""" + SQL_FLOW_DAYS


@register("delta_trend", SQL_CURVES + _flows_sql() + f"""
SELECT cv.ledger_id, cv.date,
  CAST(ROUND(least(target_portfolio_tilt, target_spending_tilt) - spending, 2) AS DOUBLE) AS tilt_trend,
  CAST(ROUND(least(target_portfolio_tilt, target_spending_tilt) - spending + income, 2) AS DOUBLE) AS tilt_income_trend,
  CAST(ROUND(target - spending + income, 2) AS DOUBLE) AS notilt_income_trend
FROM cv JOIN inc USING (ledger_id, date) JOIN spd USING (ledger_id, date)""")
def q_delta_trend(spark, sf_dir):
    L = ledger(spark, sf_dir)
    c = _curves(L)
    both = flows.daily_income_spending(L.of("Income|Expenses:", f"{YEAR}-01-01", f"{YEAR}-12-31", ignore_case=True).postings, L.prices, YEAR, TARGET, income_accounts=INCOME_ACCOUNTS)
    t = fin.delta_trend(c, both)
    return t.select("ledger_id", "date", *[money(x) for x in
                                           ("tilt_trend", "tilt_income_trend", "notilt_income_trend")])


# ------------------------------------------------------------ actuarial
LIFE_YEAR = 2025
P90 = 1 - 0.9
HOUSEHOLD_AGES = (50, 35)


def _life(spark):
    base = act.extend_life_table(act.synthetic_life_tables(spark))
    g = act.extend_life_table(act.synthetic_improvement(spark))
    return act.improve(base, g, LIFE_YEAR - act.BASE_TABLE_YEAR)


SQL_LIFE = f"""
, lt_raw AS (SELECT t.table_id, CAST(a.age AS INT) AS row_idx, CAST(a.age AS BIGINT) AS age,
     CAST(a.age * a.age AS DOUBLE) / t.dv AS qx
   FROM (VALUES ('male', CAST(16000.0 AS DOUBLE)), ('female', CAST(18000.0 AS DOUBLE))) t(table_id, dv), range(0, 121) a(age)),
lt_ext AS (SELECT * FROM lt_raw UNION ALL
   SELECT l.table_id, CAST(120 + i AS INT), CAST(120 + i AS BIGINT), l.qx FROM lt_raw l, range(1, 30) r(i) WHERE l.age = 120),
lt AS (SELECT table_id, row_idx, age, qx * pow(1 - CAST(0.01 AS DOUBLE), {LIFE_YEAR - 2012}) AS qx,
       1 - qx * pow(1 - CAST(0.01 AS DOUBLE), {LIFE_YEAR - 2012}) AS px FROM lt_ext),
pos AS (SELECT table_id, age, px, row_number() OVER (PARTITION BY table_id ORDER BY row_idx) AS pos FROM lt),
nn AS (SELECT max(pos) FILTER (WHERE table_id = 'male') AS n1, max(pos) FILTER (WHERE table_id = 'female') AS n2 FROM pos),
st AS (SELECT table_id, age, min(pos) AS s FROM pos GROUP BY ALL)"""


def sql_joint(pairs_sql: str) -> str:
    return f""",
pairs AS ({pairs_sql}),
p2 AS (SELECT pairs.*, a.s AS s1, b.s AS s2 FROM pairs JOIN st a ON a.table_id = 'male' AND a.age = pairs.age_1
       JOIN st b ON b.table_id = 'female' AND b.age = pairs.age_2),
steps AS (SELECT p2.*, g.t FROM p2, nn, generate_series(0, least(nn.n1 - p2.s1, nn.n2 - p2.s2)) g(t)),
jj AS (SELECT steps.age_1, steps.age_2, steps.t, a.px AS px1, b.px AS px2 FROM steps
       JOIN pos a ON a.table_id = 'male' AND a.pos = steps.s1 + steps.t
       JOIN pos b ON b.table_id = 'female' AND b.pos = steps.s2 + steps.t),
sv AS (SELECT age_1, age_2, t, COALESCE(product(px1) OVER w, 1.0) AS s1, COALESCE(product(px2) OVER w, 1.0) AS s2 FROM jj
       WINDOW w AS (PARTITION BY age_1, age_2 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
firstt AS (SELECT age_1, age_2, min(t) AS t FROM sv WHERE 1 - (1 - s1) * (1 - s2) <= {P90!r} GROUP BY ALL)"""


SQL_HH_PAIRS = "SELECT DISTINCT CAST(age_1 AS BIGINT) AS age_1, CAST(age_2 AS BIGINT) AS age_2 FROM households"


@register("household_life_expectancy", SQL_LIFE + """,
lx AS (SELECT table_id, age, COALESCE(product(px) OVER (PARTITION BY table_id ORDER BY row_idx
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) * 100000 AS lx, row_idx FROM lt),
lxx AS (SELECT *, (lx + LEAD(lx, 1, 0.0) OVER (PARTITION BY table_id ORDER BY row_idx)) / 2 AS nLx FROM lx),
tx AS (SELECT *, SUM(nLx) OVER (PARTITION BY table_id ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS Tx FROM lxx),
ex AS (SELECT table_id, age, Tx / lx AS ex FROM tx)
SELECT h.household_id, h.age_1, h.age_2, ROUND(a.ex, 6) AS ex_1, ROUND(b.ex, 6) AS ex_2
FROM households h JOIN ex a ON a.table_id = 'male' AND a.age = h.age_1 JOIN ex b ON b.table_id = 'female' AND b.age = h.age_2""")
def q_household_life_expectancy(spark, sf_dir):
    lt = act.life_table(_life(spark)).select("table_id", "age", "ex")
    hh = star_households(spark, sf_dir)
    m = broadcast_if_small(lt.where(F.col("table_id") == "male").select(F.col("age").alias("age_1"), F.col("ex").alias("ex_1")))
    f = broadcast_if_small(lt.where(F.col("table_id") == "female").select(F.col("age").alias("age_2"), F.col("ex").alias("ex_2")))
    out = hh.join(m, "age_1").join(f, "age_2")
    return out.select("household_id", "age_1", "age_2", ratio("ex_1"), ratio("ex_2"))


@register("joint_life_percentile", SQL_LIFE + sql_joint(SQL_HH_PAIRS) + """
SELECT h.household_id, CAST(h.age_1 AS BIGINT) AS age_1, CAST(h.age_2 AS BIGINT) AS age_2, CAST(f.t AS INT) AS years
FROM households h LEFT JOIN firstt f ON f.age_1 = h.age_1 AND f.age_2 = h.age_2""")
def q_joint_life_percentile(spark, sf_dir):
    lt = _life(spark)
    return act.joint_life_percentile(star_households(spark, sf_dir), lt.where("table_id = 'male'"),
                                     lt.where("table_id = 'female'"), 0.9)


@register("conservative_life_expectancy", SQL_LIFE + sql_joint(SQL_HH_PAIRS) + """
SELECT h.household_id, CAST(h.age_1 AS BIGINT) AS age_1, CAST(h.age_2 AS BIGINT) AS age_2, CAST(f.t AS INT) AS years,
  ROUND((f.t + 120 - least(h.age_1, h.age_2)) / 2, 6) AS conservative_years
FROM households h LEFT JOIN firstt f ON f.age_1 = h.age_1 AND f.age_2 = h.age_2""")
def q_conservative_life_expectancy(spark, sf_dir):
    lt = _life(spark)
    j = act.joint_life_percentile(star_households(spark, sf_dir), lt.where("table_id = 'male'"),
                                  lt.where("table_id = 'female'"), 0.9)
    return act.conservative_life_expectancy(j).select("household_id", "age_1", "age_2", "years",
                                                      ratio("conservative_years"))


def _household_le(spark):
    """Conservative life expectancy of the dashboard household, a scalar
    subquery over the life tables."""
    lt = _life(spark)
    # (sums with the row's id, because a join on literals would be a nested loop)
    one = spark.range(1).select(F.col("id").alias("household_id"), (F.col("id") + HOUSEHOLD_AGES[0]).alias("age_1"),
                                (F.col("id") + HOUSEHOLD_AGES[1]).alias("age_2"))
    j = act.joint_life_percentile(one, lt.where("table_id = 'male'"), lt.where("table_id = 'female'"), 0.9)
    return act.conservative_life_expectancy(j).select(F.col("conservative_years").cast("double")).scalar()


SQL_DASH_LE = SQL_LIFE + sql_joint(f"SELECT CAST({HOUSEHOLD_AGES[0]} AS BIGINT) AS age_1, CAST({HOUSEHOLD_AGES[1]} AS BIGINT) AS age_2") + f""",
le AS (SELECT CAST((t + 120 - least(age_1, age_2)) / 2 AS DOUBLE) AS le FROM firstt)"""
SQL_DASH = SQL_DASH_LE + f""",
{SQL_USD_PX},
h AS (SELECT ledger_id, currency, SUM(number) AS units FROM postings WHERE regexp_matches(account, '(?i)Assets:') GROUP BY ALL),
lp AS (SELECT currency, arg_max(amount, date) AS amount FROM px WHERE date <= DATE '{TODAY}' GROUP BY currency),
nwt AS (SELECT ledger_id, SUM(CASE WHEN h.currency = 'USD' THEN CAST(units AS DECIMAL(38,6)) WHEN lp.amount IS NOT NULL THEN CAST(CAST(units AS DECIMAL(20,2)) * lp.amount AS DECIMAL(38,6)) END) AS v
        FROM h LEFT JOIN lp USING (currency) GROUP BY ledger_id),
dr AS (SELECT nwt.ledger_id, CAST(v AS DOUBLE) AS nw, le.le,
   CASE WHEN DATE '{TODAY}' >= make_date(year(DATE '{TODAY}'), 2, 23) THEN CAST(0.031 AS DOUBLE) ELSE CAST(0.032 AS DOUBLE) END AS er FROM nwt, le),
dq AS (SELECT *, pow(1.0 + er, le) AS q FROM dr),
dp AS (SELECT *, -(-(CAST(0.0 AS DOUBLE) + nw * q) / (((1.0 + er * 1.0) * (q - 1)) / er)) AS raw,
        -(CAST(0.0 AS DOUBLE) + CAST(-225000.0 AS DOUBLE) * (((1.0 + er * 0.0) * (q - 1)) / er)) / q AS inc_pv FROM dq),
dt AS (SELECT *, least(raw * pow(nw / 750000, 0.5), raw * pow(nw / inc_pv, -0.5)) AS tilt FROM dp)"""


@register("tilt_pmt_dashboard", SQL_DASH + f"""
SELECT ledger_id, DATE '{TODAY}' AS date, er AS rate, floor(tilt / 1000) * 1000 AS tilt_pmt, floor(raw / 1000) * 1000 AS raw_pmt FROM dt""")
def q_tilt_pmt_dashboard(spark, sf_dir):
    return _dashboard(spark, sf_dir).select(
        "ledger_id", "date", "rate", F.col("tilt_pmt").cast("double").alias("tilt_pmt"),
        F.col("raw_pmt").cast("double").alias("raw_pmt"))


def _dashboard(spark, sf_dir):
    L = ledger(spark, sf_dir)
    n = nw.networth_at(L.postings, L.prices, TODAY, TARGET).withColumn("date", F.lit(TODAY).cast("date"))
    return fin.tilt_pmt_dashboard(n, _household_le(spark))


SQL_YTD = f"""
src AS (SELECT ledger_id, date, account,
   CASE WHEN cost_number IS NOT NULL THEN CAST(number * cost_number AS DECIMAL(20,4)) ELSE CAST(number AS DECIMAL(20,4)) END AS number,
   COALESCE(cost_currency, currency) AS currency FROM postings
   WHERE regexp_matches(account, '(?i)Expenses:') AND date >= DATE '1998-01-01' AND date <= DATE '{TODAY}'),
{SQL_POSTING_PX},
ytd AS (SELECT ledger_id, SUM({SQL_CONV}) FILTER (WHERE date >= DATE '{YEAR}-01-01') AS ytd,
        SUM({SQL_CONV}) FILTER (WHERE NOT regexp_matches(account, '(?i)Expenses:Vacation:')
          AND account NOT IN ('Expenses:Everyday:Household-Goods', 'Expenses:Everyday:House-Renovation')) AS total
        FROM pp GROUP BY ledger_id)"""


def _ytd(L, start):
    return flows.total_spend(L.postings, L.prices, start, TARGET, end=TODAY)


@register("spend_progress", SQL_DASH + ",\n" + SQL_YTD + f"""
SELECT dt.ledger_id, round_even(dayofyear(DATE '{TODAY}') / 365 * 100, 0) AS date_pct,
  round_even(CAST(ytd AS DOUBLE) / (floor(tilt / 1000) * 1000) * 100, 0) AS tilt_pct,
  round_even(dayofyear(DATE '{TODAY}') / 365 * 100, 0) >= round_even(CAST(ytd AS DOUBLE) / (floor(tilt / 1000) * 1000) * 100, 0) AS on_track
FROM dt JOIN ytd USING (ledger_id)""")
def q_spend_progress(spark, sf_dir):
    L = ledger(spark, sf_dir)
    d = _dashboard(spark, sf_dir).select("ledger_id", "tilt_pmt")
    y = _ytd(L, f"{YEAR}-01-01").select("ledger_id", F.col("balance").alias("ytd"))
    j = d.join(y, "ledger_id")
    doy, spend, ok = fin.spend_progress(F.col("ytd"), F.col("tilt_pmt"), F.lit(TODAY).cast("date"))
    return j.select("ledger_id", doy.alias("date_pct"), spend.alias("tilt_pct"), ok.alias("on_track"))


@register("projected_spend", f", {SQL_USD_PX},\n" + SQL_YTD + f"""
SELECT ledger_id, CAST(ROUND(ytd, 2) AS DOUBLE) AS ytd_spend,
  {C2(f"CAST(ytd AS DOUBLE) + CAST(total AS DOUBLE) / CAST(datediff('day', DATE '1998-01-01', DATE '{TODAY}') AS DOUBLE) * (365 - dayofyear(DATE '{TODAY}'))")} AS projected
FROM ytd""")
def q_projected_spend(spark, sf_dir):
    L = ledger(spark, sf_dir)
    excluded = (acc.account_match("Expenses:Vacation:", ignore_case=True)
                | F.col("account").isin("Expenses:Everyday:Household-Goods", "Expenses:Everyday:House-Renovation"))
    window = (acc.account_match("Expenses:", ignore_case=True) & (F.col("date") >= F.lit("1998-01-01").cast("date"))
              & (F.col("date") <= F.lit(TODAY).cast("date")))
    j = flows.conditional_cost_sums(L.postings, L.prices, TARGET, {
        "ytd": F.col("date") >= F.lit(f"{YEAR}-01-01").cast("date"),
        "total": ~excluded,
    }, where=window)
    est = fin.projected_spend(F.col("ytd"), F.col("total"), F.lit(TODAY).cast("date"), F.lit("1998-01-01").cast("date"))
    return j.select("ledger_id", money("ytd", "ytd_spend"), cents(est, "projected"))


# ------------------------------------------------------------ S3
@register("ledger_errors", """
, dd AS (SELECT ledger_id, account, currency, date, SUM(number) AS delta FROM postings GROUP BY ALL),
anc AS (SELECT ledger_id, array_to_string(list_slice(string_split(account, ':'), 1, n), ':') AS path, currency, date, delta
        FROM dd, generate_series(1, len(string_split(account, ':'))) g(n)),
act AS (SELECT b.ledger_id, b.date, b.account, b.currency, b.number AS expected, COALESCE(SUM(a.delta), 0) AS actual
        FROM balances b LEFT JOIN anc a ON a.ledger_id = b.ledger_id AND a.path = b.account AND a.currency = b.currency AND a.date < b.date
        GROUP BY ALL),
w AS (SELECT ledger_id, txn_id, COALESCE(cost_currency, currency) AS currency, min(date) AS date,
        SUM(CASE WHEN cost_number IS NOT NULL THEN CAST(number * cost_number AS DECIMAL(38,6)) ELSE CAST(number AS DECIMAL(38,6)) END) AS actual FROM postings GROUP BY ALL)
SELECT ledger_id, 'balance' AS kind, date, account, currency, CAST(expected AS DOUBLE) AS expected,
  CAST(actual AS DOUBLE) AS actual, CAST(actual - expected AS DOUBLE) AS diff FROM act WHERE abs(actual - expected) > 0.005
UNION ALL
SELECT ledger_id, 'unbalanced', date, NULL, currency, 0.0, CAST(actual AS DOUBLE), CAST(actual AS DOUBLE) FROM w WHERE abs(actual) > 0.005""")
def q_ledger_errors(spark, sf_dir):
    L = ledger(spark, sf_dir)
    e = checks.ledger_errors(L.postings, star_balances(L.postings))
    return e.select("ledger_id", "kind", "date", "account", "currency",
                    *[F.col(c).cast("double").alias(c) for c in ("expected", "actual", "diff")])


# ------------------------------------------------------------ streaming
def _stream_dirs(spark, name):
    import uuid

    from tallyframe.session import scratch_path

    base = scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/out", f"{base}/checkpoint"


@register("incremental_balances", f"""
SELECT ledger_id, account, currency, CAST(cost_number AS DOUBLE) AS cost_number, cost_currency, cost_date,
  CAST(ROUND(number, 2) AS DOUBLE) AS number
FROM ({SQL_INV_AT.format(acct=SQL_ROOT2, where=SQL_ASSETS_LIAB)})""")
def q_incremental_balances(spark, sf_dir):
    """The ingested folder itself is the stream's source, half of its files
    per batch; the balances are compacted every second batch."""
    from tallyframe.streaming.balances import balances_stream, latest_state, run_to_table

    out, ckpt = _stream_dirs(spark, "incremental_balances")
    store = ledger(spark, sf_dir).store
    each = max(1, (len(store.all().inputFiles()) + 1) // 2)
    stream = spark.readStream.schema(store.schema).option("maxFilesPerTrigger", each).parquet(f"{store.path}/postings")
    key = ["ledger_id", "account", "currency", "cost_number", "cost_currency", "cost_date"]
    run_to_table(balances_stream(stream, root_n=2, account_re=BALANCE_SHEET), out, ckpt, key, every=2)
    return _inv_out(latest_state(spark, out, key).where(F.col("number") != 0))


@register("streaming_period_expenses", """
SELECT user_id AS ledger_id, event_type AS account, CAST(date_trunc('month', ts) AS DATE) AS period,
  CAST(SUM(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS amount
FROM events GROUP BY ALL""")
def q_streaming_period_expenses(spark, sf_dir):
    """The events table itself is the stream's source.  What is there when
    a run starts is one batch, so the watermark (which releases closed days)
    only drops rows that come more than 31 days behind an earlier run."""
    from tallyframe.streaming.balances import DAY_KEY, latest_state, period_expenses_stream, period_report, run_to_table

    out, ckpt = _stream_dirs(spark, "period_expenses")
    # (a pattern, because the table may be one file, and a stream's path must else be a folder)
    stream = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events.parque[t]").select(
        F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", F.col("value").cast("decimal(18,6)").alias("value"))
    agg = period_expenses_stream(stream, ts="ts", ledger="user_id", account="event_type", value="value")
    run_to_table(agg, out, ckpt, DAY_KEY)
    return period_report(latest_state(spark, out, DAY_KEY), "month").withColumn("amount", F.col("amount").cast("double"))


# ------------------------------------------------------------ reshaping / display
@register("latest_points", sql_networth(SQL_DAYS.format(a=START, b=DAILY_END_EXCL), SQL_ASSETS_LIAB) + """
SELECT ledger_id, date, CAST(ROUND(v, 2) AS DOUBLE) AS net_worth FROM n
QUALIFY rank() OVER (PARTITION BY ledger_id ORDER BY date DESC) = 1""")
def q_latest_points(spark, sf_dir):
    L = ledger(spark, sf_dir).of(BALANCE_SHEET)
    d = nw.networth_daily(L.postings, L.prices, START, END, TARGET)
    return fin.latest_points(d).select("ledger_id", "date", money("net_worth"))


@register("withdrawal_curves_wide", SQL_CURVES + """
SELECT ledger_id, date, CAST(pmt AS DOUBLE) AS pmt, CAST(pmt_portfolio_tilt AS DOUBLE) AS pmt_portfolio_tilt,
  CAST(pmt_income_tilt AS DOUBLE) AS pmt_income_tilt FROM c""")
def q_withdrawal_curves_wide(spark, sf_dir):
    c = _curves(ledger(spark, sf_dir))
    names = ["pmt", "pmt_portfolio_tilt", "pmt_income_tilt"]
    long = fin.unpivot_series(c.select("ledger_id", "date", *names), ["ledger_id", "date"], names)
    wide = fin.pivot_series(long, ["ledger_id", "date"], names)
    return wide.select("ledger_id", "date", *[F.col(x).cast("double").alias(x) for x in names])


UNIT_CURRENCIES = ["CM0", "CM1", "CM2", "CM3", "CM4", "CM5", "EUR", "HRS", "USD"]


@register("units_by_commodity_wide", """
SELECT ledger_id, """ + ", ".join(
    f"CAST(ROUND(SUM(number) FILTER (WHERE currency = '{c}'), 2) AS DOUBLE) AS {c}" for c in UNIT_CURRENCIES) + """
FROM postings WHERE regexp_matches(account, '(?i)Assets:') GROUP BY ledger_id""")
def q_units_by_commodity_wide(spark, sf_dir):
    u = hold.units_by_commodity(ledger(spark, sf_dir).postings, keep_zero=True)
    return hold.units_pivot(u, UNIT_CURRENCIES).select("ledger_id", *[money(c) for c in UNIT_CURRENCIES])


@register("drill_down_display", f"""
, {SQL_LAST_PX},
x AS (SELECT p.ledger_id, p.date, COALESCE(p.payee, '') AS payee, COALESCE(p.narration, '') AS narration,
  CAST(CASE WHEN p.currency = 'USD' THEN CAST(p.number AS DECIMAL(38,6)) WHEN lpx.amount IS NOT NULL THEN CAST(p.number * lpx.amount AS DECIMAL(38,6)) END AS DOUBLE) AS amount
  FROM postings p LEFT JOIN lpx ON lpx.currency = p.currency
  WHERE p.account = '{LEAF}' AND year(p.date) IN (1999, 2000))
SELECT ledger_id, date, payee, narration,
  (CASE WHEN round_even(COALESCE(amount, 0.0), 0) >= 0 THEN '+' ELSE '-' END)
    || format('{{:,}}', CAST(abs(round_even(COALESCE(amount, 0.0), 0)) AS BIGINT)) AS amount
FROM x""")
def q_drill_down_display(spark, sf_dir):
    from tallyframe.functions.money import coerce_amount, format_amount

    d = q_drill_down_raw(spark, sf_dir)
    return d.select("ledger_id", "date", "payee", "narration",
                    format_amount(coerce_amount("amount"), show_sign=True).alias("amount"))


def q_drill_down_raw(spark, sf_dir):
    L = ledger(spark, sf_dir)
    L = L.of("^Expenses", ignore_case=True)
    tx = flows.expense_postings(L.postings, L.prices, TARGET)
    leaves = tree.leaf_accounts(tree.expense_accounts(L.postings))
    return tree.drill_down(tx, leaves, LEAF, (1999, 2000))



# ------------------------------------------------------------ S1 text ingest
_RENDERED: dict[tuple[str, str], str] = {}
_PARSED: dict[str, object] = {}


def _text_files(spark, sf_dir):
    """Render the ledger tables as plaintext ledger files (one folder per
    ledger, several files each) once per session, from the star join written
    once.  Returns their folder and the ledger id column."""
    import uuid

    from tallyframe.session import path_exists, scratch_path, set_conf
    from tallyframe.sources.star import (
        star_bad_lines, star_base_text, star_ledger_directives, star_ledger_opens, star_ledger_text, star_postings, star_prices, with_legs,
        write_star_base)

    key = ledger_key(spark, sf_dir)
    src = _RENDERED.get(key)
    if src is None or not path_exists(spark, f"{src}/_SUCCESS"):
        run = uuid.uuid4().hex[:12]
        src = scratch_path(spark, f"ledger-text-{run}")
        base = write_star_base(spark, sf_dir, scratch_path(spark, f"ledger-base-{run}"))
        rows, names, units = with_legs(base), star_postings(base, "account", "currency"), star_postings(base, "account", "currency", "number")
        if rows.where("date IS NULL OR payee IS NULL OR narration IS NULL").limit(1).count():
            # a block without its header runs on the block before it: all blocks come in one order, that of their labels' shuffle
            L = ledger(spark, sf_dir)
            text, prices, rows, names, units = star_ledger_text(L.postings), L.prices, L.postings, L.postings, L.postings
        else:
            text, prices = star_base_text(base), star_prices(spark, sf_dir, rows)
        blocks = text.unionByName(star_ledger_directives(names, prices, star_balances(units))).unionByName(
            star_ledger_opens(names)).unionByName(star_bad_lines(rows))
        # a task holds the files of some ledgers open, so that it need not sort its text by ledger
        with set_conf(spark, "spark.sql.maxConcurrentOutputFileWriters", "32"):
            (blocks.write.partitionBy("ledger_id").mode("overwrite").option("compression", "gzip")
             .option("maxRecordsPerFile", 200_000).text(src))
        _RENDERED[key] = src
    # (without a pattern: it is cut out of every row's path)
    return src, F.substring_index(F.substring_index("ledger_id", "ledger_id=", -1), "/", 1).cast("int").alias("ledger_id")


def _text_ledger(spark, sf_dir):
    """The rendered ledger files parsed back with the text ingest.  Returns
    (parsed tables, ledger id column)."""
    from tallyframe.sources.ledger_text import load_ledger

    src, lid = _text_files(spark, sf_dir)
    if src not in _PARSED:  # the lines are scanned and written once a session
        _PARSED[src] = load_ledger(spark, src)
    return _PARSED[src], lid


SQL_LOAD = """
SELECT ledger_id, date, payee, narration, account, CAST(number AS DOUBLE) AS number, currency,
  CAST(cost_number AS DOUBLE) AS cost_number, cost_currency, cost_date FROM postings"""


def _parsed_postings(t, lid):
    return t.postings.select(lid, "date", "payee", "narration", "account",
                             F.col("number").cast("double").alias("number"), "currency",
                             F.col("cost_number").cast("double").alias("cost_number"), "cost_currency", "cost_date")


@register("load_ledger", SQL_LOAD)
def q_load_ledger(spark, sf_dir):
    """Plaintext ledgers derived from the given tables, ingested with the
    text parser; the parsed postings equal the postings they came from."""
    return _parsed_postings(*_text_ledger(spark, sf_dir))


@register("load_ledger_incremental", SQL_LOAD)
def q_load_ledger_incremental(spark, sf_dir):
    """S1, continuous: the same files read as a stream, some per batch, and
    merged into the tables of a ledger store."""
    from tallyframe.streaming.ledger_files import LedgerStore

    src, lid = _text_files(spark, sf_dir)
    store = LedgerStore(spark, _stream_dirs(spark, "ledger_store")[0])
    store.ingest(src, files_per_batch=4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return _parsed_postings(store.tables(), lid)


@register("load_ledger_text", SQL_LOAD)
def q_load_ledger_text(spark, sf_dir):
    """Texts held in a table, one ledger a payee, parsed without files."""
    from tallyframe.sources.ledger_text import load_ledger_text
    from tallyframe.sources.star import star_ledger_text

    L = ledger(spark, sf_dir)
    # one shuffle, by payee: legs meet, and blocks are collected, where it put them; a block without its
    # header's payee is kept apart, as it would else run on the block before it
    shown = F.regexp_extract("block", r'\* "([^"]*)"', 1)
    texts = star_ledger_text(L.postings, "payee").groupBy("ledger_id", "payee", shown.alias("shown")) \
        .agg(F.array_join(F.collect_list("block"), "\n").alias("text"))
    name = F.concat(F.lit("ledger_id="), F.col("ledger_id").cast("string"), F.lit("/"), F.to_json(F.struct("shown", "payee")))
    t = load_ledger_text(spark, texts.select(name.alias("ledger_id"), "text"))
    return _parsed_postings(t, F.regexp_extract(F.col("ledger_id"), r"ledger_id=(-?\d+)", 1).cast("int").alias("ledger_id"))


@register("scan_prices", """
SELECT -1 AS ledger_id, date, currency, CAST(amount AS DOUBLE) AS amount, quote FROM prices""")
def q_scan_prices(spark, sf_dir):
    """The price table as read from the ledger text (shared price ledger)."""
    t, lid = _text_ledger(spark, sf_dir)
    return t.prices.select(lid, "date", "currency", F.col("amount").cast("double").alias("amount"), "quote")


SQL_BAD = "bad AS (SELECT DISTINCT ledger_id, txn_id FROM postings WHERE txn_id % 97 = 0)"
SQL_OPENS = """opens AS (SELECT ledger_id, account, CASE WHEN starts_with(account, 'Liabilities:') THEN ['USD'] ELSE ccys END AS ccys FROM
  (SELECT ledger_id, account, list(DISTINCT currency) AS ccys FROM postings WHERE account <> 'Income:MACHINERY' GROUP BY ledger_id, account))"""


@register("directive_census", f"""
, {SQL_BAD}, {SQL_OPENS},
c AS (SELECT ledger_id, 'transaction' AS directive, TRUE AS known, COUNT(*) AS n FROM
  (SELECT DISTINCT ledger_id, txn_id, line_no, date, payee, narration FROM postings) GROUP BY ledger_id
UNION ALL SELECT ledger_id, 'commodity', TRUE, COUNT(DISTINCT currency) FROM postings GROUP BY ledger_id
UNION ALL SELECT ledger_id, 'open', TRUE, COUNT(*) FROM opens GROUP BY ledger_id
UNION ALL SELECT ledger_id, 'balance', TRUE, COUNT(*) FROM balances GROUP BY ledger_id
UNION ALL SELECT -1, 'price', TRUE, COUNT(*) FROM prices
UNION ALL SELECT ledger_id, CASE txn_id % 6 WHEN 2 THEN 'pad' WHEN 3 THEN 'price' WHEN 4 THEN 'balance' ELSE 'frobnicate' END,
  txn_id % 6 <> 5, 1 FROM bad WHERE txn_id % 6 >= 2)
SELECT ledger_id, directive, known, CAST(SUM(n) AS BIGINT) AS count FROM c GROUP BY ALL""")
def q_directive_census(spark, sf_dir):
    from tallyframe.sources.ledger_text import directive_census

    t, lid = _text_ledger(spark, sf_dir)
    c = directive_census(t)
    return c.select(lid, "directive", "known", "count").groupBy("ledger_id", "directive", "known").agg(
        F.sum("count").alias("count"))


@register("ingest_rejects", f"""
, {SQL_BAD}
SELECT ledger_id, CASE txn_id % 6 WHEN 0 THEN 'bad_date' WHEN 1 THEN 'unparsed_line' WHEN 2 THEN 'not_applied' WHEN 3 THEN 'unparsed_price'
    WHEN 4 THEN 'unparsed_balance' ELSE 'unknown_directive' END AS kind,
  CASE txn_id % 6 WHEN 0 THEN '2000-02-30 * "bad ' || txn_id || '"' WHEN 1 THEN 'not a directive ' || txn_id
    WHEN 2 THEN '2000-01-01 pad Assets:Cash' || txn_id || ' Equity:Opening' WHEN 3 THEN '2000-01-01 price GLD 100/' || txn_id || ' USD'
    WHEN 4 THEN '2000-01-01 balance Assets:Cash ten' || txn_id || ' USD' ELSE '2000-01-01 frobnicate ' || txn_id END AS message
FROM bad""")
def q_ingest_rejects(spark, sf_dir):
    """Every line that is not understood or not applied, one row each."""
    t, lid = _text_ledger(spark, sf_dir)
    return t.errors.select(lid, "kind", "message")


@register("operating_currencies", """
SELECT DISTINCT ledger_id, CASE WHEN ledger_id % 2 = 0 THEN 'USD,EUR' ELSE 'USD' END AS operating_currency,
  'USD' AS default_currency FROM postings""")
def q_operating_currencies(spark, sf_dir):
    """The option lines of each ledger."""
    from tallyframe.sources.ledger_text import operating_currencies

    t, lid = _text_ledger(spark, sf_dir)
    oc = operating_currencies(t.options.withColumn("ledger_id", lid))
    return oc.withColumn("operating_currency", F.array_join("operating_currency", ","))


SQL_DASH_POSTINGS = "SELECT ledger_id, date, account, CAST(number AS DOUBLE) AS number, currency FROM postings WHERE contains(account, ':Banks:')"


@register("dash_postings", SQL_DASH_POSTINGS)
def q_dash_postings(spark, sf_dir):
    """The postings of the accounts opened with include_in_dash."""
    from tallyframe.sources.ledger_text import dash_accounts, dash_postings

    t, lid = _text_ledger(spark, sf_dir)
    p = dash_postings(t.postings.withColumn("ledger_id", lid), dash_accounts(t).withColumn("ledger_id", lid))
    return p.select("ledger_id", "date", "account", F.col("number").cast("double").alias("number"), "currency")


@register("commodity_set", "SELECT DISTINCT ledger_id, currency FROM postings")
def q_commodity_set(spark, sf_dir):
    from tallyframe.sources.ledger_text import commodity_set

    t, lid = _text_ledger(spark, sf_dir)
    return commodity_set(t).select(lid, "currency").distinct()


@register("ledger_errors_text", f"""
, {SQL_OPENS},
dd AS (SELECT ledger_id, account, currency, date, SUM(number) AS delta FROM postings GROUP BY ALL),
anc AS (SELECT ledger_id, array_to_string(list_slice(string_split(account, ':'), 1, n), ':') AS path, currency, date, delta
        FROM dd, generate_series(1, len(string_split(account, ':'))) g(n)),
act AS (SELECT b.ledger_id, b.date, b.account, b.currency, b.number AS expected, COALESCE(SUM(a.delta), 0) AS actual
        FROM balances b LEFT JOIN anc a ON a.ledger_id = b.ledger_id AND a.path = b.account AND a.currency = b.currency AND a.date < b.date
        GROUP BY ALL)
SELECT ledger_id, 'balance' AS kind, date, account, currency, CAST(expected AS DOUBLE) AS expected,
  CAST(actual AS DOUBLE) AS actual, CAST(actual - expected AS DOUBLE) AS diff FROM act WHERE abs(actual - expected) > 0.005
UNION ALL
SELECT ledger_id, 'unbalanced', min(date), NULL, ccy, 0, CAST(SUM(w) AS DOUBLE), CAST(SUM(w) AS DOUBLE) FROM
  (SELECT *, CASE WHEN cost_number IS NOT NULL THEN number * cost_number ELSE number END AS w, COALESCE(cost_currency, currency) AS ccy FROM postings)
GROUP BY ledger_id, txn_id, line_no, date, payee, narration, ccy HAVING abs(SUM(w)) > 0.005
UNION ALL
SELECT p.ledger_id, CASE WHEN o.account IS NULL THEN 'unopened_account' ELSE 'currency_not_allowed' END, p.date, p.account, p.currency,
  NULL, CAST(p.number AS DOUBLE), NULL
FROM postings p LEFT JOIN opens o USING (ledger_id, account) WHERE o.account IS NULL OR NOT list_contains(o.ccys, p.currency)""")
def q_ledger_errors_text(spark, sf_dir):
    """S3 on ingested text: balance assertions, open directives and
    transaction balances checked against the parsed postings; a transaction
    is its header line's (file, line)."""
    t, lid = _text_ledger(spark, sf_dir)
    # (a folder is a ledger, so a file's name is enough to tell it from others of its ledger)
    p = t.postings.withColumn("ledger_id", lid).withColumn("file", F.substring_index("file", "/", -1))
    b = t.balances.withColumn("ledger_id", lid)
    e = checks.ledger_errors(p, b, t.opens.withColumn("ledger_id", lid))
    return e.select("ledger_id", "kind", "date", "account", "currency",
                    *[F.col(c).cast("double").alias(c) for c in ("expected", "actual", "diff")])


# ------------------------------------------------------------ ordered outputs
def ranked_accounts(df: DataFrame, order, name: str = "account_rank") -> DataFrame:
    """``df`` with its account's position among its ledger's accounts: ranked
    over the distinct accounts, not over the rows."""
    ranks = global_rank(df.select("ledger_id", "account").distinct().withColumn("__order", order), ["__order"], name, by=["ledger_id"])
    return df.join(ranks.drop("__order"), ["ledger_id", "account"])


@register("holdings_order", f"""
, h AS (SELECT ledger_id, account, currency, cost_date, cost_number, SUM(number) AS units,
   CASE WHEN starts_with(account, 'Assets') THEN '0-' ELSE '1-' END || account AS sortkey
 FROM postings WHERE {SQL_ASSETS_LIAB} GROUP BY ALL)
SELECT ledger_id, account, currency, cost_date AS acquisition_date, CAST(cost_number AS DOUBLE) AS cost, CAST(ROUND(units, 2) AS DOUBLE) AS units,
  sortkey, CAST(dense_rank() OVER (PARTITION BY ledger_id ORDER BY sortkey) AS INTEGER) AS account_rank,
  CAST(rank() OVER (PARTITION BY ledger_id, account ORDER BY currency, cost_date NULLS FIRST) AS INTEGER) AS lot_rank
FROM h""")
def q_holdings_order(spark, sf_dir):
    """O1: holdings by account sort key, then currency and acquisition date."""
    L = ledger(spark, sf_dir)
    h = ranked_accounts(hold.holdings(L.postings, L.prices), acc.account_sortkey("account"))
    lot = Window.partitionBy("ledger_id", "account").orderBy("currency", F.col("acquisition_date").asc_nulls_first())
    return h.select("ledger_id", "account", "currency", "acquisition_date", F.col("cost").cast("double").alias("cost"),
                    money("units"), "sortkey", "account_rank", F.rank().over(lot).alias("lot_rank"))


@register("trend_order", SQL_CURVES + _flows_sql() + """
SELECT cv.ledger_id, cv.date, CAST(row_number() OVER (PARTITION BY cv.ledger_id ORDER BY cv.date) AS INTEGER) AS day_rank,
  CAST(ROUND(least(target_portfolio_tilt, target_spending_tilt) - spending, 2) AS DOUBLE) AS tilt_trend
FROM cv JOIN inc USING (ledger_id, date) JOIN spd USING (ledger_id, date)""")
def q_trend_order(spark, sf_dir):
    """O3: the trend in date order (one row per day and ledger)."""
    trend = q_delta_trend(spark, sf_dir).select("ledger_id", "date", "tilt_trend")
    return global_rank(trend, ["date"], "day_rank", by=["ledger_id"])


@register("accounts_sorted", f"""
, a AS (SELECT DISTINCT ledger_id, account FROM postings WHERE {SQL_ASSETS_LIAB})
SELECT ledger_id, account, CAST(row_number() OVER (PARTITION BY ledger_id ORDER BY account) AS INTEGER) AS account_rank FROM a""")
def q_accounts_sorted(spark, sf_dir):
    """The accounts of an inventory in name order."""
    p = ledger(spark, sf_dir).postings.where(acc.account_match("Assets|Liabilities"))
    return ranked_accounts(p.select("ledger_id", "account").distinct(), F.col("account"))


@register("missing_order", """
, b AS (SELECT min(date) AS lo, max(date) AS hi FROM prices),
cs AS (SELECT DISTINCT currency FROM prices),
g AS (SELECT CAST(d AS DATE) AS date, currency FROM b, cs, generate_series(b.lo, b.hi, INTERVAL 1 DAY) t(d)),
m AS (SELECT date, currency FROM g ANTI JOIN (SELECT DISTINCT currency, date FROM prices) p USING (currency, date))
SELECT date, currency, CAST(dense_rank() OVER (ORDER BY date) AS INTEGER) AS day_rank,
  CAST(row_number() OVER (ORDER BY date, currency) AS INTEGER) AS row_rank FROM m""")
def q_missing_order(spark, sf_dir):
    """Missing price days by date, then currency, ranked over the whole
    series."""
    m = gaps.missing_prices(ledger(spark, sf_dir).prices).select("date", "currency")
    days = global_rank(m.select("date").distinct(), ["date"], "day_rank")
    return global_rank(m, ["date", "currency"], "row_rank").join(days, "date").select("date", "currency", "day_rank", "row_rank")


# ------------------------------------------------------------ S9, S13, W10, X13, A8 Year, F6 invert
LIFE_HEADER = 3


@register("life_table_file", SQL_LIFE + """
SELECT h.household_id, h.age_1, ROUND(r.qx, 9) AS qx FROM households h JOIN lt_raw r ON r.table_id = 'male' AND r.age = h.age_1""")
def q_life_table_file(spark, sf_dir):
    """A life table read from a CSV file with header lines, looked up for
    every household."""
    from tallyframe.session import scratch_path

    path = scratch_path(spark, "life-table")
    t = act.synthetic_life_tables(spark)
    head = spark.range(LIFE_HEADER).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("# header "), F.col("id").cast("string")).alias("value"))
    body = t.select((F.col("row_idx") + LIFE_HEADER).alias("k"), F.concat_ws(",", "table_id", "row_idx", "age", "qx").alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(path)  # 250 lines
    read = act.load_life_table(act.read_life_table(spark, path))
    male = broadcast_if_small(read.where("table_id = 'male'").select(F.col("age").alias("age_1"), "qx"))
    return star_households(spark, sf_dir).join(male, "age_1").select("household_id", "age_1", F.round("qx", 9).alias("qx"))


@register("survival_probs", SQL_LIFE + """,
s AS (SELECT a.age AS start_age, p.age, COALESCE(product(px) OVER (PARTITION BY a.age ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS sp,
   row_number() OVER (PARTITION BY a.age ORDER BY p.pos) - 1 AS t
 FROM (SELECT DISTINCT CAST(age_1 AS BIGINT) AS age FROM households) a JOIN pos p ON p.table_id = 'male' AND p.age >= a.age)
SELECT h.household_id, h.age_1, CAST(t AS INTEGER) AS t, ROUND(sp, 6) AS surv_prob FROM households h JOIN s ON s.start_age = h.age_1 AND t IN (1, 10, 25)""")
def q_survival_probs(spark, sf_dir):
    """Survival 1, 10 and 25 years ahead for every household's first age."""
    hh = star_households(spark, sf_dir)
    curves = act.survival_curves(_life(spark).where("table_id = 'male'"), hh.select(F.col("age_1").cast("long").alias("start_age")).distinct())
    at = curves.where(F.col("t").isin(1, 10, 25)).select(F.col("start_age").alias("age_1"), "t", "surv_prob")
    return hh.join(at, "age_1").select("household_id", "age_1", "t", ratio("surv_prob"))


@register("rate_schedule", """
SELECT DISTINCT date, CASE WHEN date >= make_date(year(date), 2, 23) THEN CAST(0.031 AS DOUBLE) ELSE CAST(0.032 AS DOUBLE) END AS rate FROM postings""")
def q_rate_schedule(spark, sf_dir):
    """S13 on both sides of Feb 23: the rate of every posting date."""
    return ledger(spark, sf_dir).postings.select("date").distinct().select("date", fin.rate_schedule("date").cast("double").alias("rate"))


@register("round_thousand", f"""
SELECT ledger_id, CAST(round_even(SUM(number), -3) AS BIGINT) AS thousands FROM postings WHERE {SQL_ASSETS_LIAB} AND currency = 'USD' GROUP BY ledger_id""")
def q_round_thousand(spark, sf_dir):
    """USD assets and liabilities to the nearest thousand."""
    from tallyframe.functions.money import round_thousand

    p = ledger(spark, sf_dir).postings.where(acc.account_match("Assets|Liabilities") & (F.col("currency") == "USD"))
    return p.groupBy("ledger_id").agg(F.sum("number").alias("n")).select("ledger_id", round_thousand("n").alias("thousands"))


@register("expenses_by_period_year", _sql_period("year"))
def q_expenses_by_year(spark, sf_dir):
    e = flows.expenses_by_period(ledger(spark, sf_dir).of("Expenses", "1995-01-01", "2001-12-31", ignore_case=True).postings, "Year", TARGET, years=(1995, 2001))
    return e.select("ledger_id", "date", money("amount"))


@register("expense_tree_invert", SQL_SUMMARY + """,
s AS (SELECT s.*, d.ly, d.ry FROM summary s JOIN dflt d USING (ledger_id)
      WHERE starts_with(account, 'Expenses:') AND string_split(account, ':')[2] = 'LARGE'),
e AS (SELECT ledger_id, array_to_string(list_slice(string_split(account, ':'), 1, n), ':') AS path,
        CASE WHEN year = ly THEN COALESCE(amount, 0) END AS l, CASE WHEN year = ry THEN COALESCE(amount, 0) END AS r
      FROM s, generate_series(2, len(string_split(account, ':'))) g(n))
SELECT ledger_id, path, CAST(ROUND(COALESCE(SUM(l), 0), 2) AS DOUBLE) AS left_amount, CAST(ROUND(COALESCE(SUM(r), 0), 2) AS DOUBLE) AS right_amount
FROM e GROUP BY ALL""")
def q_expense_tree_invert(spark, sf_dir):
    """F6 inverted: only the chosen categories."""
    L = ledger(spark, sf_dir)
    t = tree.expense_tree(_summary(L), exclude=["LARGE"], invert=True, with_total=False)
    return t.select("ledger_id", "path", money("left_amount"), money("right_amount"))


@register("units_by_commodity_rest", """
, u AS (SELECT ledger_id, currency, SUM(number) AS units FROM postings WHERE regexp_matches(account, '(?i)Assets:') GROUP BY ALL)
SELECT ledger_id, CAST(ROUND(SUM(units) FILTER (WHERE currency = 'USD'), 2) AS DOUBLE) AS USD,
  CAST(ROUND(SUM(units) FILTER (WHERE currency = 'EUR'), 2) AS DOUBLE) AS EUR,
  coalesce(string_agg(currency || ' ' || CAST(CAST(units AS DECIMAL(38,2)) AS VARCHAR), ', ' ORDER BY currency) FILTER (WHERE currency NOT IN ('USD', 'EUR')), '') AS rest
FROM u GROUP BY ledger_id""")
def q_units_by_commodity_rest(spark, sf_dir):
    """U5 with two columns of its own and every other currency in the last."""
    u = hold.units_by_commodity(ledger(spark, sf_dir).of("Assets:", ignore_case=True).postings, keep_zero=True)
    wide = hold.units_pivot(u, ["USD", "EUR"], others="rest")
    one = F.transform("rest", lambda x: F.concat(x["currency"], F.lit(" "), x["units"].cast("decimal(38,2)").cast("string")))
    return wide.select("ledger_id", money("USD"), money("EUR"), F.array_join(one, ", ").alias("rest"))


@register("postings_converted", f"""
, {SQL_USD_PX}, src AS (SELECT * FROM postings),
{SQL_POSTING_PX}
SELECT ledger_id, txn_id, line_no, date, account, CASE WHEN rate IS NOT NULL THEN 'USD' ELSE currency END AS currency,
  CAST(ROUND(CASE WHEN rate IS NOT NULL THEN CAST(number * rate AS DECIMAL(38,6)) ELSE CAST(number AS DECIMAL(38,6)) END, 2) AS DOUBLE) AS number
FROM pp""")
def q_postings_converted(spark, sf_dir):
    """J1 on single rows: every posting at the rate of its own date."""
    L = ledger(spark, sf_dir)
    c = convert(L.postings, L.prices, TARGET, via=None, inverse=False, row_level=True)
    return c.select("ledger_id", "txn_id", "line_no", "date", "account", F.col("conv_currency").alias("currency"),
                    money("conv_number").alias("number"))


@register("rate_schedule_steps", """
, steps AS (SELECT ledger_id, min(date) AS effective, CAST(0.030 + (year(date) % 5) * 0.001 + ledger_id * 0.0001 AS DECIMAL(8,4)) AS rate
            FROM postings GROUP BY ledger_id, year(date)
            UNION ALL SELECT ledger_id, max(date), CAST(0.02 AS DECIMAL(8,4)) FROM postings WHERE year(date) = 1997 GROUP BY ledger_id),
d AS (SELECT DISTINCT ledger_id, date FROM postings)
SELECT d.ledger_id, d.date, CAST(s.rate AS DOUBLE) AS rate FROM d ASOF LEFT JOIN
  (SELECT ledger_id, effective, max(rate) AS rate FROM steps GROUP BY ALL) s ON s.ledger_id = d.ledger_id AND s.effective <= d.date""")
def q_rate_schedule_steps(spark, sf_dir):
    """S13 / J8 in general: each ledger's own steps, one a year on its first
    posting day, and a cut at the end of 1997."""
    p = ledger(spark, sf_dir).postings.select("ledger_id", "date")
    year = F.year("date")
    rate = (F.lit("0.030").cast("decimal(8,4)") + (year % 5) * F.lit("0.001").cast("decimal(8,4)") + F.col("ledger_id") * F.lit("0.0001").cast("decimal(8,4)"))
    steps = p.groupBy("ledger_id", year.alias("y")).agg(F.min("date").alias("date")).select(
        "ledger_id", F.col("date").alias("effective"), rate.cast("decimal(8,4)").alias("rate"))
    cut = p.where(year == 1997).groupBy("ledger_id").agg(F.max("date").alias("effective")).withColumn("rate", F.lit("0.02").cast("decimal(8,4)"))
    out = fin.rate_steps(p.distinct(), steps.unionByName(cut), ["ledger_id"])
    return out.select("ledger_id", "date", F.col("rate").cast("double").alias("rate"))


@register("ledger_errors_tolerance", """
, o AS (SELECT o_custkey AS ledger_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS date, o_orderkey % 3 = 0 AS beyond, o_orderkey % 4 AS c FROM orders)
SELECT ledger_id, 'unbalanced' AS kind, date, ['JPY', 'USD', 'SHR', 'CHF'][c + 1] AS currency,
  -[1, 0.006, 0.0000006, 0.01][c + 1]::DOUBLE AS diff FROM o WHERE beyond""")
def q_ledger_errors_tolerance(spark, sf_dir):
    """S3 with tolerances inferred from how amounts are written: whole yen
    exactly, cents to half a cent, six-digit shares to half a millionth."""
    from tallyframe.sources.ledger_text import load_ledger_text
    from tallyframe.sources.star import star_precision_text

    t = load_ledger_text(spark, star_precision_text(spark, sf_dir))
    e = checks.ledger_errors(t.postings, t.balances)
    return e.select(F.col("ledger_id").cast("long").alias("ledger_id"), "kind", "date", "currency", F.col("diff").cast("double").alias("diff"))


@register("clean_small_table", f"""
, i AS ({SQL_ROOT_AT.format(d=AS_OF)}),
tol AS (SELECT ledger_id, currency, max(abs(number)) * 20 AS t FROM postings WHERE currency <> 'HRS' GROUP BY ALL),
big AS (SELECT ledger_id, account FROM i LEFT JOIN tol USING (ledger_id, currency) GROUP BY ALL HAVING bool_or(abs(number) > coalesce(t, 0)))
SELECT {INV_OUT} FROM i SEMI JOIN big USING (ledger_id, account)""")
def q_clean_small_table(spark, sf_dir):
    """F12 with a table of tolerances by ledger and currency."""
    L = ledger(spark, sf_dir)
    tol = L.postings.where("currency <> 'HRS'").groupBy("ledger_id", "currency").agg((F.max(F.abs("number")) * 20).alias("tolerance"))
    return _inv_out(inv.clean_small(_root_at(L, AS_OF), tol))
