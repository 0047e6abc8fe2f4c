"""DuckDB SQL oracles.

The driver registers only the base star tables, so every oracle starts with
the fixture views of FIXTURES.md section 2 inlined as CTEs (``PRELUDE``).
Each query appends its own CTEs and final SELECT through ``with_prelude``.

Output conventions shared with the Spark side (``tallyframe.plans.report``):
money is computed in DECIMAL and reported as
``CAST(ROUND(x, 2) AS DOUBLE)``; ratios and actuarial values are doubles
rounded to 6 places; dates stay DATE.
"""

from __future__ import annotations

PRELUDE_CTES = r"""
base AS (
 SELECT n.n_regionkey AS ledger_id, o.o_orderkey AS txn_id, l.l_linenumber AS line_no,
  l.l_partkey AS partkey, CAST(o.o_orderdate AS DATE) AS date, CAST(l.l_shipdate AS DATE) AS ship_date,
  REPLACE(r.r_name,' ','-') AS region, n.n_name AS nation, c.c_name AS payee,
  c.c_mktsegment AS segment, p.p_type AS ptype, REPLACE(p.p_brand,'#','') AS brand,
  p.p_name AS narration, l.l_returnflag AS kind,
  CONCAT('CM', CAST(l.l_partkey % 6 AS VARCHAR)) AS cmdty,
  CASE WHEN l.l_linenumber = 7 THEN 'HRS' WHEN c.c_nationkey % 5 = 0 THEN 'EUR' ELSE 'USD' END AS ccy,
  CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amt, CAST(l.l_quantity AS DECIMAL(18,2)) AS qty,
  CAST(p.p_retailprice AS DECIMAL(18,2)) AS unit_cost
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
 JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
 JOIN region r ON n.n_regionkey = r.r_regionkey JOIN part p ON l.l_partkey = p.p_partkey
),
postings AS (
 SELECT ledger_id, txn_id, line_no, date, payee, narration,
  CONCAT('Expenses:', ptype, ':', brand) AS account, amt AS number, ccy AS currency,
  CAST(NULL AS DECIMAL(18,2)) AS cost_number, CAST(NULL AS VARCHAR) AS cost_currency,
  CAST(NULL AS DATE) AS cost_date FROM base WHERE kind='N'
 UNION ALL SELECT ledger_id, txn_id, line_no, date, payee, narration, CONCAT('Liabilities:', region, ':CreditCards:', segment), -amt, ccy, NULL, NULL, NULL FROM base WHERE kind='N'
 UNION ALL SELECT ledger_id, txn_id, line_no, date, payee, narration, CONCAT('Income:', segment), -amt, ccy, NULL, NULL, NULL FROM base WHERE kind='R'
 UNION ALL SELECT ledger_id, txn_id, line_no, date, payee, narration, CONCAT('Assets:', region, ':Banks:', nation), amt, ccy, NULL, NULL, NULL FROM base WHERE kind='R'
 UNION ALL SELECT ledger_id, txn_id, line_no, date, payee, narration, CONCAT('Assets:', region, ':Investments:', cmdty), qty, cmdty, unit_cost, 'USD', date FROM base WHERE kind='A'
 UNION ALL SELECT ledger_id, txn_id, line_no, date, payee, narration, CONCAT('Assets:', region, ':Banks:', nation), CAST(-(qty*unit_cost) AS DECIMAL(18,2)), 'USD', NULL, NULL, NULL FROM base WHERE kind='A'
),
prices AS (
 SELECT ship_date AS date, cmdty AS currency, CAST(MAX(unit_cost) AS DECIMAL(18,4)) AS amount, 'USD' AS quote
  FROM base WHERE partkey % 4 = 0 OR partkey % 4 = 1 GROUP BY ship_date, cmdty
 UNION ALL SELECT MIN(date), 'EUR', CAST(CONCAT('1.', LPAD(CAST(MONTH(date) AS VARCHAR), 2, '0')) AS DECIMAL(18,4)), 'USD'
  FROM base GROUP BY YEAR(date), MONTH(date)
),
balances AS (
 SELECT ledger_id, DATE '1998-01-01' AS date, account, currency,
  CAST(CAST(SUM(number) AS DECIMAL(18,2)) + CASE WHEN account LIKE '%:CM3' THEN CAST(1.00 AS DECIMAL(18,2)) ELSE CAST(0.00 AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS number
 FROM postings WHERE date < DATE '1998-01-01' AND account LIKE 'Assets:%' GROUP BY ledger_id, account, currency
),
households AS (
 SELECT c_custkey AS household_id, CAST(50 + c_custkey % 30 AS INT) AS age_1, CAST(40 + c_custkey % 37 AS INT) AS age_2 FROM customer
)
"""


def with_prelude(body: str) -> str:
    """``body`` is either ``", extra AS (...) SELECT ..."`` (more CTEs) or a
    bare ``"SELECT ..."``."""
    body = body.strip()
    if body.startswith(","):
        return "WITH" + PRELUDE_CTES + body
    return "WITH" + PRELUDE_CTES + "\n" + body
