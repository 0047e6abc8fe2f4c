"""Text ingest and end-to-end goldens: on a ledger of the demo ledger's shape
(demo_ledger.py), whose values are summed from what it was written from, and on
the demo ledger itself (FIXTURES.md §3) where ``DEMO_LEDGER`` names its file."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import demo_ledger
import pytest
from pyspark.sql import functions as F

from conftest import EXAMPLE_LEDGER
from tallyframe.operators import checks, gaps, holdings, tree
from tallyframe.plans import networth as nw
from tallyframe.sources.ledger_text import directive_census, load_ledger, load_ledger_text, operating_currencies

D = dt.date

# FIXTURES.md §3.
DEMO = {
    "transactions": 1044, "postings": 3209, "lots": 212, "priced": 5, "accounts": 58, "prices": 846, "directives": (60, 82, 10, 9, 0),
    "networth": [(D(2015, 1, 1), "6041.12"), (D(2015, 12, 31), "43483.50570"), (D(2016, 6, 30), "67404.65883"), (D(2017, 9, 8), "117649.48828")],
    "units_day": D(2017, 9, 8),
    "units": {"GLD": "17", "ITOT": "104", "RGAGX": "597.748", "USD": "906.58", "VACHR": "-13", "VBMPX": "193.442", "VEA": "36", "VHT": "64",
              "IRAUSD": "0"},
    "spent": {2015: "95282.85", 2016: "94182.42", 2017: "65143.78"}, "food": ("6614.67", "6859.72"), "taxes": "53187.86",
    "gaps": (6, D(2015, 1, 2), D(2017, 9, 8), 5040), "holding_lots": (115, 110, 5), "left_out": 0,
}


@pytest.fixture(scope="module", params=["made", "demo"] if EXAMPLE_LEDGER and os.path.exists(EXAMPLE_LEDGER) else ["made"])
def books(request, spark):
    """(tables, expected values)"""
    if request.param == "demo":
        path, gold = EXAMPLE_LEDGER, DEMO
    else:
        text, gold = demo_ledger.make()
        path = os.path.join(tempfile.mkdtemp(prefix="tf-demo-"), "made.ledger")
        with open(path, "w") as f:
            f.write(text)
    t = load_ledger(spark, path)
    t.postings.cache()
    return t, gold


@pytest.fixture()
def ledger(books):
    return books[0]


@pytest.fixture()
def gold(books):
    return books[1]


def test_directive_counts(ledger, gold):
    assert ledger.transactions.count() == gold["transactions"] > 900
    assert ledger.postings.count() == gold["postings"]
    assert ledger.postings.where("cost_number IS NOT NULL").count() == gold["lots"] > 100
    assert ledger.postings.where("price_number IS NOT NULL").count() == gold["priced"] > 3
    assert ledger.postings.where("digits IS NULL").count() == gold["left_out"]
    assert ledger.postings.select("account").distinct().count() == gold["accounts"]
    assert ledger.prices.count() == gold["prices"]
    assert (ledger.opens.count(), ledger.balances.count(), ledger.commodities.count(),
            ledger.events.count(), ledger.customs.count()) == gold["directives"]
    assert ledger.errors.count() == 0
    census = {r.directive: r["count"] for r in directive_census(ledger).collect()}
    assert census["transaction"] == gold["transactions"] and census["price"] == gold["prices"]


def test_options(ledger):
    r = operating_currencies(ledger.options).first()
    assert r.default_currency == "USD"


def test_balance_assertions_hold(ledger, gold):
    assert ledger.balances.count() >= 80
    assert checks.balance_failures(ledger.postings, ledger.balances).count() == 0
    assert checks.unbalanced_transactions(ledger.postings).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_networth_goldens(ledger, gold, k):
    day, expected = gold["networth"][k]
    r = nw.networth_series(ledger.postings, ledger.prices, [day], "USD").first()
    assert r.net_worth == Decimal(expected)


def test_units_golden(ledger, gold):
    from tallyframe.operators.balances import asof_balances

    p = ledger.postings.where(F.col("account").rlike("Assets|Liabilities"))
    got = {r.currency: r.units for r in asof_balances(p, [gold["units_day"]]).collect()}
    assert {k: Decimal(v) for k, v in gold["units"].items()} == got


def test_expense_goldens(ledger, gold):
    s = tree.expense_by_year_account(ledger.postings, ledger.prices, "USD")
    by_year = {r.year: r.total for r in s.groupBy("year").agg(F.sum("amount").alias("total")).collect()}
    assert {y: round(v, 2) for y, v in by_year.items()} == {y: Decimal(v) for y, v in gold["spent"].items()}
    t = {r.path: r for r in tree.expense_tree(s, 2015, 2016, exclude=[]).collect()}
    assert (round(t["Expenses:Food"].left_amount, 2), round(t["Expenses:Food"].right_amount, 2)) == tuple(map(Decimal, gold["food"]))
    assert round(t["Expenses:Taxes"].left_amount, 2) == Decimal(gold["taxes"])
    total = t["__total__"]
    assert total.left_amount == sum(r.left_amount for r in t.values() if r.depth == 1)
    t2 = {r.path for r in tree.expense_tree(s, 2016, 2017).collect()}
    assert "Expenses:Taxes" not in t2 and "Expenses:Food" in t2


def test_missing_prices_golden(ledger, gold):
    commodities, first, last, missing = gold["gaps"]
    assert ledger.prices.select("currency").distinct().count() == commodities
    assert gaps.missing_prices(ledger.prices, str(first), str(last)).count() == missing


def test_holdings_lots(ledger, gold):
    h = holdings.holdings(ledger.postings, ledger.prices).where(F.col("account").startswith("Assets"))
    lots = h.where("cost IS NOT NULL")
    assert (lots.count(), lots.where("units <> 0").count(), h.where("cost IS NULL").count()) == gold["holding_lots"]


def test_networth_detail_sums_to_series(ledger):
    days = [D(2015, 6, 30), D(2016, 12, 31), D(2017, 9, 8)]
    series = {r.date: r.net_worth for r in nw.networth_series(ledger.postings, ledger.prices, days).collect()}
    detail = {r.date: r.v for r in nw.networth_detail(ledger.postings, ledger.prices, days)
              .groupBy("date").agg(F.sum("value").alias("v")).collect()}
    assert series == detail


def test_load_ledger_text(spark):
    text = """option "operating_currency" "EUR"
2020-01-01 open Assets:Cash EUR
2020-01-02 * "Shop" "Groceries" #food
  Expenses:Food   12.50 EUR
  Assets:Cash
2020-01-03 balance Assets:Cash -12.50 EUR
"""
    t = load_ledger_text(spark, {"l1": text})
    rows = sorted((r.account, r.number, r.currency) for r in t.postings.collect())
    assert rows == [("Assets:Cash", Decimal("-12.5"), "EUR"), ("Expenses:Food", Decimal("12.5"), "EUR")]
    assert t.transactions.first().tags == ["food"]
    assert checks.balance_failures(t.postings, t.balances).count() == 0
    kinds = [r.kind for r in checks.ledger_errors(t.postings, t.balances, t.opens).collect()]
    assert kinds == ["unopened_account"]  # Expenses:Food is never opened
    t2 = load_ledger_text(spark, {"l1": text.replace("2020-01-02 *", "2020-01-01 open Expenses:Food\n2020-01-02 *")})
    assert checks.ledger_errors(t2.postings, t2.balances, t2.opens).count() == 0


def test_options_metadata_and_prices_text(spark):
    from tallyframe.sources.ledger_text import commodity_set, dash_accounts

    text = """option "title" "Two currencies"
option "operating_currency" "USD"
option "operating_currency" "EUR"
2020-01-01 commodity GLD
  name: "Gold"
2020-01-01 open Assets:Investing GLD,USD
  include_in_dash: "true"
2020-01-01 open Assets:Checking USD
2020-01-05 price GLD  150.25 USD
2020-01-05 price GLD  151.00 USD
2020-01-06 * "Broker" "Buy gold"
  Assets:Investing    2 GLD {150.25 USD, 2020-01-06} @ 151.00 USD
  Assets:Checking  -300.50 USD
2020-01-07 custom "budget" Expenses:Food "monthly" 100.00 USD
2020-01-08 event "location" "Paris"
"""
    t = load_ledger_text(spark, {"l": text})
    oc = operating_currencies(t.options).first()
    assert oc.operating_currency == ["USD", "EUR"] and oc.default_currency == "USD"
    assert [r.account for r in dash_accounts(t).collect()] == ["Assets:Investing"]
    assert [r.currency for r in commodity_set(t).collect()] == ["GLD"]
    assert t.commodities.first().meta == {"name": "Gold"}
    assert sorted(t.opens.where("account = 'Assets:Investing'").first().currencies) == ["GLD", "USD"]
    p = {r.account: r for r in t.postings.collect()}
    lot = p["Assets:Investing"]
    assert (lot.number, lot.currency, lot.cost_number, lot.cost_currency, lot.cost_date, lot.price_number) == (
        Decimal(2), "GLD", Decimal("150.25"), "USD", D(2020, 1, 6), Decimal("151"))
    assert t.prices.count() == 2
    assert t.customs.first().type == "budget" and t.events.first().value == "Paris"
    assert checks.unbalanced_transactions(t.postings).count() == 0
    assert checks.ledger_errors(t.postings, t.balances, t.opens).count() == 0
    # the same-day price that comes later in the file wins
    from tallyframe.operators.prices import dedup_prices
    assert dedup_prices(t.prices).first().amount == Decimal("151")


def test_currency_not_allowed_and_failed_balance(spark):
    text = """2020-01-01 open Assets:Cash EUR
2020-01-01 open Expenses:Food
2020-01-02 * "Shop" "Paid in the wrong currency"
  Expenses:Food   5.00 USD
  Assets:Cash    -5.00 USD
2020-01-03 balance Assets:Cash  -4.00 USD
"""
    t = load_ledger_text(spark, {"l": text})
    kinds = sorted((r.kind, r.account or "") for r in checks.ledger_errors(t.postings, t.balances, t.opens).collect())
    assert kinds == [("balance", "Assets:Cash"), ("currency_not_allowed", "Assets:Cash")]


PROBES = """option "title" "probes"
2020-01-01 open Assets:A
2020/01/02 * "Slash" "date"
  Assets:A   1 USD
  Income:B  -1 USD
2020-02-30 * "No" "such day"
  Assets:A   1 USD
2020-01-03 * "Double" "cost"
  Assets:A   4 GLD {{100 USD}}
  Assets:C  -100 USD
2020-01-03 * "Date only" "cost"
  Assets:A   4 GLD {2020-01-01}
  Assets:C  -100 USD
2020-01-03 * "Label only" "cost"
  Assets:A   4 GLD {"lot1"}
  Assets:C  -100 USD
2020-01-03 * "Expression" "amount"
  Assets:A   (100/4) USD
  Assets:C   -20 USD
2020-01-03 * "Too" "precise"
  Assets:A   0.0000000049 BTC
  Assets:C  -1 USD
2020-01-03 * "Two" "residuals"
  Assets:A   1 USD
  Assets:A   1 EUR
  Assets:C
2020-01-04 * "At" "price"
  Assets:A   100 EUR @ 1.10 USD
  Assets:C  -110 USD
2020-01-05 * "Pay #5 bill" ; see "z" #tag
  Assets:A   1 USD
  Assets:C  -1 USD
2020-01-06 balance Assets:C  -20 ~ 500 USD
2020-01-06 price GLD 100/3 USD
2020-01-07 pad Assets:A Equity:B
2020-01-07 close Assets:A
include "other.ledger"
what is this
  stray: indented
; a comment
"""


def test_no_line_stops_or_vanishes(spark):
    t = load_ledger_text(spark, {"l": PROBES})
    errors = sorted((r.line_no, r.kind) for r in t.errors.collect())
    assert errors == [(6, "bad_date"), (12, "unparsed_cost"), (15, "unparsed_cost"), (18, "unparsed_amount"), (21, "unparsed_amount"),
                      (26, "unresolved_amount"), (34, "unparsed_price"), (35, "not_applied"), (36, "not_applied"), (37, "not_applied"),
                      (38, "unparsed_line")]
    rows = {(r.narration or r.payee, r.account, r.currency): r for r in t.postings.collect()}
    assert rows[("date", "Assets:A", "USD")].date == D(2020, 1, 2)
    assert rows[("cost", "Assets:A", "GLD")] and any(r.cost_number == Decimal(25) for r in t.postings.collect())
    assert rows[("amount", "Assets:A", None)].number is None and rows[("amount", "Assets:C", "USD")].number == -20
    assert t.transactions.where("payee IS NULL").first().narration == "Pay #5 bill"
    assert t.transactions.where("narration = 'Pay #5 bill'").first().tags == []
    assert not {100, 110} & {abs(r.diff) for r in checks.unbalanced_transactions(t.postings).where("date = '2020-01-04'").collect()}
    assert checks.balance_failures(t.postings, t.balances).count() == 0  # within its own tolerance
    assert t.prices.count() == 0


def test_files_and_splits(spark, tmp_path):
    """Two files of one ledger keep their transactions apart; a file read in
    many splits gives the same tables as one read whole."""
    bad = '2020-01-01 * "x" "y"\n  Assets:A   1 USD\n  Assets:B  -{} USD\n'
    (tmp_path / "l").mkdir()
    for k in (0, 2):
        (tmp_path / "l" / f"{k}.ledger").write_text(bad.format(k))
    t = load_ledger(spark, str(tmp_path / "l"))
    assert sorted(float(r.diff) for r in checks.unbalanced_transactions(t.postings.withColumn("ledger_id", F.lit(1))).collect()) == [-1, 1]
    big = "".join(f'2020-01-{1 + k % 28:02d} * "p{k}" "n{k}"\n  ; note\n  Assets:A   {k}.5 USD\n\n  Assets:B\n' for k in range(400))
    (tmp_path / "big.ledger").write_text("odd line\n" + big)
    whole = load_ledger_text(spark, {"l": "odd line\n" + big})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        parts = load_ledger(spark, str(tmp_path / "big.ledger"))
        for table in ("postings", "transactions", "errors", "directives"):
            a, b = (sorted(map(str, getattr(x, table).drop("ledger_id", "file").collect())) for x in (whole, parts))
            assert a == b, table
        assert parts.postings.count() == 800 and parts.errors.count() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_sample_ledger(spark):
    """Every directive of the small ledger beside this file, and its values."""
    from tallyframe.sources.ledger_text import commodity_set, dash_accounts, dash_postings

    t = load_ledger(spark, os.path.join(os.path.dirname(__file__), "sample.ledger"))
    census = {(r.directive, r.known): r["count"] for r in directive_census(t).collect()}
    assert census == {("open", True): 5, ("commodity", True): 1, ("transaction", True): 3, ("price", True): 2, ("balance", True): 1,
                      ("event", True): 1, ("custom", True): 1, ("close", True): 1, ("note", True): 1, ("document", True): 1,
                      ("pad", True): 1, ("query", True): 1}
    assert sorted(r.message.split()[1] for r in t.errors.where("kind = 'not_applied'").collect()) == ["close", "document", "note", "pad", "query"]
    assert t.errors.count() == 5
    assert {(r.flag, r.payee, r.narration, *r.tags) for r in t.transactions.collect()} == {
        ("*", "Employer", "Pay", "salary"), ("*", "Broker", "Buy"), ("!", "Cafe", "Lunch")}
    elided = {r.account: r.number for r in t.postings.where("account IN ('Income:Work', 'Liabilities:Card')").collect()}
    assert elided == {"Income:Work": Decimal(-1000), "Liabilities:Card": Decimal("-30.5")}
    days = [D(2020, 1, 1), D(2020, 1, 4), D(2020, 1, 6)]
    got = {r.date: r.net_worth for r in nw.networth_series(t.postings, t.prices, days, "USD").collect()}
    assert got == {days[0]: 0, days[1]: 1000, days[2]: Decimal("989.5")}
    lot = holdings.holdings(t.postings, t.prices).where("currency = 'GLD'").first()
    assert (lot.units, lot.cost, lot.price, lot.book_value, lot.market_value, lot.acquisition_date) == (2, 100, 110, 200, 220, D(2020, 1, 3))
    assert [(r.date, r.currency) for r in gaps.missing_prices(t.prices).orderBy("date").collect()] == [
        (D(2020, 1, 4), "GLD"), (D(2020, 1, 5), "GLD")]
    assert checks.ledger_errors(t.postings, t.balances, t.opens).count() == 0
    assert [r.currency for r in commodity_set(t).collect()] == ["GLD"] and t.commodities.first().meta == {"name": "Gold"}
    assert [r.currency for r in dash_postings(t.postings, dash_accounts(t)).collect()] == ["GLD"]
    assert operating_currencies(t.options).first().default_currency == "USD"
    assert [r.amount for r in tree.expense_by_year_account(t.postings, t.prices, "USD").collect()] == [Decimal("30.5")]
    assert t.events.first().value == "Paris" and t.customs.first().type == "budget"
