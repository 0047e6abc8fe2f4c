"""Hand-made cases and brute-force checks for the operators Spark lacks
(as-of lookups, interval explode, conversion fallbacks, annuities)."""

import datetime as dt
import math
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import accounts as acc
from tallyframe.functions import money as mf
from tallyframe.operators import asof, gaps, inventory as inv, prices as px
from tallyframe.operators.balances import asof_balances

D = dt.date


def test_asof_lookup_brute_force(spark):
    rnd = random.Random(7)
    series = sorted({(k, D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(60))) for k in "ab" for _ in range(15)})
    srows = [(k, d, float(i)) for i, (k, d) in enumerate(series)]
    pts = [(k, D(2019, 12, 25) + dt.timedelta(days=i)) for k in "abc" for i in range(0, 80, 3)]
    s = spark.createDataFrame(srows, "k string, date date, v double")
    p = spark.createDataFrame(pts, "k string, date date")
    got = {(r.k, r.date): r.v for r in asof.asof_lookup(p, s, ["k"], ["v"]).collect()}
    for k, d in pts:
        cands = [v for kk, dd, v in srows if kk == k and dd <= d]
        exp = cands[-1] if cands else None
        assert got[(k, d)] == exp, (k, d)


def test_explode_intervals_matches_brute_force(spark):
    steps = [("a", D(2020, 1, 5), 1), ("a", D(2020, 1, 20), 2), ("b", D(2020, 2, 1), 7)]
    df = spark.createDataFrame(steps, "k string, date date, v int")
    spine = [D(2020, 1, 1), D(2020, 1, 5), D(2020, 1, 19), D(2020, 1, 31), D(2020, 2, 29)]
    got = sorted((r.k, r.date, r.v) for r in asof.explode_intervals(df, ["k"], spine, ["v"], fill_before={"v": 0}).collect())
    exp = []
    for k in "ab":
        for d in spine:
            vs = [v for kk, dd, v in steps if kk == k and dd <= d]
            exp.append((k, d, vs[-1] if vs else 0))
    assert got == sorted(exp)
    daily = asof.daily_spine(D(2020, 1, 1), D(2020, 1, 31))
    n = asof.explode_intervals(df, ["k"], daily, ["v"]).where("k = 'a'").count()
    assert n == 27  # Jan 5 .. Jan 31


def test_asof_balances_brute_force(spark):
    rnd = random.Random(3)
    rows = [(1, rnd.choice(["USD", "EUR"]), D(2021, 1, 1) + dt.timedelta(days=rnd.randrange(90)),
             Decimal(rnd.randrange(-500, 500)) / 10) for _ in range(200)]
    p = spark.createDataFrame(rows, "ledger_id int, currency string, date date, number decimal(18,2)")
    spine = [D(2020, 12, 31), D(2021, 1, 31), D(2021, 2, 28), D(2021, 3, 31), D(2021, 6, 30)]
    got = {(r.currency, r.date): r.units for r in asof_balances(p, spine).collect()}
    for c in ("USD", "EUR"):
        for d in spine:
            exp = sum((n for _, cc, dd, n in rows if cc == c and dd <= d), Decimal(0))
            assert got[(c, d)] == exp


def test_convert_fallbacks(spark):
    prices = spark.createDataFrame(
        [(D(2020, 1, 1), "AAA", Decimal("2"), "USD"), (D(2020, 1, 10), "AAA", Decimal("3"), "USD"),
         (D(2020, 1, 1), "EUR", Decimal("1.25"), "USD"), (D(2020, 1, 1), "BBB", Decimal("4"), "EUR"),
         (D(2020, 1, 1), "USD", Decimal("0.5"), "CCC")],
        "date date, currency string, amount decimal(18,4), quote string")
    rows = spark.createDataFrame(
        [(1, "AAA", None, D(2020, 1, 5), Decimal("10")), (2, "AAA", None, D(2020, 1, 15), Decimal("10")),
         (3, "USD", None, D(2020, 1, 5), Decimal("7")), (4, "CCC", None, D(2020, 1, 5), Decimal("5")),
         (5, "BBB", "EUR", D(2020, 1, 5), Decimal("2")), (6, "ZZZ", None, D(2020, 1, 5), Decimal("9")),
         (7, "AAA", None, D(2019, 12, 1), Decimal("1"))],
        "id int, currency string, cost_currency string, date date, number decimal(18,2)")
    got = {r.id: (r.conv_number, r.conv_currency) for r in px.convert(rows, prices, "USD").collect()}
    assert got[1] == (Decimal("20"), "USD")            # direct, as of Jan 5
    assert got[2] == (Decimal("30"), "USD")            # after the last price
    assert got[3] == (Decimal("7"), "USD")             # target itself
    assert got[4] == (Decimal("10"), "USD")            # inverse of USD->CCC 0.5
    assert got[5] == (Decimal("10"), "USD")            # via cost currency: 2 x 4 x 1.25
    assert got[6] == (Decimal("9"), "ZZZ")             # no path: unchanged
    assert got[7] == (Decimal("1"), "AAA")             # before any price: unchanged
    latest = {r.id: r.conv_number for r in px.convert(rows, prices, "USD", date=None).collect()}
    assert latest[1] == Decimal("30")


def test_pmt_pv_match_closed_form(spark):
    def np_pmt(r, n, p, f=0.0, w=0):
        q = (1 + r) ** n
        fact = n if r == 0 else (1 + r * w) * (q - 1) / r
        return -(f + p * q) / fact

    def np_pv(r, n, a, f=0.0, w=0):
        q = (1 + r) ** n
        fact = n if r == 0 else (1 + r * w) * (q - 1) / r
        return -(f + a * fact) / q

    row = spark.range(1).select(
        mf.pmt(0.031, 72.335, 1_000_000.0, 0.0, "begin").alias("a"),
        mf.pmt(0.05, 30, 250_000.0).alias("b"), mf.pmt(0.0, 10, 1000.0).alias("c"),
        mf.pv(0.031, 72.335, -225_000.0).alias("d")).first()
    assert math.isclose(row.a, np_pmt(0.031, 72.335, 1_000_000.0, 0.0, 1), rel_tol=1e-12)
    assert math.isclose(row.b, np_pmt(0.05, 30, 250_000.0), rel_tol=1e-12)
    assert math.isclose(row.c, -100.0)
    assert math.isclose(row.d, np_pv(0.031, 72.335, -225_000.0), rel_tol=1e-12)


def test_format_and_classify(spark):
    df = spark.createDataFrame([(1234.5, "Assets:US:Banks:Checking"), (-0.4, "Liabilities:US:CreditCards:Visa"),
                                (2.5, "Assets:House"), (0.0, "Equity:Opening")], "x double, account string")
    out = df.select(mf.format_amount("x", True).alias("s"), mf.format_amount("x").alias("p"),
                    acc.classify_account("account").alias("c")).collect()
    assert [r.s for r in out] == ["+1,234", "+0", "+2", "+0"]
    assert [r.c for r in out] == ["Cash and Bank Accounts", "Liabilities/Credit Cards", "Other Assets", "Other"]


def test_missing_prices_brute_force(spark):
    rows = [(D(2020, 1, 1), "A"), (D(2020, 1, 4), "A"), (D(2020, 1, 2), "B"), (D(2020, 1, 6), "A")]
    p = spark.createDataFrame([(d, c, Decimal(1), "USD") for d, c in rows],
                              "date date, currency string, amount decimal(18,4), quote string")
    got = sorted((r.date, r.currency) for r in gaps.missing_prices(p).collect())
    days = [D(2020, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    exp = sorted((d, c) for c in "AB" for d in days if (d, c) not in rows)
    assert got == exp


def test_inventory_diff_of_itself_is_empty(spark):
    p = spark.createDataFrame([(1, "Assets:A", "USD", Decimal(5)), (1, "Assets:B", "EUR", Decimal(-2))],
                              "ledger_id int, account string, currency string, number decimal(18,2)")
    i = inv.inventory_sum(p)
    assert inv.clean_empty(inv.inventory_diff(i, i)).count() == 0
    assert inv.is_empty(inv.inventory_diff(i, i)).first().is_empty


def test_clean_small_per_currency(spark):
    p = spark.createDataFrame([(1, "A", "USD", Decimal("0.004")), (1, "B", "USD", Decimal("5")),
                               (1, "C", "JPY", Decimal("0.4"))],
                              "ledger_id int, account string, currency string, number decimal(18,3)")
    kept = {r.account for r in inv.clean_small(p, {"USD": 0.005}).collect()}
    assert kept == {"B", "C"}  # JPY has no tolerance -> 0


def test_balance_cursor_is_forward_only(spark):
    p = spark.createDataFrame([(1, "Assets:A:X", "USD", D(2020, 1, 2), Decimal(5)),
                               (1, "Assets:A:Y", "USD", D(2020, 1, 5), Decimal(7))],
                              "ledger_id int, account string, currency string, date date, number decimal(18,2)")
    cur = inv.BalanceCursor(p, "Assets", root_n=2)
    assert [r.number for r in cur.sum_till_date(D(2020, 1, 3)).collect()] == [Decimal(5)]
    assert [r.number for r in cur.sum_till_date(D(2020, 1, 5)).collect()] == [Decimal(12)]
    with pytest.raises(ValueError):
        cur.sum_till_date(D(2020, 1, 4))


def test_life_table_load_extend_improve(spark):
    from tallyframe.operators import actuarial as act

    raw = spark.createDataFrame([("m", i, i - 2 if i >= 2 else None, 0.1 + i / 100) for i in range(0, 8)],
                                "table_id string, row_idx int, age int, qx double")
    t = act.load_life_table(raw, skip_rows=2)               # header rows dropped
    assert [r.age for r in t.orderBy("row_idx").collect()] == [0, 1, 2, 3, 4, 5]
    ext = act.extend_life_table(t, max_age=9)
    ages = [r.age for r in ext.orderBy("row_idx").collect()]
    assert ages == list(range(0, 10))
    compat = [r.age for r in act.extend_life_table(t, max_age=9, compat=True).orderBy("row_idx").collect()]
    assert compat == [0, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]      # last age twice, as the reference
    g = spark.createDataFrame([(a, 0.5) for a in range(0, 10)], "age int, qx double").withColumn("table_id", F.lit("g"))
    imp = {r.age: r.qx for r in act.improve(ext, g, 1).collect()}
    assert math.isclose(imp[3], (0.1 + 5 / 100) * 0.5)
    same = {r.age: r.qx for r in act.improve(ext, g, 1, compat=True).collect()}
    assert math.isclose(same[3], 0.1 + 5 / 100)
    lt = act.life_table(ext).orderBy("row_idx").collect()
    assert lt[0].lx == 100000.0 and all(a.lx >= b.lx for a, b in zip(lt, lt[1:]))
    sp = act.survival_probs(ext, 3).orderBy("t").collect()
    assert sp[0].surv_prob == 1.0 and math.isclose(sp[1].surv_prob, 1 - (0.1 + 5 / 100))


def test_rate_schedule_and_pct_change(spark):
    from tallyframe.plans import finance as fin
    from tallyframe.plans import networth as nw

    df = spark.createDataFrame([(1, D(2020, 2, 22), Decimal(0)), (1, D(2020, 2, 23), Decimal(10)),
                                (1, D(2020, 2, 24), Decimal(15))], "ledger_id int, date date, v decimal(18,2)")
    rows = nw.pct_change(df, "v").select("date", fin.rate_schedule("date").alias("r"), "percent_change") \
        .orderBy("date").collect()
    assert [r.r for r in rows] == [0.032, 0.031, 0.031]
    assert rows[0].percent_change is None and rows[1].percent_change is None   # previous is 0 -> NULL
    assert math.isclose(rows[2].percent_change, 0.5)


def test_round_thousand_and_days(spark):
    r = spark.range(1).select(mf.round_thousand(F.lit(2500.0)).alias("a"), mf.round_thousand(F.lit(3500.0)).alias("b"),
                              mf.floor_thousand(F.lit(1999.9)).alias("c"),
                              mf.days_in_year(F.lit(D(2024, 5, 1))).alias("d"),
                              mf.days_in_year(F.lit(D(2023, 5, 1))).alias("e")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (2000, 4000, 1000, 366, 365)   # halves to even, like Python


def test_delta_trend_left_fill(spark):
    from tallyframe.plans import finance as fin

    curves = spark.createDataFrame(
        [(1, D(2020, 1, d), Decimal(100 * d), Decimal(50 * d), Decimal(60 * d)) for d in (1, 2, 3)],
        "ledger_id int, date date, target decimal(18,2), target_portfolio_tilt decimal(18,2), "
        "target_spending_tilt decimal(18,2)")
    inc = spark.createDataFrame([(1, D(2020, 1, 2), Decimal(10))], "ledger_id int, date date, income decimal(18,2)")
    sp = spark.createDataFrame([(1, D(2020, 1, 1), Decimal(5)), (1, D(2020, 1, 2), Decimal(7))],
                               "ledger_id int, date date, spending decimal(18,2)")
    inner = fin.delta_trend(curves, inc, sp).collect()
    assert [(r.date, r.tilt_trend) for r in inner] == [(D(2020, 1, 2), Decimal(93))]
    filled = {r.date: (r.tilt_trend, r.tilt_income_trend) for r in
              fin.delta_trend(curves, inc, sp, how="left", fill=True).collect()}
    assert filled[D(2020, 1, 1)] == (Decimal(45), Decimal(45))     # no income yet: 0
    assert filled[D(2020, 1, 3)] == (Decimal(143), Decimal(153))   # 150 - 7 (+ 10) carried forward


def test_sort_helpers(spark):
    from tallyframe.operators import holdings as hold

    p = spark.createDataFrame(
        [(1, "Liabilities:Card", "USD", None, None, None, Decimal(-5)),
         (1, "Assets:Broker", "GLD", Decimal(10), "USD", D(2020, 2, 1), Decimal(1)),
         (1, "Assets:Broker", "GLD", Decimal(9), "USD", D(2020, 1, 1), Decimal(2)),
         (1, "Assets:Bank", "USD", None, None, None, Decimal(7))],
        "ledger_id int, account string, currency string, cost_number decimal(18,2), cost_currency string, "
        "cost_date date, number decimal(18,2)")
    prices = spark.createDataFrame([(D(2020, 3, 1), "GLD", Decimal(12), "USD")],
                                   "date date, currency string, amount decimal(18,4), quote string")
    order = [(r.account, r.acquisition_date) for r in hold.holdings_ordered(hold.holdings(p, prices)).collect()]
    assert order == [("Assets:Bank", None), ("Assets:Broker", D(2020, 1, 1)), ("Assets:Broker", D(2020, 2, 1)),
                     ("Liabilities:Card", None)]
    accts = [r.account for r in inv.accounts_sorted(inv.inventory_sum(p)).collect()]
    assert accts == sorted(accts)


def test_dataframe_spine_equals_list_spine(spark):
    from tallyframe.plans import networth as nw

    rows = [(1, "Assets:Bank", "USD", D(2021, 1, 1) + dt.timedelta(days=i), Decimal(i)) for i in range(40)]
    p = spark.createDataFrame(rows, "ledger_id int, account string, currency string, date date, number decimal(18,2)")
    prices = spark.createDataFrame([], "date date, currency string, amount decimal(18,4), quote string")
    days = [D(2021, 1, 10), D(2021, 1, 31), D(2021, 2, 9)]
    as_list = {r.date: r.net_worth for r in nw.networth_series(p, prices, days).collect()}
    spine_df = spark.createDataFrame([(d,) for d in days], "date date")
    as_df = {r.date: r.net_worth for r in nw.networth_series(p, prices, spine_df).collect()}
    assert as_list == as_df == {d: Decimal(sum(range((d - D(2021, 1, 1)).days + 1))) for d in days}


def test_convert_keeps_sub_cent_precision(spark):
    from pyspark.sql import types as T

    prices = spark.createDataFrame([(D(2020, 1, 1), "AAA", Decimal("1.2345"), "USD")],
                                   "date date, currency string, amount decimal(18,4), quote string")
    # wide sum types like a running total's DECIMAL(38,2) must not push the
    # converted amount down to cents
    rows = spark.createDataFrame([(1, "AAA", D(2020, 1, 2), Decimal("10.01")), (2, "USD", D(2020, 1, 2), Decimal("3.5"))],
                                 "id int, currency string, date date, number decimal(38,2)")
    out = px.convert(rows, prices, "USD")
    assert out.schema["conv_number"].dataType == T.DecimalType(38, 6)
    got = {r.id: r.conv_number for r in out.collect()}
    assert got == {1: Decimal("12.357345"), 2: Decimal("3.5")}


def test_prices_belong_to_their_ledger(spark):
    """Two ledgers price X differently; a shared list is an explicit choice."""
    from tallyframe.operators.prices import shared_prices
    from tallyframe.plans.networth import networth_converted, networth_series

    posts = spark.createDataFrame([("a", "Assets:B", "X", "1"), ("b", "Assets:B", "X", "1"), ("a", "Assets:B", "USD", "-1"),
                                   ("b", "Assets:B", "USD", "-1")], "ledger_id string, account string, currency string, number string")
    posts = posts.selectExpr("*", "date'2020-01-01' AS date").withColumn("number", F.col("number").cast("decimal(24,8)"))
    px = spark.createDataFrame([("a", "X", "10"), ("b", "X", "99")], "ledger_id string, currency string, amount string").selectExpr(
        "ledger_id", "date'2019-01-01' AS date", "currency", "cast(amount AS decimal(24,8)) AS amount", "'USD' AS quote", "1 AS line_no")
    day = [dt.date(2020, 6, 1)]
    for f in (networth_series, networth_converted):
        assert {r[0]: float(r[2]) for r in f(posts, px, day).collect()} == {"a": 9, "b": 98}
    one = shared_prices(px.where("ledger_id = 'b'"))
    assert {r[0]: float(r[2]) for r in networth_series(posts, one, day).collect()} == {"a": 98, "b": 98}


def test_hop_of_small_and_large_rates(spark):
    from tallyframe.operators.prices import convert

    px = spark.createDataFrame([("FUND", "0.0123", "IDR"), ("IDR", "0.00006", "USD"), ("BIG", "20000000", "IDR")],
                               "currency string, amount string, quote string").selectExpr(
        "date'2020-01-01' AS date", "currency", "cast(amount AS decimal(24,8)) AS amount", "quote")
    pos = spark.createDataFrame([("FUND", "1000000000"), ("BIG", "3")], "currency string, number string").selectExpr(
        "currency", "cast(number AS decimal(24,8)) AS number", "'IDR' AS cost_currency")
    got = {r["currency"]: float(r["conv_number"]) for r in convert(pos, px, "USD", date=None).collect()}
    assert got == {"FUND": 738.0, "BIG": 3600.0}


def test_no_posting_is_shuffled_by_currency(spark):
    """Without static broadcasts (as with large tables) every exchange below a
    rate join is of aggregated rows."""
    from conftest import SF_SMALL
    from tallyframe.plans.registry import QUERIES

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("total_spend", "income_by_day", "spending_by_day", "projected_spend", "expense_by_year_account",
                     "expense_tree", "expense_postings", "holdings"):
            plan = QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString().split("\n")
            for at, line in enumerate(plan):
                if "Exchange hashpartitioning(currency" in line or "Exchange hashpartitioning(date" in line:
                    below = next(x for x in plan[at + 1:] if not re.search(r"Project|Filter|InputAdapter|WholeStage", x))
                    assert re.search("Aggregate|Generate|Window", below) or "FileScan" not in below, (name, line, below)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
