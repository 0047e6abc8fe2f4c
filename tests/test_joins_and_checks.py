"""Bucketed as-of joins, global ranks, step tables, complete pivots, inferred
tolerances and classifiers given as functions, against brute force."""

import datetime as dt
import random
import re
import shutil
import tempfile
from collections import Counter
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyframe.functions.accounts import classify_account
from tallyframe.operators import checks, holdings as hold, inventory as inv
from tallyframe.operators.asof import asof_join, asof_lookup
from tallyframe.operators.prices import convert
from tallyframe.operators.ranking import global_rank
from tallyframe.plans import finance as fin, networth as nw
from tallyframe.sources.ledger_text import load_ledger_text

D0 = dt.date(2020, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def rows(df):
    return Counter(map(repr, df.collect()))


# ------------------------------------------------------------------ as-of join


def series_and_points(seed=1, hot=600):
    rng = random.Random(seed)
    series = {(k, day(rng.randrange(-400, 400))): rng.randrange(1000) for k in ("hot", "a", "b") for _ in range(60)}
    s = [(k, d, v, f"x{v}") for (k, d), v in series.items()] + [("hot", None, 1, "null time"), (None, day(3), 5, "null key")]
    p = [("hot", day(rng.randrange(-450, 450)), i) for i in range(hot)] + [(k, day(rng.randrange(-450, 450)), 10_000 + i) for i, k in
         enumerate(["a", "b", "c"] * 20)] + [(None, day(5), 1), ("hot", None, 2), ("a", day(0), 3), ("a", day(0), 3)]
    return s, p


def by_hand(s, p, inclusive):
    out = Counter()
    for k, d, i in p:
        before = [(x, v, n) for key, x, v, n in s if key == k and k is not None and x is not None and d is not None and (x <= d if inclusive else x < d)]
        best = max(before) if before else (None, None, None)
        out[k, d, i, best[1], best[2]] += 1
    return out


@pytest.mark.parametrize("days, spread, inclusive", [(32, 8, True), (1, 3, True), (7, 1, False), (5000, 2, False)])
def test_asof_join_against_brute_force(spark, days, spread, inclusive):
    s, p = series_and_points()
    series = spark.createDataFrame(s, "k string, date date, v long, n string")
    points = spark.createDataFrame(p, "k string, date date, i long").repartition(3)
    got = asof_join(points, series, ["k"], ["v", "n"], inclusive=inclusive, days=days, spread=spread)
    assert Counter(tuple(r) for r in got.select("k", "date", "i", "v", "n").collect()) == by_hand(s, p, inclusive)


def test_asof_join_of_times_and_of_little(spark):
    at = lambda s: dt.datetime(2020, 1, 1) + dt.timedelta(seconds=s)
    rng = random.Random(2)
    s = [("k", at(x), x) for x in rng.sample(range(-10_000, 10_000), 80)]
    p = [("k", at(rng.randrange(-11_000, 11_000)), i) for i in range(200)]
    series, points = spark.createDataFrame(s, "k string, ts timestamp, v long"), spark.createDataFrame(p, "k string, ts timestamp, i long")
    got = asof_join(points, series, ["k"], ["v"], "ts", days=1 / 48)
    want = asof_lookup(points, series, ["k"], ["v"], "ts")
    assert rows(got.select("k", "ts", "i", "v")) == rows(want.select("k", "ts", "i", "v"))
    empty = series.limit(0)
    assert asof_join(points, empty, ["k"], ["v"], "ts").where("v IS NULL").count() == 200
    assert asof_join(points.limit(0), series, ["k"], ["v"], "ts").count() == 0


def test_asof_join_never_windows_rows(spark):
    s, p = series_and_points()
    got = asof_join(spark.createDataFrame(p, "k string, date date, i long"), spark.createDataFrame(s, "k string, date date, v long, n string"),
                    ["k"], ["v"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    window = plan[plan.index("Window ["):]
    assert re.search(r"last\(", plan) and "i#" not in window.split("Join")[0]  # rows' own columns stay out of the window
    # one key's busiest bucket is dealt over the copies
    one = spark.range(4000).select(F.lit("hot").alias("k"), F.lit(D0).alias("date"), "id").repartition(8)
    dealt = one.withColumn("s", F.pmod(F.monotonically_increasing_id(), F.lit(8))).groupBy("s").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 700


def test_row_level_conversion_equals_the_calendar(spark):
    rng = random.Random(4)
    prices = spark.createDataFrame([(day(rng.randrange(0, 300)), c, Decimal(rng.randrange(1, 900)) / 100, q) for c, q in
                                    (("EUR", "USD"), ("GLD", "EUR"), ("USD", "CHF")) for _ in range(40)],
                                   "date date, currency string, amount decimal(18,4), quote string")
    held = [(i, day(rng.randrange(-20, 340)), Decimal(rng.randrange(-900, 900)) / 4, rng.choice(["USD", "EUR", "GLD", "CHF", "ODD"]),
             rng.choice([None, "EUR", "USD"])) for i in range(400)]
    df = spark.createDataFrame(held, "ledger_id int, date date, number decimal(18,2), currency string, cost_currency string")
    for target in ("USD", "CHF"):
        a, b = convert(df, prices, target, row_level=True), convert(df, prices, target)
        assert a.columns == b.columns and rows(a) == rows(b)


# ----------------------------------------------------------------- global rank


def test_global_rank(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, *range(300)]), i) for i in range(900)]
    df = spark.createDataFrame(data, "k string, x long, i long").repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0, r[2])
    want = {r: n + 1 for n, r in enumerate(sorted(data, key=key))}
    got = {tuple(r)[:3]: r["rank"] for r in global_rank(df, ["x", "i"]).collect()}
    assert got == want
    per = global_rank(df, [F.col("x").desc_nulls_last(), F.col("i").desc()], "n", by=["k"]).collect()
    for k in ("hot", "b", None):
        mine = sorted((r for r in data if r[0] == k), key=key, reverse=True)
        assert {tuple(r)[:3]: r["n"] for r in per if r["k"] == k} == {r: n + 1 for n, r in enumerate(mine)}
    assert global_rank(df.limit(0), ["x"]).collect() == []
    plan = global_rank(df, ["x", "i"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


# ------------------------------------------------------------------ step tables


def test_rate_steps(spark):
    steps = [("a", day(0), Decimal("0.030")), ("a", day(40), Decimal("0.031")), ("a", day(400), Decimal("0.020")), ("a", day(400), Decimal("0.025")),
             ("b", day(10), Decimal("0.5")), ("a", None, Decimal("9"))]
    points = [(k, day(n)) for k in ("a", "b", "c") for n in (-1, 0, 9, 10, 39, 40, 399, 400, 5000)]
    st = spark.createDataFrame(steps, "k string, effective date, rate decimal(8,4)")
    pt = spark.createDataFrame(points, "k string, date date")

    def hand(k, d, own):
        before = [(e, r) for key, e, r in steps if e is not None and e <= d and (key == k or not own)]
        return max(before)[1] if before else None

    assert {(r.k, r.date): r.rate for r in fin.rate_steps(pt, st, ["k"]).collect()} == {(k, d): hand(k, d, True) for k, d in points}
    assert {(r.k, r.date): r.rate for r in fin.rate_steps(pt, st.drop("k")).collect()} == {(k, d): hand(k, d, False) for k, d in points}
    # the calendar-year rule is a step table of one year
    year = spark.createDataFrame([(dt.date(2020, 1, 1), 0.032), (dt.date(2020, 2, 23), 0.031)], "effective date, rate double")
    dates = spark.createDataFrame([(day(n),) for n in range(366)], "date date")
    both = fin.rate_steps(dates, year).withColumn("rule", fin.rate_schedule("date"))
    assert both.where("rate <> rule OR rate IS NULL").count() == 0


# -------------------------------------------------------------- complete pivots


def test_pivot_loses_no_currency(spark):
    u = spark.createDataFrame([(1, "USD", 5), (1, "EUR", 6), (2, "USD", 7), (3, "XAU", 8), (3, "AAA", 9)], "ledger_id int, currency string, units long")
    ok = hold.units_pivot(u.where("ledger_id < 3"), ["USD", "EUR"])
    assert {tuple(r) for r in ok.collect()} == {(1, 5, 6), (2, 7, None)}
    for columns in (["USD", "EUR"], ["EUR"], ["USD", "EUR", "XAU"]):
        with pytest.raises(Exception, match="no column for currency"):
            hold.units_pivot(u, columns).select(columns[0]).collect()
    with pytest.raises(Exception, match="NULL"):
        hold.units_pivot(spark.createDataFrame([(1, None, 5)], u.schema), ["USD"]).collect()
    rest = {r["ledger_id"]: r for r in hold.units_pivot(u, ["USD"], others="rest").collect()}
    assert [tuple(x) for x in rest[3]["rest"]] == [("AAA", 9), ("XAU", 8)] and rest[3]["USD"] is None
    assert [tuple(x) for x in rest[1]["rest"]] == [("EUR", 6)] and rest[2]["rest"] == []


# ---------------------------------------------------------- inferred tolerances

TEXT = """
2020-01-01 * "yen exact"
  Expenses:A  100 JPY
  Assets:B  -100 JPY
2020-01-02 * "yen off by one"
  Expenses:A  100 JPY
  Assets:B  -99 JPY
2020-01-03 * "cents within half a cent"
  Expenses:A  10.00 USD
  Assets:B  -10.005 USD
2020-01-04 * "cents beyond it"
  Expenses:A  10.00 USD
  Assets:B  -10.0051 USD
2020-01-05 * "six digits beyond half a millionth"
  Expenses:A  1.000000 SHR
  Assets:B  -1.0000006 SHR
2020-01-06 * "six digits within"
  Expenses:A  1.000000 SHR
  Assets:B  -1.0000005 SHR
2020-01-07 * "the cash leg's cents allow for the lot's cost"
  Assets:B  3 SHR {1.3333 USD}
  Assets:C  -4.00 USD
2020-01-08 * "a whole amount allows nothing"
  Assets:B  3 SHR {1.3333 USD}
  Assets:C  -4 USD
2020-01-09 * "a price's digits do not count"
  Assets:B  3.00 EUR @ 1.3333 USD
  Assets:C  -4 USD
2020-01-10 * "an amount left out cancels"
  Assets:B  3.333 EUR @ 1.11 USD
  Assets:C
2020-01-11 balance Assets:D  0.01 USD
2020-01-11 balance Assets:E  1 USD
2020-01-11 balance Assets:F  0.02 USD
2020-01-11 balance Assets:G  1 ~ 1 USD
"""


def test_tolerances_follow_the_digits(spark):
    t = load_ledger_text(spark, {"t": TEXT})
    e = checks.ledger_errors(t.postings, t.balances)
    bad = {r["date"].day for r in e.where("kind = 'unbalanced'").collect()}
    assert bad == {2, 4, 5, 8, 9}
    failed = {r["account"] for r in e.where("kind = 'balance'").collect()}
    assert failed == {"Assets:E", "Assets:F"}    # a unit of the last digit, none for a whole number, or as stated
    fixed = checks.unbalanced_transactions(t.postings, "2")
    assert fixed.count() == 0
    digits = {(r["txn_id"], r["account"]): r["digits"] for r in t.postings.collect()}
    assert sorted(str(x) for x in set(digits.values())) == ["0", "2", "3", "4", "6", "7", "None"]


def test_tolerance_of_digits(spark):
    got = [r[0] for r in spark.range(20).select(checks.written_tolerance(F.col("id").cast("int"))).collect()]
    assert got[:3] == [0, Decimal("0.05"), Decimal("0.005")] and got[18] == got[19] == Decimal(5).scaleb(-19)


# ------------------------------------------------- classifiers, tolerance tables


def test_classifier_given_as_a_function(spark):
    rule = lambda a: F.when(a.startswith("Assets:Bank"), F.upper(F.element_at(F.split(a, ":"), -1)))
    df = spark.createDataFrame([("Assets:Bank:x",), ("Assets:Y",)], "account string")
    assert [r[0] for r in df.select(classify_account("account", rule)).collect()] == ["X", "Other"]
    p = spark.createDataFrame([(1, "Assets:Bank:x", D0, Decimal(5), "USD"), (1, "Assets:Y", D0, Decimal(6), "USD")],
                              "ledger_id int, account string, date date, number decimal(18,2), currency string")
    prices = spark.createDataFrame([], "date date, currency string, amount decimal(18,4), quote string")
    d = nw.networth_detail(p, prices, [day(1)], rules=rule)
    assert {r["account"]: r["category"] for r in d.collect()} == {"Assets:Bank:x": "X", "Assets:Y": "Other"}


def test_tolerance_table(spark):
    i = spark.createDataFrame([(1, "A", "USD", Decimal(5)), (1, "B", "USD", Decimal(4)), (2, "A", "EUR", Decimal(1)), (2, "C", "USD", Decimal(-9))],
                              "ledger_id int, account string, currency string, number decimal(18,2)")
    tol = spark.createDataFrame([("USD", 4.0), ("USD", 3.0)], "currency string, tolerance double")
    left = lambda t: {(r[0], r[1]) for r in inv.clean_small(i, t).select("ledger_id", "account").collect()}
    assert left(tol) == left({"USD": 4}) == {(1, "A"), (2, "A"), (2, "C")}
    own = spark.createDataFrame([(1, "USD", 5.0), (2, "USD", 9.0), (2, "EUR", 1.0)], "ledger_id int, currency string, tolerance double")
    assert left(own) == set()
    assert {r[0]: r[1] for r in inv.is_small(i, own).collect()} == {1: True, 2: True}


# --------------------------------------------------------------- replaced tables


def test_replaced_tables_are_ingested_again(spark):
    from tallyframe.plans.registry import LEDGER_TABLES, ledger

    d = tempfile.mkdtemp(prefix="tf-replaced-")
    for t in LEDGER_TABLES:
        shutil.copy(f"{SF_SMALL}/{t}.parquet", f"{d}/{t}.parquet")
    n = ledger(spark, d).postings.count()
    assert ledger(spark, d).store.path == ledger(spark, d).store.path
    pq.write_table(pq.read_table(f"{SF_SMALL}/lineitem.parquet").slice(0, 1000), f"{d}/lineitem.parquet")
    assert ledger(spark, d).postings.count() == 2000 < n
