"""Posting store: filters skip files, balances at any date read one year end and
the tail, and equal the sums over all postings."""

import datetime as dt
import os
import random
import re
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyframe.operators import inventory as inv
from tallyframe.plans.registry import balance_store, ledger
from tallyframe.sources.store import PostingStore, write_store

COLS = ("ledger_id int, txn_id long, line_no int, date date, account string, number decimal(18,2), currency string, "
        "cost_number decimal(18,2), cost_currency string, cost_date date")


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    return df._jdf.queryExecution().executedPlan().toString()


def filters(df):
    return re.findall(r"PartitionFilters: \[([^\]]*)\]", plan(df))


def rows(df):
    return sorted(map(repr, df.collect()))


def data(n=400, years=(2015, 2020), seed=3):
    rng, out = random.Random(seed), []
    for k in range(n):
        day = dt.date(rng.randrange(years[0], years[1] + 1), rng.randrange(1, 13), rng.randrange(1, 29))
        acc = rng.choice(["Assets:Bank:A", "Assets:Broker", "Liabilities:Card", "Expenses:Assets:Odd", "Expenses:Food", "Income:Pay"])
        lot = rng.random() < 0.3
        out.append((k % 2, k, 1, day, acc, Decimal(rng.randrange(-500, 500)) / 4, rng.choice(["USD", "EUR"]),
                    Decimal(2) if lot else None, "USD" if lot else None, day if lot else None))
    return [*out, (0, 9001, 1, None, "Assets:Bank:A", Decimal(5), "USD", None, None, None),
            (0, 9002, 1, dt.date(2016, 12, 31), None, Decimal(5), "USD", None, None, None),
            (1, 9003, 1, dt.date(2017, 1, 1), "", Decimal(5), "USD", None, None, None)]


@pytest.fixture()
def store(spark):
    return write_store(spark.createDataFrame(data(), COLS), tempfile.mkdtemp(prefix="tf-store-"))


def test_filters_become_partition_filters(spark, store):
    p = spark.createDataFrame(data(), COLS)
    assert store.types("Assets|Liabilities") == ["Assets", "Expenses", "Liabilities"]  # Expenses:Assets:Odd matches too
    assert store.types("^assets", ignore_case=True) == ["Assets"] and store.types("^assets") == []
    some = store.postings("^(Assets|Liabilities)", "2016-03-01", "2017-02-10")
    (f,) = filters(some)
    assert "account_type" in f and "year" in f and ">= 2016" in f and "<= 2017" in f
    want = p.where("account rlike '^(Assets|Liabilities)' and date between '2016-03-01' and '2017-02-10'")
    assert rows(some) == rows(want) and rows(store.postings()) == rows(p)
    assert rows(store.postings("no such account")) == []
    read = {"/".join(os.path.dirname(r[0]).split("/")[-2:]) for r in some.select(F.input_file_name()).distinct().collect()}
    assert read <= {f"account_type={t}/year={y}" for t in ("Assets", "Liabilities") for y in (2016, 2017)}


def test_a_table_of_accounts_prunes_at_run_time(spark, store):
    wanted = store.accounts().where("account = 'Expenses:Food'").select("ledger_id", "account")
    got = store.postings_of(wanted)
    assert "dynamicpruning" in plan(got)
    assert rows(got) == rows(spark.createDataFrame(data(), COLS).where("account = 'Expenses:Food'"))


def test_balances_at_any_date(spark, store):
    p = spark.createDataFrame(data(), COLS)
    days = ["2014-05-05", "2015-01-01", "2016-12-30", "2016-12-31", "2017-01-01", "2018-07-09", "2020-12-31", "2031-01-01"]

    def check(p):
        for k, d in enumerate(days):
            accounts, root = ((None, None), ("Assets|Liabilities", 2), ("^Income", 1))[k % 3]
            want = inv.inventory_sum(p, as_of=d, account_re=accounts, root_n=root, lots=k % 2 == 0)
            assert rows(store.inventory_at(d, accounts, root_n=root, lots=k % 2 == 0)) == rows(want), (d, accounts)

    check(p)                                    # without snapshots: postings alone
    assert store.write_snapshots() == list(range(2015, 2021)) == store.snapshot_years()
    check(p)
    f = filters(store.inventory_at("2018-07-09", "^Assets"))
    assert len(f) == 2 and any("= 2017" in x and ">=" not in x for x in f) and any(">= 2018" in x and "<= 2018" in x for x in f)
    assert all("account_type" in x for x in f)
    # a later year and a correction in an old one: only the years from there on are made again
    more = [(0, 9100, 1, dt.date(2022, 3, 3), "Assets:Bank:A", Decimal(11), "USD", None, None, None),
            (0, 9101, 1, dt.date(2018, 3, 3), "Assets:Bank:A", Decimal(-7), "EUR", None, None, None)]
    spark.createDataFrame(more, COLS).withColumn("account_type", F.lit("Assets")).withColumn("year", F.year("date")) \
        .write.mode("append").partitionBy("account_type", "year").parquet(f"{store.path}/postings")
    store = PostingStore(spark, store.path)
    assert store.write_snapshots(since=2018) == list(range(2015, 2023))
    days += ["2021-06-06", "2022-03-02", "2022-03-03"]
    check(spark.createDataFrame(data() + more, COLS))


def test_empty_store(spark):
    store = write_store(spark.createDataFrame([], COLS), tempfile.mkdtemp(prefix="tf-store-"))
    assert store.write_snapshots() == [] and store.inventory_at("2020-01-01", "Assets").count() == 0
    assert store.postings().columns == [c.split()[0] for c in COLS.split(", ")]


def test_hot_type_is_many_files(spark):
    p = spark.range(4000).select(F.lit(1).alias("ledger_id"), F.col("id").alias("txn_id"), F.lit(dt.date(2020, 1, 1)).alias("date"),
                                 F.lit("Assets:Hot").alias("account"), F.lit(1).cast("decimal(18,2)").alias("number"), F.lit("USD").alias("currency"))
    store = write_store(p, tempfile.mkdtemp(prefix="tf-store-"), files=64)
    sizes = [r["count"] for r in store.all().groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 2000


def test_registered_queries_prune(spark):
    L = ledger(spark, SF_SMALL)
    from tallyframe.plans.registry import QUERIES

    for name, types, years in [("networth_series", {"Assets", "Liabilities"}, False), ("expense_tree", {"Expenses"}, False),
                               ("total_spend", {"Expenses"}, True), ("holdings", {"Assets", "Liabilities"}, False)]:
        found = [f for f in filters(QUERIES[name](spark, SF_SMALL)) if "account_type" in f]
        assert found, name
        assert all(t in " ".join(found) for t in types) and ("year" in " ".join(found)) == years, (name, found)
    s = balance_store(spark, SF_SMALL)
    assert s.path == L.store.path and s.snapshot_years()
