"""Structured Streaming: incremental balances resume from the checkpoint, equal
the batch sums and are compacted; the period report releases closed days; a
growing folder of ledgers is read file by file."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import inventory as inv
from tallyframe.sources.ledger_text import load_ledger
from tallyframe.streaming.balances import (DAY_KEY, balances_stream, latest_state, period_expenses_stream, period_report,
                                           run_to_table)
from tallyframe.streaming.ledger_files import TABLES, LedgerStore
from tallyframe.streaming.state_table import StateTable

SCHEMA = "ledger_id int, account string, currency string, date date, number decimal(18,2)"
BALANCE_KEY = ["ledger_id", "account", "currency"]


def _write(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _dirs(name):
    base = tempfile.mkdtemp(prefix=f"tf-{name}-")
    return [os.path.join(base, x) for x in ("src", "out", "ckpt")]


def test_incremental_balances_resume(spark):
    src, out, ckpt = _dirs("stream")
    first = [(1, "Assets:Bank:A", "USD", dt.date(2020, 1, d), Decimal(d)) for d in range(1, 11)]
    second = [(1, "Assets:Bank:B", "USD", dt.date(2020, 2, d), Decimal(-d)) for d in range(1, 6)] + \
             [(2, "Assets:Cash", "EUR", dt.date(2020, 1, 3), Decimal("7.5"))]
    _write(spark, first, src)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        run_to_table(balances_stream(stream, root_n=2, lots=False), out, ckpt)

    run()
    _write(spark, second, src)         # new entries arrive later
    run()                              # same checkpoint: only the new file is processed
    batches = spark.read.parquet(out).select("batch_id").distinct().count()
    assert batches == 2
    got = {(r.ledger_id, r.account, r.currency): r.number for r in latest_state(spark, out, BALANCE_KEY).collect()}
    all_rows = spark.createDataFrame(first + second, SCHEMA)
    exp = {(r.ledger_id, r.account, r.currency): r.number
           for r in inv.inventory_sum(all_rows, root_n=2, lots=False).collect()}
    assert got == exp == {(1, "Assets:Bank", "USD"): Decimal(40), (2, "Assets:Cash", "EUR"): Decimal("7.5")}


def test_balances_are_compacted(spark):
    """After 20 batches a reader takes one snapshot and the batches after it."""
    src, out, ckpt = _dirs("compact")
    rows = [(k % 3, f"Assets:Bank:{k % 4}", "USD", dt.date(2020, 1, 1), Decimal(k)) for k in range(1, 101)]
    for b in range(20):
        _write(spark, rows[b * 5:b * 5 + 5], src)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
        return run_to_table(balances_stream(stream, lots=False), out, ckpt, BALANCE_KEY, every=6)

    assert len(run()) >= 20
    table = StateTable(spark, out, BALANCE_KEY, every=6)
    assert table.snapshots() == [11, 17] and min(table.batches()) == 12
    got = table.current()
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in inv.inventory_sum(
        spark.createDataFrame(rows, SCHEMA), lots=False, keep_zero=True).select(*got.columns).collect()}
    read = got.inputFiles()
    assert read and all("upto=17" in f or "batch_id=18" in f or "batch_id=19" in f for f in read)
    # a batch that runs again after its snapshot gives the same state
    last = spark.read.parquet(f"{out}/batch_id=17")
    again = spark.createDataFrame(last.collect(), last.schema)
    table.append(again, 17)
    assert table.snapshots() == [11, 17] and {tuple(r) for r in table.current().collect()} == {tuple(r) for r in got.collect()}
    with pytest.raises(ValueError):
        StateTable(spark, f"{out}-none", BALANCE_KEY).current()


EVENTS = "ts timestamp, user_id long, event_type string, value decimal(18,6)"


def _period_run(spark, src, out, ckpt, watermark="31 days"):
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    agg = period_expenses_stream(stream, ts="ts", ledger="user_id", account="event_type", value="value", watermark=watermark)
    return run_to_table(agg, out, ckpt, DAY_KEY, every=3)


def _events(spark, rows, src):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(src)


def test_period_expenses_sums(spark):
    src, out, ckpt = _dirs("period")
    _events(spark, [(dt.datetime(2020, m, d, 23), 1, "Expenses:Food", Decimal(m)) for m in (1, 2, 3) for d in (5, 5, 28)]
            + [(None, 1, "Expenses:Food", Decimal(9))], src)
    _period_run(spark, src, out, ckpt)
    days = latest_state(spark, out, DAY_KEY)
    assert days.count() == 6
    got = {r.period: r.amount for r in period_report(days).collect()}
    assert got == {dt.date(2020, m, 1): Decimal(3 * m) for m in (1, 2, 3)}
    assert {r.period: r.amount for r in period_report(days, "quarter").collect()} == {dt.date(2020, 1, 1): Decimal(18)}


def test_closed_days_are_released(spark):
    """Batches a year apart: the state of closed days goes, their amounts stay
    in the table; a row within the delay counts, one beyond it is dropped."""
    src, out, ckpt = _dirs("evict")
    at = lambda y, m, d: dt.datetime(y, m, d, 12)
    batches = [[(at(2018, 1, d), u, "Expenses:Food", Decimal(1)) for d in range(1, 11) for u in (1, 2)],
               [(at(2019, 1, 20), 1, "Expenses:Food", Decimal(2)), (at(2019, 1, 1), 1, "Expenses:Food", Decimal(3))],
               [(at(2019, 1, 2), 1, "Expenses:Food", Decimal(4)),      # 18 days behind: counts
                (at(2018, 1, 5), 1, "Expenses:Food", Decimal(100))],   # a year behind: dropped
               [(at(2020, 1, 1), 1, "Expenses:Food", Decimal(5))]]
    state, dropped = [], 0
    for rows in batches:
        _events(spark, rows, src)
        for p in _period_run(spark, src, out, ckpt):
            for op in p["stateOperators"]:
                state.append(op["numRowsTotal"])
                dropped += op["numRowsDroppedByWatermark"]
    assert max(state) >= 20 and state[-1] <= 3, state
    assert dropped == 1
    got = {r.period: r.amount for r in period_report(latest_state(spark, out, DAY_KEY).where("ledger_id = 1")).collect()}
    assert got == {dt.date(2018, 1, 1): Decimal(10), dt.date(2019, 1, 1): Decimal(9), dt.date(2020, 1, 1): Decimal(5)}


# ------------------------------------------------------------- growing ledger

LEDGER = """option "operating_currency" "USD"
2020-01-01 open Assets:Bank USD
  include_in_dash: "true"
2020-01-01 open Expenses:Food
2020-01-01 commodity USD
2020-01-{d:02} * "shop {n}" "food" #tag
  Expenses:Food  {n}.50 USD
  Assets:Bank
2020-02-01 price EUR 1.1{n} USD
2020-02-01 balance Assets:Bank  -{n}.50 USD
not a directive {n}
2020-02-02 event "place" "home"
2020-02-02 custom "budget" Expenses:Food "monthly" {n} USD
"""


def _ledger(folder, n):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, f"l {n}.ledger"), "w") as f:
        f.write(LEDGER.format(n=n, d=n % 27 + 1))


def _same(a, b):
    for name in TABLES:
        assert getattr(a, name).columns == getattr(b, name).columns, name
        rows = lambda t: sorted(map(repr, getattr(t, name).select(*getattr(b, name).columns).collect()))
        assert rows(a) == rows(b), name


def test_growing_ledger(spark):
    src, store_path, _ = _dirs("grow")
    for n in range(5):
        _ledger(src, n)
    store = LedgerStore(spark, store_path)
    assert store.tables().postings.count() == 0
    # rows that the source gave; a batch's lines are read twice (numbers, headers)
    rows = lambda progress: sum(p["numInputRows"] for p in progress)
    lines = 2 * LEDGER.count("\n")
    assert rows(store.ingest(src, files_per_batch=2)) == 5 * lines
    _same(store.tables(), load_ledger(spark, src))
    _ledger(src, 5)
    _ledger(os.path.join(src, "sub"), 6)
    # another process, same checkpoint: only the new files are read
    store = LedgerStore(spark, store_path)
    assert rows(store.ingest(src, files_per_batch=2)) == 2 * lines
    assert rows(store.ingest(src)) == 0 and store.refresh(src) == 0
    both = [src, os.path.join(src, "sub")]
    _same(store.tables(), load_ledger(spark, both))


def test_changed_and_removed_files(spark):
    src, store_path, _ = _dirs("change")
    for n in range(3):
        _ledger(src, n)
    store = LedgerStore(spark, store_path)
    store.ingest(src)
    with open(os.path.join(src, "l 1.ledger"), "a") as f:       # a ledger that grows at its end
        f.write('2020-03-01 * "later"\n  Expenses:Food  7 USD\n  Assets:Bank\n')
    os.rename(os.path.join(src, "l 2.ledger"), os.path.join(src, "l 9.ledger"))
    assert store.refresh(src) == 2                              # one changed, one gone
    store.ingest(src)                                           # the new name is a new file
    _same(store.tables(), load_ledger(spark, src))
    assert store.tables().postings.where("payee IS NULL AND narration = 'later'").count() == 2
    os.rename(os.path.join(src, "l 9.ledger"), os.path.join(src, "l 2.ledger"))
    assert store.refresh(src) == 2                              # it is back under its old name
    _same(store.tables(), load_ledger(spark, src))


def test_compacted_store(spark):
    """Many small parts become one; ingest and refresh go on from there."""
    src, store_path, _ = _dirs("compact-store")
    for n in range(4):
        _ledger(src, n)
    store = LedgerStore(spark, store_path)
    store.compact()                                             # nothing yet
    store.ingest(src, files_per_batch=1)
    with open(os.path.join(src, "l 1.ledger"), "a") as f:
        f.write('2020-03-01 * "later"\n  Expenses:Food  7 USD\n  Assets:Bank\n')
    assert store.refresh(src) == 1
    store.compact()
    parts = lambda: sorted(x for x in os.listdir(os.path.join(store_path, "postings")) if "part=" in x)
    assert len(parts()) == 1
    _same(store.tables(), load_ledger(spark, src))
    _ledger(src, 7)
    os.remove(os.path.join(src, "l 0.ledger"))
    with open(os.path.join(src, "l 2.ledger"), "a") as f:
        f.write("2020-03-01 price EUR 9 USD\n")
    store.ingest(src)
    assert store.refresh(src) == 2 and len(parts()) == 3
    _same(store.tables(), load_ledger(spark, src))
    store.compact()
    assert len(parts()) == 1
    _same(store.tables(), load_ledger(spark, src))
    assert store.refresh(src) == 0


def test_interrupted_batch_leaves_nothing_behind(spark, monkeypatch):
    """A batch that fails after some of its tables is not seen, and runs again."""
    src, store_path, _ = _dirs("fail")
    for n in range(2):
        _ledger(src, n)
    store = LedgerStore(spark, store_path)
    monkeypatch.setattr("tallyframe.streaming.ledger_files.TABLES", [*TABLES[:2], "no such table"])
    with pytest.raises(Exception, match="no such table"):
        store.ingest(src)
    monkeypatch.undo()
    assert store.files().count() == 0 and LedgerStore(spark, store_path).tables().postings.count() == 0
    store.ingest(src)
    _same(store.tables(), load_ledger(spark, src))
    assert store.tables().postings.select(F.count_distinct("file", "line_no")).first()[0] == store.tables().postings.count()


def test_a_part_does_not_keep_its_ledgers_name_twice(spark, tmp_path):
    from tallyframe.sources.ledger_text import text_scan
    from tallyframe.streaming import ledger_files

    source, store = tmp_path / "l.ledger", ledger_files.LedgerStore(spark, str(tmp_path / "store"))
    source.write_text('2020-01-02 * "P" "N"\n  Assets:Cash  1 USD\n  Income:Pay  -1 USD\n')
    size = source.stat().st_size
    store._write(text_scan(spark.read.text(str(source)), *ledger_files._stats()), "stream-000000000", 0)
    assert [(r.size, r.part) for r in store.files().collect()] == [(size, "stream-000000000")]
    tables = store.tables()
    assert {"ledger_id", "part"} & set(spark.read.parquet(f"{store.path}/postings").columns) == {"part"}  # the ledger is the file's name
    assert [r.ledger_id == r.file for r in tables.postings.collect()] == [True, True]
    assert not {"_size", "_modified"} & {c for t in vars(tables).values() for c in t.columns}
