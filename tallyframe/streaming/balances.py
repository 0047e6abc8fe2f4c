"""Streaming counterparts.

T1 ``incremental_balances``: running balances that remember the last sum and
only process new entries.  In Structured Streaming that is a stateful
``groupBy().agg(sum)`` in ``update`` mode: each micro-batch adds its postings
to the per-key state in the state store (checkpointed in the shared
checkpoint folder, so a lost executor or a restarted query resumes where it
stopped).  Sums commute, so late postings simply keep adding - no watermark
and nothing dropped.

T2 ``period_expenses``: the expenses-by-period report over a stream.  State is
kept by event-time day (``window``), which carries the watermark: once the
watermark has passed a day's end, Spark releases that day's state.  A row that
comes after that - later than the watermark's delay behind the newest event of
an earlier batch - is dropped and counted in the query's progress
(``numRowsDroppedByWatermark``); every other late row is added to its day.
Months, quarters and years are rolled up from days on read, because no window
expresses them and ``date_trunc`` of an event time loses its watermark.  Days
are UTC days.

State is one entry per key (account, currency and lot; or account and open
day), on a large cluster best kept in the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``).  Both sinks use
``foreachBatch`` to write each batch's changed rows to a
:class:`~tallyframe.streaming.state_table.StateTable`, which folds them into
snapshots; :func:`latest_state` reads the current result.  Nothing is collected
to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_match, account_root
from tallyframe.streaming.state_table import StateTable


def balances_stream(postings_stream: DataFrame, *, root_n: int | None = None, account_re: str | None = None,
                    keys: Sequence[str] = ("ledger_id",), lots: bool = True) -> DataFrame:
    """Streaming ``sum(position)`` by (keys, root(n, account), currency, lot)."""
    p = postings_stream
    if account_re is not None:
        p = p.where(account_match(account_re))
    if root_n is not None:
        p = p.withColumn("account", account_root(root_n))
    lot = [c for c in ("cost_number", "cost_currency", "cost_date") if lots and c in p.columns]
    return p.groupBy(*keys, "account", "currency", *lot).agg(F.sum("number").alias("number"))


DAY_KEY = ["ledger_id", "account", "day"]


def period_expenses_stream(stream: DataFrame, *, ts: str = "ts", ledger: str = "ledger_id",
                           account: str = "account", value: str = "number", watermark: str | None = "31 days",
                           account_re: str | None = None) -> DataFrame:
    """Streaming sum of ``value`` per (ledger_id, account, day): the amount of
    every day that a batch changed.  Rows without a time have no day and are
    left out.  ``watermark=None`` keeps the state of all days for ever."""
    s = stream
    if account_re is not None:
        s = s.where(account_match(account_re, account, ignore_case=True))
    if watermark is not None:
        s = s.withWatermark(ts, watermark)
    days = s.groupBy(F.window(ts, "1 day").alias("w"), F.col(ledger).alias("ledger_id"), F.col(account).alias("account")) \
        .agg(F.sum(value).alias("amount"))
    return days.select("ledger_id", "account", F.to_date("w.start").alias("day"), "amount")


def period_report(days: DataFrame, unit: str = "month") -> DataFrame:
    """(ledger_id, account, period, amount): days rolled up to calendar periods."""
    return days.groupBy("ledger_id", "account", F.to_date(F.date_trunc(unit, "day")).alias("period")).agg(
        F.sum("amount").alias("amount"))


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str, key: Sequence[str] | None = None, *,
                 every: int = 10, retain: int = 2) -> list:
    """Drive a streaming aggregation to the end of its available input
    (``availableNow``), writing each micro-batch's changed rows to the state
    table at ``out_path``; with ``key``, snapshots are made every ``every``
    batches.  Returns the progress of the batches."""
    table = StateTable(agg.sparkSession, out_path, key or [], every if key else 1 << 62, retain)
    q = (agg.writeStream.outputMode("update").foreachBatch(table.append)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def latest_state(spark: SparkSession, out_path: str, key: Sequence[str]) -> DataFrame:
    """Current value of every key: its row from the latest batch."""
    return StateTable(spark, out_path, key).current()
