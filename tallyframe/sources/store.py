"""Posting store (S5): postings laid out so that account and date filters skip
files, and balances at year ends so that an as-of question reads one of them
and the postings after it.

``<path>/postings`` is partitioned by account type (the first component of the
account) and year; inside a partition, transactions are spread over files by
hash, so a type or a year that holds a large share of all postings is many
files of even size, and the legs of a transaction that are of one type stay
together.  ``<path>/accounts`` has one row a ledger and account; a filter on
account names is looked up there first, which leaves a list of account types:
a static partition filter.  A set of accounts given as a table prunes the same
partitions at run time.

``<path>/snapshots`` is the prefix sum of the postings: the inventory (units by
ledger, account, currency and lot) at the end of each year, partitioned by year
and account type.  :meth:`PostingStore.inventory_at` reads the last year end
before a date and the postings after it, whatever the length of the history.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions.accounts import account_component, account_match, account_root
from tallyframe.session import path_exists

TYPE, YEAR = "account_type", "year"
LOT = ["cost_number", "cost_currency", "cost_date"]
NO_TYPE = "none"  # account type of postings without an account


def _day(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d))


def write_store(postings: DataFrame, path: str, *, files: int | None = None, max_rows_per_file: int = 5_000_000,
                by_transaction: bool = False) -> PostingStore:
    """Write postings (ledger_id, txn_id, account, date, ...) as a store.
    ``files`` (default ``spark.sql.shuffle.partitions``, what the deployment
    sized for the data) write tasks; each (type, year) is spread over an eighth
    as many.  ``by_transaction`` says that the postings come spread by
    transaction (out of a join on it): each task then sorts and writes what it
    holds, one file a (type, year), and nothing is shuffled.  Postings without
    a date are kept, in a partition of their own."""
    spark = postings.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = postings.withColumn(TYPE, F.coalesce(F.nullif(account_component(0), F.lit("")), F.lit(NO_TYPE))).withColumn(YEAR, F.year("date"))
    if not by_transaction:
        spread = F.pmod(F.xxhash64("ledger_id", "txn_id"), F.lit(max(1, files // 8)))
        placed = placed.repartition(files, TYPE, YEAR, spread)
    (placed.sortWithinPartitions(TYPE, YEAR, "account", "date")
     .write.option("maxRecordsPerFile", max_rows_per_file).partitionBy(TYPE, YEAR).mode("overwrite").parquet(f"{path}/postings"))
    # the columns and their types, also of a store without postings
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    store = PostingStore(spark, path, postings.columns)
    store.all().select("ledger_id", "account", TYPE).distinct().write.mode("overwrite").parquet(f"{path}/accounts")
    return store


class PostingStore:
    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str] | None = None):
        self.spark, self.path = spark, path
        self.schema = spark.read.parquet(f"{path}/schema").schema
        self.columns = list(columns or [c for c in self.all().columns if c not in (TYPE, YEAR)])
        self._types: dict[tuple, list[str]] = {}

    def all(self) -> DataFrame:
        """All postings, with the partition columns."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")

    def accounts(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/accounts")

    # ------------------------------------------------------------- pruning

    def types(self, pattern: str, ignore_case: bool = False) -> list[str]:
        """The account types that accounts matching a pattern have: a handful
        of names, whatever the number of accounts."""
        key = (pattern, ignore_case)
        if key not in self._types:
            found = self.accounts().where(account_match(pattern, ignore_case=ignore_case)).select(TYPE).distinct().collect()
            self._types[key] = sorted(r[0] for r in found)
        return self._types[key]

    def _pruned(self, df: DataFrame, accounts: str | None, ignore_case: bool) -> DataFrame:
        if accounts is None:
            return df
        return df.where(F.col(TYPE).isin(self.types(accounts, ignore_case)) & account_match(accounts, ignore_case=ignore_case))

    def postings(self, accounts: str | None = None, start=None, end=None, *, ignore_case: bool = False) -> DataFrame:
        """The postings of accounts that match a pattern, dated ``start`` to
        ``end`` (both included); only files that can hold some are read."""
        p = self._pruned(self.all(), accounts, ignore_case)
        if start is not None:
            p = p.where((F.col(YEAR) >= _day(start).year) & (F.col("date") >= F.lit(_day(start))))
        if end is not None:
            p = p.where((F.col(YEAR) <= _day(end).year) & (F.col("date") <= F.lit(_day(end))))
        return p.select(*self.columns)

    def postings_of(self, accounts: DataFrame) -> DataFrame:
        """The postings of the accounts (ledger_id, account) of a table, their
        types pruned at run time."""
        wanted = accounts.join(self.accounts(), ["ledger_id", "account"]).select("ledger_id", "account", TYPE).distinct()
        return self.all().join(wanted, [TYPE, "ledger_id", "account"], "left_semi").select(*self.columns)

    # ----------------------------------------------------------- snapshots

    def snapshot_years(self) -> list[int]:
        at = f"{self.path}/snapshot_years"
        if not path_exists(self.spark, at):
            return []
        return sorted(r[0] for r in self.spark.read.parquet(at).select("y").distinct().collect())

    def write_snapshots(self, since: int | None = None) -> list[int]:
        """Balances at the end of each year of the postings: all years, or from
        ``since`` on, from the year end before it (after postings of that year
        or later were added).  Returns the years."""
        old = [y for y in self.snapshot_years() if since is not None and y < since]
        self._write_years(old)  # those to be rewritten are not read meanwhile
        key = ["ledger_id", "account", TYPE, "currency", *(c for c in LOT if c in self.columns)]
        p = self.all().where(F.col(YEAR).isNotNull())
        p = p.where(F.col(YEAR) > old[-1]) if old else p
        yearly = p.groupBy(*key, YEAR).agg(F.sum("number").alias("number"))
        if old:
            base = self.spark.read.parquet(f"{self.path}/snapshots").where(F.col(YEAR) == old[-1])
            yearly = base.select(*yearly.columns).unionByName(yearly)
        last = p.agg(F.max(YEAR)).first()[0]
        if last is None:
            return old
        w = Window.partitionBy(*key).orderBy(YEAR)
        steps = yearly.select(*key, YEAR, F.sum("number").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("number"),
                              (F.lead(YEAR).over(w) - 1).alias("upto"))
        held = steps.where("number <> 0").select(
            *key, "number", F.explode(F.sequence(F.col(YEAR), F.coalesce("upto", F.lit(last)))).alias(YEAR))
        held = held.where(F.col(YEAR) > old[-1]) if old else held
        years = range(old[-1] + 1 if old else p.agg(F.min(YEAR)).first()[0], last + 1)
        (held.repartition(YEAR, TYPE, F.pmod(F.xxhash64("ledger_id", "account"), F.lit(8))).sortWithinPartitions(YEAR, TYPE)
         .write.partitionBy(YEAR, TYPE).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/snapshots"))
        # written last: years are readable only when their snapshots are whole
        self._write_years([*old, *years])
        return [*old, *years]

    def _write_years(self, years: list[int]) -> None:
        self.spark.createDataFrame([(y,) for y in years], "y int").coalesce(1).write.mode("overwrite") \
            .parquet(f"{self.path}/snapshot_years")

    def balances_at(self, date, accounts: str | None = None, *, ignore_case: bool = False, root_n: int | None = None,
                    lots: bool = True) -> DataFrame:
        """:meth:`inventory_at` with the zero positions."""
        d = _day(date)
        whole = [y for y in self.snapshot_years() if dt.date(y, 12, 31) <= d]
        keep = ["ledger_id", "account", "currency", *(c for c in LOT if lots and c in self.columns), "number"]
        tail = self.postings(accounts, dt.date(whole[-1] + 1, 1, 1) if whole else None, d, ignore_case=ignore_case).select(*keep)
        if whole:
            base = self.spark.read.parquet(f"{self.path}/snapshots").where(F.col(YEAR) == whole[-1])
            tail = self._pruned(base, accounts, ignore_case).select(*keep).unionByName(tail)
        if root_n is not None:
            tail = tail.withColumn("account", account_root(root_n))
        return tail.groupBy(*keep[:-1]).agg(F.sum("number").alias("number"))

    def inventory_at(self, date, accounts: str | None = None, **how) -> DataFrame:
        """The inventory held at the end of a day: (ledger_id, account[, first
        ``root_n`` components], currency, lot, number), as
        :func:`tallyframe.operators.inventory.inventory_sum` gives it."""
        return self.balances_at(date, accounts, **how).where(F.col("number") != 0)
