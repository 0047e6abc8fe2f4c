"""The current value of every key of a streaming aggregation, as a table.

Each micro-batch writes its changed rows to ``<path>/batch_id=K`` (a batch that
runs again overwrites its own folder).  Every ``every`` batches the rows so far
are folded into a snapshot, ``<path>/_snapshots/upto=K``: one row a key.  A
reader takes the newest complete snapshot and the batches after it, so what it
reads is bounded by the number of keys and one interval of changes, however
long the stream has run.  Snapshots but the last ``retain``, and the batches
that the oldest of them covers, are deleted.

A snapshot of batch K is made from the snapshot before it and the batches in
between, none of which is deleted before K is complete, so a batch that is
interrupted anywhere can run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import delete_folder, subfolders

BATCH = "batch_id"


def latest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """The row of each key with the highest batch_id."""
    rest = [c for c in rows.columns if c not in (*key, BATCH)]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), BATCH).alias("__v"), F.max(BATCH).alias(BATCH))
    return last.select(*key, *(F.col(f"__v.{c}").alias(c) for c in rest), BATCH)


class StateTable:
    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], every: int = 10, retain: int = 2):
        self.spark, self.path, self.key, self.every, self.retain = spark, path, list(key), every, retain

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        return sorted(int(name.split("=")[1]) for name in subfolders(self.spark, folder) if name.startswith(f"{prefix}="))

    def snapshots(self) -> list[int]:
        return self._numbers(f"{self.path}/_snapshots", "upto")

    def batches(self) -> list[int]:
        return self._numbers(self.path, BATCH)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Sink of foreachBatch."""
        batch.write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch_id}")
        if (batch_id + 1) % self.every == 0:
            self.compact(batch_id)

    def compact(self, upto: int) -> None:
        """Write the snapshot of all batches up to one, then expire."""
        rows = self._rows(upto, before=True)
        if rows is None:
            return
        latest(rows, self.key).write.mode("overwrite").parquet(f"{self.path}/_snapshots/upto={upto}")
        kept = [s for s in self.snapshots() if s <= upto][-self.retain:]
        for s in self.snapshots():
            if s < kept[0]:
                delete_folder(self.spark, f"{self.path}/_snapshots/upto={s}")
        for b in self.batches():
            if b <= kept[0] and len(kept) == self.retain:
                delete_folder(self.spark, f"{self.path}/{BATCH}={b}")

    def _rows(self, upto: int, before: bool = False) -> DataFrame | None:
        """The newest snapshot up to a batch (``before``: older than it) and
        the batches after that snapshot."""
        usable = [s for s in self.snapshots() if s < upto or (s == upto and not before)]
        base = usable[-1] if usable else -1
        tail = [b for b in self.batches() if base < b <= upto]
        number = F.col(BATCH).cast("long")
        parts = [self.spark.read.parquet(f"{self.path}/_snapshots/upto={base}")] if usable else []
        if tail:
            read = self.spark.read.option("basePath", self.path)
            parts.append(read.parquet(*(f"{self.path}/{BATCH}={b}" for b in tail)).withColumn(BATCH, number))
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def current(self) -> DataFrame:
        """One row a key; ValueError before the first batch."""
        done = [*self.snapshots(), *self.batches()]
        if not done:
            raise ValueError(f"no batch has been written to {self.path}")
        return latest(self._rows(max(done)), self.key).drop(BATCH)
