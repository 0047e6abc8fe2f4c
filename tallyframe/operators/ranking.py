"""Positions in one order over a whole table.

A window without a partition puts all rows into one task, and one per ledger
puts a large ledger's rows there.  Here rows are range-partitioned and sorted,
numbered inside their file part, and shifted by the counts of the parts before;
one row a part (and group) is all that meets anywhere.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import scratch_path


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank", *, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with each row's position (INT, from 1) in ``order`` among the rows
    of equal ``by`` (all rows if empty).  Rows that ``order`` leaves tied are
    numbered in an order fixed when the sorted rows are written."""
    by = list(by)
    placed = _written(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
                      .withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    runs = placed.groupBy(*by, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = _written(runs.select(*(F.col(c).alias(f"__by{i}") for i, c in enumerate(by)), "__part", "__first",
                                 F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")), "rank-runs")
    on = part == F.col("__part")
    for i, c in enumerate(by):
        on = on & placed[c].eqNullSafe(shift[f"__by{i}"])
    rank = (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int")
    return placed.join(shift, on).select(*(placed[c] for c in df.columns), rank.alias(name))
