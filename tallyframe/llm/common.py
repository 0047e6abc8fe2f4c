"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.session import ensure_checkpoint_dir

MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: cuts the
    lineage, survives lost executors and keeps column pruning."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "llm", f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pack(df: DataFrame, *needed) -> DataFrame:
    """The needed columns, and all columns of ``df`` as the struct ``_in``, so
    that no name of theirs can clash with one an operator adds."""
    return df.select(*needed, F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_in"))


def unpack(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The packed columns again, some of them changed."""
    return df.select(*(changed.get(c, F.col("_in").getField(c)).alias(c) for c in columns))


# ---------------------------------------------------------------- native SQL

_BLOCK = 128


def _ends(lengths: Column, start: Column) -> Column:
    """Running sums of a short array of longs, beginning at ``start``."""
    init = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("ends"))
    step = lambda a, n: F.struct(
        (a["at"] + n).alias("at"), F.concat(a["ends"], F.array(a["at"] + n)).alias("ends"))
    return F.aggregate(lengths, init, step, lambda a: a["ends"])


def running_ends(lengths: Column) -> Column:
    """Running sums of an array<bigint>, in blocks of 128 so that the work
    stays near-linear for very long arrays."""
    blocks = lambda ls: F.transform(
        F.sequence(F.lit(0), F.greatest(F.floor((F.size(ls) - 1) / _BLOCK).cast("int"), F.lit(0))),
        lambda b: F.slice(ls, b * _BLOCK + 1, _BLOCK))
    total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda x, y: x + y)

    def body(bs: Column) -> Column:
        starts = F.transform(F.array(_ends(F.transform(bs, total), F.lit(0).cast("bigint"))),
                             lambda e: F.concat(F.array(F.lit(0).cast("bigint")), e))[0]
        return F.flatten(F.zip_with(bs, F.slice(starts, F.lit(1), F.size(bs)), _ends))

    # one-element transforms bind an expression once ("let"), so that it is
    # not evaluated again for each element
    return F.transform(F.array(lengths), lambda ls: F.transform(F.array(blocks(ls)), body)[0])[0]


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running_max(values: Column) -> Column:
    """Running maxima of an array<bigint>, in blocks like :func:`running_ends`."""
    low = F.lit(-(1 << 62)).cast("bigint")

    def maxima(block: Column, start: Column) -> Column:
        init = F.struct(start.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        step = lambda a, n: F.struct(F.greatest(a["at"], n).alias("at"), F.concat(a["out"], F.array(F.greatest(a["at"], n))).alias("out"))
        return F.aggregate(block, init, step, lambda a: a["out"])

    def body(bs: Column) -> Column:
        tops = F.transform(bs, lambda b: F.coalesce(F.array_max(b), low))
        starts = lambda ts: F.concat(F.array(low), maxima(ts, low))
        return F.flatten(F.zip_with(bs, let(tops, lambda ts: F.slice(starts(ts), F.lit(1), F.size(ts))), maxima))

    return let(values, lambda vs: let(blocks_of_array(vs), body))


def blocks_of_array(values: Column, size: int = _BLOCK) -> Column:
    """An array cut into arrays of ``size`` (one empty array if it is empty)."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / size).cast("int"), F.lit(0))),
                       lambda b: F.slice(values, b * size + 1, size))


def cut_out(text: Column, spans: Column) -> Column:
    """The texts of ascending, disjoint spans (start, stop; code points).  Each
    block of spans takes its stretch of the text once, so that the work is
    near-linear for long texts with many spans."""
    def block(bs: Column) -> Column:
        first, last = F.get(bs, F.lit(0))["start"], F.get(bs, F.size(bs) - 1)["stop"]
        piece = F.substring(text, (first + 1).cast("int"), (last - first).cast("int"))
        return let(F.struct(piece.alias("t"), first.alias("at")), lambda p: F.transform(bs, lambda s: F.substring(
            p["t"], (s["start"] - p["at"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))))

    empty = F.expr("cast(array() as array<string>)")
    return let(spans, lambda ss: F.when(F.size(ss) == 0, empty).otherwise(F.flatten(F.transform(blocks_of_array(ss), block))))


# -------------------------------------------------------- vectorised hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64 arrays."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C55  # odd: invertible modulo 2^64
_P_INV = pow(_P, -1, 1 << 64)
_PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        have = 1
        while have < n:
            take = min(have, n - have)
            out[have:have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
            have += take
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text with
    A-Z lower-cased, and the number of words of each text.  Works on the
    column's byte buffer: a word's hash is a difference of prefix sums."""
    data, offsets = utf8(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    starts[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    raw, at, n = np.empty(len(first), np.uint64), 0, min(_PIECE, len(data))
    powers, inverses = _powers(_P, n), _powers(_P_INV, n)
    while at < len(first):  # pieces of a few MB: bounded memory for any text
        to = max(at + 1, int(np.searchsorted(last, first[at] + _PIECE, side="right")))
        lo, hi = first[at], last[to - 1]
        power, inverse = (powers, inverses) if hi - lo <= n else (_powers(_P, hi - lo), _powers(_P_INV, hi - lo))
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((_LOWER[data[lo:hi]].astype(np.uint64) + np.uint64(1)) * power[:hi - lo], out=prefix[1:])
        raw[at:to] = (prefix[last[at:to] - lo] - prefix[first[at:to] - lo]) * inverse[first[at:to] - lo]
        at = to
    counts = np.diff(np.searchsorted(first, offsets))
    return mix64(raw + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), counts


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 2 << 20):
    """Pieces of a record batch that hold about ``most`` bytes (or values of a
    list column) each, so that memory does not grow with the texts' lengths."""
    values = batch.column(column)
    size = pc.list_value_length(values) if pa.types.is_list(values.type) else pc.binary_length(values)
    upto = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def pairs_in_groups(sizes: np.ndarray, most: int):
    """All pairs i < j of row numbers within consecutive groups of the given
    sizes, as blocks of about ``most`` pairs."""
    ends = np.cumsum(sizes)
    partners = np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0) - 1
    upto = np.cumsum(partners)
    at, n = 0, len(partners)
    while at < n:
        to = min(n, max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right"))))
        many = partners[at:to]
        i = np.repeat(np.arange(at, to), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        if len(i):
            yield i, j
        at = to


def pair_blocks(df: DataFrame, keys: list[str], member: str, chunk: int) -> DataFrame:
    """Deal the rows of each group (``keys``) out to blocks for comparing all
    members: a group of up to ``chunk`` rows is one block; a larger one is cut
    into m chunks by the member's hash and each row goes to the m blocks that
    pair its chunk with another (or itself).  Adds _bi, _bj (the block) and _c
    (the row's chunk)."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk) \
        .select(*keys, F.ceil(F.col("_n") / chunk).cast("int").alias("_m"))
    dealt = df.join(hot, keys, "left").withColumn("_m", F.coalesce("_m", F.lit(1))) \
        .withColumn("_c", F.pmod(F.xxhash64(member), F.col("_m")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    return dealt.withColumn("_o", other).withColumn("_bi", F.least("_c", "_o")) \
        .withColumn("_bj", F.greatest("_c", "_o")).drop("_o", "_m")


def blocks_of(batches, columns: list[str], least_rows: int = 65536):
    """Record batches sorted by ``columns`` -> pyarrow tables that hold whole
    groups only, with the groups' sizes."""
    held: list[pa.RecordBatch] = []

    def cut(t: pa.Table, last: bool):
        same = np.ones(max(0, t.num_rows - 1), bool)
        for c in columns:
            v = t.column(c).to_numpy()
            same &= v[1:] == v[:-1]
        edges = np.concatenate([[0], np.flatnonzero(~same) + 1, [t.num_rows]])
        whole = t.num_rows if last else int(edges[-2])
        return whole, np.diff(edges if last else edges[:-1])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= least_rows:
            t = pa.Table.from_batches(held).combine_chunks()
            whole, sizes = cut(t, False)
            if whole:
                yield t.slice(0, whole), sizes
            held = t.slice(whole).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, cut(t, True)[1]


# ------------------------------------------------------ connected components


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: longs); the root is the
    smallest node of its component.

    Each round hooks every node to its smallest neighbour, shortens the
    pointers twice and contracts the edges, so the graph shrinks by a factor
    each round.  Only joins and partial aggregates; states are written to the
    shared checkpoint folder.  Rows with a null end and loops are ignored, an
    empty input gives an empty result.
    """
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .where("a < b").distinct(), "cc-edges")
    labels = None
    for _ in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a"))
        hook = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                      .select("node", F.least("node", "m").alias("root")), "cc-hook")
        for _ in range(2):
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            hook = hook.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        hook = stored(hook, "cc-hook")
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            labels = stored(labels.join(step, "root", "left")
                            .select("node", F.coalesce("up", "root").alias("root")), "cc-labels")
        ends = edges
        for c in ("a", "b"):
            ends = ends.join(hook.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c)
        edges = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                       .where("a < b").distinct(), "cc-edges")
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


# -------------------------------------------------------- distributed prefix


def global_prefix(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in ``order``:
    range-partitioned, summed within partitions, and shifted by the partitions
    before (one row per partition meets in one task)."""
    placed = stored(df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id())
                    .withColumn("_v", value.cast("bigint")), "prefix")
    before = (Window.unboundedPreceding, -1)
    local = Window.partitionBy("_pid").orderBy(*order).rowsBetween(*before)
    across = Window.orderBy("_p").rowsBetween(*before)
    shift = placed.groupBy(F.col("_pid").alias("_p")).agg(F.sum("_v").alias("_s")) \
        .select("_p", F.coalesce(F.sum("_s").over(across), F.lit(0)).alias("_shift"))
    return placed.withColumn("_at", F.coalesce(F.sum("_v").over(local), F.lit(0))) \
        .join(shift, F.col("_pid") == F.col("_p")) \
        .withColumn(name, F.col("_at") + F.col("_shift")).drop("_pid", "_p", "_v", "_at", "_shift")
