"""Approximate nearest neighbours by multi-index hashing.

Codes are learned: on a bounded sample the vectors are centred and rotated so
that signs lose least (ITQ, twice from different starts), and every vector
gets the sign bits of both rotations.  For the inner product, vectors are
first scaled by the largest norm and given one more component that brings all
to length 1 (none is needed when norms are equal).

A code is split into substrings of WIDTH bits, each indexed by value.  Two
codes within Hamming radius r have, by the pigeonhole principle, a substring
that differs in at most r / (number of substrings) bits; probing all values
that close in every substring's index retrieves every code within r, and
those are reranked by the inner product of the original vectors, in single
precision first, in double precision for all that come near the best k.  The radius grows until it covers, with CONFIDENT standard
deviations to spare, the Hamming distance that vectors as near as the k-th
best found would have; if fewer than k vectors are found, it grows to the
whole code, so a query always gets k answers if there are k candidates.

Every usable row is indexed.  The index is dealt out in shards of at most
SHARD rows, queries in blocks of at most QUERIES; each pair of a shard and a
block is one group, which yields its best k per query.

Defined cases: vectors that are null, zero or hold null or non-finite
components, and rows without vec_id, take no part; a query's own vec_id is no
candidate for it; repeated rows are candidates each, but rows equal in vec_id
and vector are one query, and rows of one vec_id with different vectors are
queries each, ranked on their own; ties in score go to the smaller vec_id;
vectors of different dimensions are not compared: each dimension has its own
model and index; components may be of any magnitude (codes and the first rerank
are made of vectors scaled to length 1 at most); an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import stored, table
from tallyframe.llm.vector_dup import matrix, usable

SAMPLE, ROTATIONS, WIDTH = 20_000, 2, 16
SHARD, QUERIES = 16_384, 4_096
CONFIDENT = 2.0
_ONES = np.array([bin(v).count("1") for v in range(1 << WIDTH)], np.uint8)


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    """Vectors of length 1 whose products order as the inner products do."""
    x = x.astype(np.float64) / largest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1, keepdims=True)))])


def learn(sample: np.ndarray, largest: float, rounds: int = 30) -> dict:
    """Centre and rotations, (D, bits), from sampled vectors."""
    y = lifted(sample, largest)
    mean = y.mean(axis=0)
    y = y - mean
    out = []
    for k in range(ROTATIONS):
        r = np.linalg.qr(np.random.default_rng(k).normal(size=(y.shape[1], y.shape[1])))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ r >= 0, 1.0, -1.0).T @ y)
            r = (u @ v).T
        out.append(r)
    bits = (ROTATIONS * y.shape[1]) // WIDTH * WIDTH or WIDTH
    r = np.hstack(out)
    r = r[:, np.linspace(0, r.shape[1] - 1, min(bits, r.shape[1])).round().astype(int)]
    return {"mean": mean, "r": np.pad(r, ((0, 0), (0, max(0, bits - r.shape[1])))), "largest": largest,
            "bits": min(bits, r.shape[1])}


def encode(y: np.ndarray, model: dict) -> np.ndarray:
    """(rows, substrings) uint16 codes of lifted vectors."""
    bits = (y - model["mean"]) @ model["r"] > 0
    return np.packbits(bits.reshape(len(y), -1, WIDTH), axis=2).view(">u2")[:, :, 0].astype(np.uint16)


class Index:
    """The substring indexes of one shard: for each substring its values with
    the rows that have them, and the value of each row."""

    def __init__(self, codes: np.ndarray, vectors: np.ndarray):
        self.codes, self.vectors = codes, vectors.astype(np.float32)  # scaled: products of at most 1
        self.words = np.ascontiguousarray(np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4)))).view(np.uint64)
        self.tables = []
        for k in range(codes.shape[1]):
            order = np.argsort(codes[:, k], kind="stable")
            values, first, inverse = np.unique(codes[:, k], return_index=True, return_inverse=True)
            counts = np.bincount(inverse, minlength=len(values))
            last = np.cumsum(counts)
            self.tables.append((order, values, last - counts, counts, inverse.reshape(-1)))

    def within(self, code: np.ndarray, radius: int, seen: np.ndarray) -> np.ndarray:
        """Rows whose code is within ``radius`` and that are not ``seen``."""
        errors = radius // len(self.tables)
        hit = np.zeros(len(self.codes), bool)
        for k, (order, values, first, counts, value_of) in enumerate(self.tables):
            near = _ONES[values ^ code[k]] <= errors  # of the values to probe, those that occur
            some = np.flatnonzero(near)
            if len(some) * 8 > len(values):  # most rows are in them: go by row
                hit |= near[value_of]
            else:
                many = counts[some]
                hit[order[np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]] = True
        rows = np.flatnonzero(hit & ~seen)
        word = np.pad(code, (0, -len(code) % 4)).view(np.uint64)
        return rows[np.bitwise_count(self.words[rows] ^ word).sum(axis=1, dtype=np.int64) <= radius]


def search(x: np.ndarray, ids: np.ndarray, index: Index, q: np.ndarray, q_id: int, code: np.ndarray, bits: int,
           k: int, radius: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Row numbers and scores of the best k found for one query, and the radius
    that was needed.  ``radius``: where to begin; beginning too high costs
    time, never a neighbour."""
    seen = ids == q_id
    rows, rough = np.zeros(0, np.int64), np.zeros(0, np.float32)
    steps = len(index.tables)
    unit = q / np.abs(q).max()
    x32, q32 = index.vectors, (unit / np.sqrt((unit * unit).sum())).astype(np.float32)
    while True:
        radius = min(radius, bits)
        new = index.within(code, radius, seen)
        seen[new] = True
        rows = np.concatenate([rows, new])
        rough = np.concatenate([rough, x32[new] @ q32])
        if radius >= bits:
            needed = bits
            break
        needed = bits
        if len(rough) >= k:
            worst = np.partition(rough, len(rough) - k)[len(rough) - k]
            p = math.acos(min(1.0, max(-1.0, worst))) / math.pi
            needed = min(bits, math.ceil(p * bits + CONFIDENT * math.sqrt(p * (1 - p) * bits)))
        if radius >= needed:
            break
        radius = radius + steps if len(rough) < k else min(needed, radius + steps)
    if len(rough) > k:  # single precision leaves out what is clearly worse than the k-th best
        rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-4]
    scores = (x[rows] * q).sum(axis=1)
    best = np.lexsort((ids[rows], -scores))[:k]
    return rows[best], scores[best], needed


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score."""
    rows = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("v"), is_query.alias("query")) \
        .where("vec_id IS NOT NULL").where(usable(F.col("v"))).withColumn("d", F.size("v"))
    top = F.array_max(F.transform("v", F.abs))  # the norm without overflow
    norm = top * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / top) * (c / top)))
    facts = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(norm).alias("largest"), F.count(F.when(F.col("query"), 1)).alias("queries")) \
        .where("queries > 0").orderBy("d").collect()  # one row a dimension
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for one in facts:
        out = out.unionByName(_nearest(rows.where(F.col("d") == one["d"]), one, k))
    return out


def _nearest(rows: DataFrame, facts, k: int) -> DataFrame:
    """:func:`nearest` of usable vectors v of one dimension."""
    ids = rows.select("vec_id").distinct().orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE)
    picked = rows.join(F.broadcast(ids), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id")
    model = learn(np.array([r["v"] for r in picked.select("v").toLocalIterator()]), facts["largest"])

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                code = encode(lifted(x, model["largest"]), model)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("query"), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([r.tobytes() for r in code], pa.binary())], names=["vec_id", "query", "vec", "code"])

    index = stored(rows.select("vec_id", "query", "v")
                   .mapInArrow(coded, "vec_id long, query boolean, vec binary, code binary"), "ann-index")
    shards, blocks = math.ceil(facts["n"] / SHARD), math.ceil(facts["queries"] / QUERIES)
    deal = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = index.select("vec_id", "vec", "code", deal(shards, 1).alias("s")).withColumn("b", spread(blocks))
    queries_ = index.where("query").select("vec_id", "vec", "code").dropDuplicates(["vec_id", "vec"])
    right = queries_.select("vec_id", "vec", "code", F.xxhash64("vec").alias("row"), deal(blocks, 2).alias("b")).withColumn("s", spread(shards))

    def run(shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(queries):
            return pd.DataFrame({c: [] for c in ("query_id", "row", "vec_id", "score")})
        stack = lambda f, c, kind: np.frombuffer(b"".join(f[c]), kind).reshape(len(f), -1)
        x, codes, ids = stack(shard, "vec", np.float64), stack(shard, "code", np.uint16), shard["vec_id"].to_numpy()
        qx, qc = stack(queries, "vec", np.float64), stack(queries, "code", np.uint16)
        at, out, needed = Index(codes, x / model["largest"]), [], []
        for n in np.argsort(queries["vec_id"].to_numpy(), kind="stable"):
            q_id = queries["vec_id"].iloc[n]
            begin = int(np.median(needed[-64:])) if needed else 0  # what the queries before needed
            found, scores, radius = search(x, ids, at, qx[n], q_id, qc[n], model["bits"], k, begin)
            needed.append(radius)
            out.append(pd.DataFrame({"query_id": q_id, "row": queries["row"].iloc[n], "vec_id": ids[found], "score": scores}))
        return pd.concat(out)

    best = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(run, "query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
