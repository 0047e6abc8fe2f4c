"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard
rotations, multiprobe buckets, verified pairs.

A table hashes a vector by HASHES independent rotations (sign flips and a fast
Hadamard transform, three times); each rotated vector is nearest to one of the
2 d vertices of the cross-polytope (the signed axis of its largest component).
A vector lies in its nearest bucket and is also looked up in the PROBES - 1
next nearest, ranked by how much further their vertices are.  Members of a
bucket are compared on their vectors; pairs of cosine >= LEAST are links.

Exact copies are one vector to the hashing: classes of equal vectors are
formed first and their rows counted.  A pair that meets in several buckets is
counted in the first of them only, which both vectors' bucket lists tell, so
pairs are never listed or shuffled: a block of a bucket yields the number of
links of each member and the edges that join its members into components.
Buckets of more than CHUNK members are compared in blocks.

The number of tables follows from the dimension: a table misses a pair of
cosine LEAST the more often, the more dimensions there are, so ``tables_for``
measures that on random pairs of exactly that cosine and takes as many tables
as leave MISS of them (at least TABLES).  In 64 dimensions these are 8, which
miss about 5 of 10,000 pairs of cosine 0.9 and 2 of a million of 0.95.

Defined cases: vectors that are null, zero or hold null or non-finite
components link with nothing (their component is their own vec_id); so do rows
without vec_id; repeated rows of equal vectors are linked to each other;
vectors of different lengths are never linked; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import blocks_of, connected_components, pair_blocks, pairs_in_groups, stored, table

TABLES, HASHES, PROBES = 8, 2, 4  # TABLES: the least
MISS = 0.001                      # of the pairs whose cosine is just LEAST
LEAST = 0.9
CHUNK = 2048


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of 2)."""
    h, n = 1, x.shape[1]
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_lists(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(rows, tables, probes): buckets of each vector, nearest first."""
    n, d = x.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = x
    near = min(probes, size)
    out = np.empty((n, tables, probes), np.int32)  # 2 * size vertices a hash: up to 15 bits for 2 hashes
    for t in range(tables):
        code, cost = np.zeros((n, 1), np.int64), np.zeros((n, 1))
        for k in range(hashes):
            signs = np.random.default_rng([size, t, k]).choice([-1.0, 1.0], size=(3, size))
            y = padded
            for s in signs:
                y = hadamard(y * s)
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :near]
            best = np.take_along_axis(y, order, 1)
            vertex = order * 2 + (best > 0)
            further = (np.abs(best[:, :1]) - np.abs(best)) ** 2
            code = (code[:, :, None] * (2 * size) + vertex[:, None, :]).reshape(n, -1)
            cost = (cost[:, :, None] + further[:, None, :]).reshape(n, -1)
            first = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            code, cost = np.take_along_axis(code, first, 1), np.take_along_axis(cost, first, 1)
        if code.shape[1] < probes:
            code = np.pad(code, ((0, 0), (0, probes - code.shape[1])), mode="edge")
        out[:, t] = code
    return out


def tables_for(d: int, least: float = LEAST, hashes: int = HASHES, probes: int = PROBES) -> int:
    """Tables that vectors of d dimensions need."""
    size = 1 << max(1, (d - 1).bit_length())
    pairs = min(2_000, max(500, (1 << 17) // size))
    x = np.random.default_rng([size, pairs]).standard_normal((2, pairs, size))
    x[0] /= np.linalg.norm(x[0], axis=1, keepdims=True)
    x[1] -= (x[0] * x[1]).sum(axis=1, keepdims=True) * x[0]
    x[1] /= np.linalg.norm(x[1], axis=1, keepdims=True)
    x[1] = least * x[0] + np.sqrt(max(0.0, 1 - least * least)) * x[1]
    missed = np.zeros(pairs, bool)
    for at in range(0, pairs, 250):
        a, b = (bucket_lists(v[at:at + 250], 1, hashes, probes)[:, 0] for v in x)
        missed[at:at + 250] = ~((a[:, :1] == b).any(axis=1) | (b[:, :1] == a).any(axis=1))
    if not missed.any():
        return TABLES
    return max(TABLES, int(np.ceil(np.log(MISS) / np.log(min(missed.mean(), 0.99)))))


def usable(v: Column) -> Column:
    """Whether a vector can be compared."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision, without overflow."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


PLACE = ["d", "t", "bucket"]
PLACE_SCHEMA = "d int, t int, bucket int, probe int, cls long, copies long, lists binary, vec binary"


def bucket_rows(classes: DataFrame, tables: int | None, hashes: int, probes: int, least: float = LEAST) -> DataFrame:
    """One row per class, table and probe: dimension d, table t, bucket, probe,
    cls, copies, lists (its buckets in all tables) and vec (its components)."""

    def run(batches):
        needed = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                dims = np.array([len(v) for v in part.column("v")])
                for d in np.unique(dims):
                    batch = part.filter(pa.array(dims == d))
                    x = matrix(batch.column("v"))
                    if d not in needed:
                        needed[d] = tables or tables_for(int(d), least, hashes, probes)
                    lists = bucket_lists(unit_rows(x), needed[d], hashes, probes)
                    again = np.zeros(lists.shape, bool)  # a short list repeats its last bucket
                    again[:, :, 1:] = lists[:, :, 1:] == lists[:, :, :-1]
                    row, t, probe = np.nonzero(~again)
                    own, vec = [r.tobytes() for r in lists], [r.tobytes() for r in x]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(row), d, np.int32)), pa.array(t.astype(np.int32)), pa.array(lists[row, t, probe]),
                        pa.array(probe.astype(np.int32)), batch.column("cls").take(pa.array(row)),
                        batch.column("copies").take(pa.array(row)),
                        pa.array([own[r] for r in row], pa.binary()), pa.array([vec[r] for r in row], pa.binary())],
                        names=[*PLACE, "probe", "cls", "copies", "lists", "vec"])

    return classes.select("cls", "copies", "v").mapInArrow(run, PLACE_SCHEMA)


def first_meeting(x: np.ndarray, y: np.ndarray, t: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether table t's bucket is the first place at which two vectors with
    the lists x and y (pairs, tables, probes) meet: a nearest bucket of one
    that is in the other's list, by table, then bucket."""
    far = np.iinfo(np.int32).max
    at_x = np.where((y == x[:, :, :1]).any(axis=2), x[:, :, 0], far)
    at_y = np.where((x == y[:, :, :1]).any(axis=2), y[:, :, 0], far)
    place = np.minimum(at_x, at_y)
    first = (place < far).argmax(axis=1)
    return (first == t) & (place[np.arange(len(t)), first] == bucket)


def join_rows(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the row numbers i and j pairwise in a forest of least roots."""
    while len(i):
        i, j = _roots(parent, i), _roots(parent, j)
        apart = i != j
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = parent[up]


def links_in_blocks(rows: DataFrame, element: str, probes: int, least: float) -> DataFrame:
    """(a, b, n): with b null, class a has n more linked rows; else a and b
    are in one component."""

    def run(batches):
        for t, sizes in blocks_of(batches, [*PLACE, "_bi", "_bj"], 8192):
            col = {c: t.column(c).to_numpy() for c in (*PLACE, "probe", "cls", "copies", "_bi", "_bj", "_c")}
            ends, d = np.cumsum(sizes), col["d"]
            cuts = np.concatenate([[0], np.flatnonzero(d[1:] != d[:-1]) + 1, [len(d)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):  # vectors of one dimension
                binary = lambda c: b"".join(t.column(c).slice(lo, hi - lo).to_pylist())  # noqa: E731, B023
                x = unit_rows(np.frombuffer(binary("vec"), element).reshape(hi - lo, -1))
                lists = np.frombuffer(binary("lists"), np.int32).reshape(hi - lo, -1, probes)
                c = {k: v[lo:hi] for k, v in col.items()}
                parent, n_links = np.arange(hi - lo), np.zeros(hi - lo, np.int64)
                for i, j in pairs_in_groups(sizes[(ends > lo) & (ends <= hi)], 50_000):
                    ok = ((c["probe"][i] == 0) | (c["probe"][j] == 0)) \
                        & ((c["_c"][i] != c["_c"][j]) | (c["_bi"][i] == c["_bj"][i]))
                    i, j = i[ok], j[ok]
                    ok = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    i, j = i[ok], j[ok]
                    ok = first_meeting(lists[i], lists[j], c["t"][i], c["bucket"][i])
                    i, j = i[ok], j[ok]
                    join_rows(parent, i, j)
                    n_links += np.bincount(i, c["copies"][j], hi - lo).astype(np.int64)
                    n_links += np.bincount(j, c["copies"][i], hi - lo).astype(np.int64)
                some = np.flatnonzero(n_links)
                root = _roots(parent, some)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([c["cls"][some], c["cls"][some]])),
                    pa.array(np.concatenate([c["cls"][root], c["cls"][root]]),
                             mask=np.repeat([True, False], len(some))),
                    pa.array(np.concatenate([n_links[some], np.zeros(len(some), np.int64)]))], names=["a", "b", "n"])

    dealt = pair_blocks(rows, PLACE, "cls", CHUNK)
    return dealt.repartition(*PLACE, "_bi", "_bj").sortWithinPartitions(*PLACE, "_bi", "_bj") \
        .select(*PLACE, "_bi", "_bj", "_c", "probe", "cls", "copies", "lists", "vec").mapInArrow(run, "a long, b long, n long")


def vector_duplicates(vectors: DataFrame, least: float = LEAST, tables: int | None = None, hashes: int = HASHES,
                      probes: int = PROBES) -> DataFrame:
    """(vec_id, embedding) -> vec_id, n_links, component_id, kept; ``tables``
    in all dimensions, else as many as each dimension needs."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).withColumn(
        "cls", F.when(usable(F.col("v")) & F.col("vec_id").isNotNull(), F.xxhash64("v")))
    ids = stored(rows.select("vec_id", "cls"), "vec-ids")
    classes = stored(rows.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vec-classes")
    found = stored(links_in_blocks(bucket_rows(classes, tables, hashes, probes, least), "float32" if kind == "float" else "float64",
                                   probes, least), "vec-links")
    n_links = found.where("b IS NULL").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    comp = connected_components(found.where("b IS NOT NULL").select("a", "b")) \
        .select(F.col("node").alias("cls"), "root")
    named = classes.select("cls", "rep", "copies").join(n_links, "cls", "left").join(comp, "cls", "left") \
        .withColumn("root", F.coalesce("root", "cls"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "root").select(
        "cls", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    return ids.join(named, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# compares all pairs of vectors: for the small sizes only
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9
), r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.a = vec_id LEFT JOIN k ON k.a = vec_id
"""
