"""Language-model scoring with a hierarchical Pitman-Yor model.

The model predicts each token (words, then one end) in the restaurant of its
context, the token before it: every word has a restaurant of its own, and so
has the beginning of a text.  All restaurants share a parent, the unigram
restaurant, whose own base is uniform over the V known tokens and one unknown;
a context that no training text holds is an empty restaurant, which predicts
as the parent does.  In a restaurant with c customers for a dish at t tables,

    P(w | u) = (c_uw - d t_uw) / (theta + c_u) + (theta + d t_u) / (theta + c_u) P(w | parent),

and every table of a child restaurant is a customer of the parent.

Seatings are sampled by Gibbs: a sweep draws, for each dish of each
restaurant, its number of tables given all others, which is all of a seating
that the predictions need.  The draw is from the exact conditional, with
generalised Stirling numbers: from a table up to EXACT customers, by contour
integrals beyond (logarithms right to 2e-4).  Pairs are independent given the totals of
their context and of their word, so a sweep runs over all pairs in parallel.
Pairs lie in shards by context and words in shards of their own; rows hold many
of them, packed.  In a sweep each shard of pairs draws and tells the words'
shards its sums of tables, which draw and answer with customers and tables.  A
very frequent context is dealt to several shards; its sums, and the sums over
all words, meet on the driver.  A pair with one customer has one table
always; it counts in the sums and is not carried through the sweeps.  Random
numbers are hashes of (word, context, sweep), so a lost task is recomputed to
the same seating.  After BURN_IN sweeps, predictive probabilities are averaged
over the seatings of the others.

Scoring: pairs of a context and a word that make up at least HOT of the
training tokens (at most 1 / HOT of them) are looked up in a broadcast table;
the rest go to the shards of their contexts by their pairs' hashes, and the
logarithms are summed per document.  The pairs of the documents held out are in the table
too, with no customers.  Tokens are 64-bit hashes throughout.

Defined cases: a null or empty text has one token, its end; a row without
doc_id counts as held out; repeated rows are trained on and scored each; with
no training rows the base is uniform over the unknown alone (score 0); an
empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
import functools
import math
import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import mix64, slices, stored, table, word_hashes
from tallyframe.session import delete_folder, ensure_checkpoint_dir

FOLDS, HELD_OUT = 7, 2
HOT = 2.5e-7
SWEEPS, BURN_IN = 3, 1
THETA = 1.0
EXACT = 512                        # customers up to which a table holds the Stirling numbers; integrals beyond
NODES, STEPS = 12, 36              # of the polynomial and of the integrals
SAMPLE, OFTEN = 32, 1 << 17        # documents looked at for the layout: every 32nd; words that are packed, at most
SHARD = 2_000_000                  # tokens of a shard, about
BEGIN = np.uint64(1)               # the context of a first token; all others are the hash of the word before
END = np.uint64(0x5851F42D4C957F2D)


def training(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS != HELD_OUT, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes (words and ends) and the number of tokens of each text."""
    words, counts = word_hashes(texts)
    return np.insert(words, np.cumsum(counts), END), counts + 1


def contexts(w: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Context of each token: the token before it in its text."""
    u = np.empty(len(w), np.uint64)
    u[1:] = w[:-1]
    u[np.cumsum(counts) - counts] = BEGIN
    return u


def pair_hash(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    return mix64(w + mix64(u.astype(np.uint64)))


def _batches(batches):
    for whole in batches:
        yield from slices(whole, most=1 << 20)


# ------------------------------------------------------------- packed shards
#
# A row holds many pairs or words: ``u`` and ``w`` are packed hashes (u once for each run of equal
# ones), ``x`` columns of whole numbers from 0.

KINDS = PAIRS, MESSAGE, WORDS, REPLY, STATE, APART, INFO, TOKENS, HOTTEST, EASY = range(10)
ROW = "shard int, kind int, src int, nu int, nw int, n int, u binary, w binary, x array<binary>, sums array<long>"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_TYPES = [pa.int32()] * 6 + [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]


def packed(h: np.ndarray, often: np.ndarray) -> bytes:
    """Hashes, three bytes each if they are in ``often``."""
    at, known = _found(often, h)
    return np.packbits(known).tobytes() + at[known].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes() \
        + h[~known].tobytes()


def unpacked(blob: bytes, n: int, often: np.ndarray) -> np.ndarray:
    flags = (n + 7) // 8
    known = np.unpackbits(np.frombuffer(blob, np.uint8, flags), count=n).astype(bool)
    k = int(known.sum())
    at = np.zeros((k, 4), np.uint8)
    at[:, :3] = np.frombuffer(blob, np.uint8, 3 * k, flags).reshape(k, 3)
    out = np.empty(n, np.uint64)
    out[known] = often[at.view("<u4").ravel()]
    out[~known] = np.frombuffer(blob, np.uint64, n - k, flags + 3 * k)
    return out


def planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 (of 64 bits): all lowest bytes, all second ones, and so on."""
    x = np.ascontiguousarray(x if x.dtype.itemsize == 8 else x.astype(np.int64))
    k = max(1, (int(x.view(np.uint64).max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def unplanes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :blob[0]] = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], n).T
    return out.view("<i8").ravel()


def _found(among: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash in a sorted array, and whether it is there."""
    if not len(among):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(among, h), len(among) - 1)
    return at, among[at] == h


def _starts(*sorted_by: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_by[0]), bool)
    if len(new):
        new[1:] = np.any([v[1:] != v[:-1] for v in sorted_by], axis=0)
    return np.flatnonzero(new)


def _numbered(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, ascending, and the number of each hash among them."""
    order = np.argsort(h)
    at = _starts(h[order])
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
    return h[order[at]], of


def _split(shard: np.ndarray, order: np.ndarray | None = None) -> list[np.ndarray]:
    """Places of the rows of each shard, in their order."""
    order = np.arange(len(shard)) if order is None else order
    small = shard[order].astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard[order]
    order = order[np.argsort(small, kind="stable")]
    return np.split(order, _starts(shard[order])[1:]) if len(order) else []


def _row(often, shard, kind, src=0, u=None, w=None, of=None, ints=(), raw=(), sums=None) -> tuple:
    """``w``: words, ascending and each once; ``of``: numbers of the words of pairs."""
    x, nu, nw, ub = [], 0, 0, None
    if u is not None:
        at = _starts(u)
        nu, ub = len(at), packed(u[at], often)
        x = [planes(np.diff(np.append(at, len(u)))), planes(of)]
    n = len(of) if of is not None else len(w) if w is not None else len(ints[0])
    if w is not None:
        nw, w = len(w), packed(w, often)
    return int(shard), kind, int(src), nu, nw, n, ub, w, x + [planes(v) for v in ints] + list(raw), sums


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _TYPES)], names=_NAMES)


def _read(r: dict, often: np.ndarray, ints: int) -> tuple:
    """u (None if the row has none), w, numbers of the pairs' words in w, the
    columns of numbers and what else the row holds."""
    x, n, u, of = list(r["x"]), r["n"], None, None
    if r["u"] is not None:
        u = np.repeat(unpacked(r["u"], r["nu"], often), unplanes(x.pop(0), r["nu"]))
        of = unplanes(x.pop(0), n)
    w = None if r["w"] is None else unpacked(r["w"], r["nw"], often)
    return u, w, of, [unplanes(v, n) for v in x[:ints]], x[ints:]


def _by_shard(batches):
    """Number and rows by kind of each shard, from rows sorted by shard."""
    held, at = {}, None
    for batch in batches:
        for r in batch.to_pylist():
            if held and r["shard"] != at:
                yield at, held
                held = {}
            at = r["shard"]
            held.setdefault(r["kind"], []).append(r)
    if held:
        yield at, held


def _dealt(*rows: DataFrame) -> DataFrame:
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out.repartition("shard").sortWithinPartitions("shard", "kind", "src")


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """``stored``, in a folder for each kind of rows."""
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "llm", f"{tag}-{uuid.uuid4().hex}")
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*_NAMES)


def _drop(rows: DataFrame, *kinds: int) -> None:
    """Deletes a stored table, or its rows of some kinds, that nothing reads any more."""
    for folder in {os.path.dirname(f) for f in rows.inputFiles()}:
        if not kinds or folder.endswith(tuple(f"/kind={k}" for k in kinds)):
            delete_folder(rows.sparkSession, folder)


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Files of a shuffle go when the query that made them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def outline(docs: DataFrame) -> dict:
    """How the work is laid out, from every SAMPLE-th document (no result
    depends on it): the number of shards of contexts and of words, words that
    are packed, and contexts so frequent that parts of their pairs are dealt
    to several shards."""

    def run(batches):
        for batch in _batches(batches):
            u, n = np.unique(contexts(*tokens(batch.column("text"))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["u", "n"])

    seen = stored(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
                  .mapInArrow(run, "u long, n long").groupBy("u").agg(F.sum("n").alias("n")), "lm-sample")
    total = seen.agg(F.sum("n")).first()[0] or 0
    top = seen.where(F.col("n") >= max(2.0, total / OFTEN)).toPandas()  # at most OFTEN rows
    u, n = top["u"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    u, n = u[np.argsort(u)], n[np.argsort(u)]
    _drop(seen)
    shards = max(32, math.ceil(total * SAMPLE / SHARD))
    parts = np.ceil(n / max(total, 1) * shards * 4).astype(np.int64)  # none more than a quarter of a mean shard
    many = (parts > 1) & (n >= 100)
    return {"shards": shards, "word_shards": max(32, shards // 4), "often": u, "apart": u[many], "parts": parts[many]}


def _shard_of(u: np.ndarray, w: np.ndarray, lay: dict) -> np.ndarray:
    at, apart = _found(lay["apart"], u)
    part = np.zeros(len(u), np.uint64)
    part[apart] = mix64(w[apart]) % lay["parts"][at[apart]].astype(np.uint64)
    return ((mix64(u) % np.uint64(1 << 40) + part) % np.uint64(lay["shards"])).astype(np.int64)


def _word_shard(w: np.ndarray, lay: dict) -> np.ndarray:
    return (mix64(w ^ np.uint64(0x51ED270B)) % np.uint64(lay["word_shards"])).astype(np.int64)


def _messages(often, shard: int, w: np.ndarray, ints, lay: dict):
    """Rows that tell the words' shards numbers of ascending words."""
    to = _word_shard(w, lay)
    for r in _split(to):
        yield _row(often, to[r[0]], MESSAGE, shard, w=w[r], ints=[v[r] for v in ints])


def _replies(replies: list[dict], w: np.ndarray, ints: int, lay: dict) -> list[np.ndarray]:
    """The numbers that the words' shards sent back, in the order of ``w``."""
    to, out = _word_shard(w, lay), [np.zeros(len(w), np.int64) for _ in range(ints)]
    at = {int(to[r[0]]): r for r in _split(to)}
    for r in replies:
        for v, got in zip(out, r["x"]):
            v[at[r["src"]]] = unplanes(got, r["n"])
    return out


def _merged(parts: list) -> list:
    """Count arrays (key, count, w, u) merged by key."""
    key, n, w, u = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    at = _starts(key[order])
    first = order[at]
    return [(key[first], np.add.reduceat(n[order], at), w[first], u[first])]


def _pair_stripes(docs: DataFrame, lay, train: bool) -> DataFrame:
    """Rows of the pairs of each task's texts with their counts (0 unless
    ``train``), by the shard of their context."""

    def run(batches):
        parts = []
        for batch in _batches(batches):
            w, counts = tokens(batch.column("text"))
            u = contexts(w, counts)
            trained = np.repeat(batch.column("trained").to_numpy(zero_copy_only=False), counts)
            parts += _merged([(pair_hash(w, u), trained.astype(np.int64), w, u)])
            if sum(len(p[0]) for p in parts) > 1_000_000:
                parts = _merged(parts)
                if len(parts[0][0]) > 500_000:
                    yield from emit(parts)
                    parts = []
        if parts:
            yield from emit(_merged(parts))

    def emit(parts):
        _, n, w, u = parts[0]
        shard = _shard_of(u, w, lay.value)
        for r in _split(shard, np.argsort(u)):
            words, of = _numbered(w[r])
            yield _emit([_row(lay.value["often"], shard[r[0]], PAIRS, u=u[r], w=words, of=of, ints=[n[r]])])

    trained = training(F.col("doc_id")) if train else F.lit(False)
    return docs.select("text", trained.alias("trained")).mapInArrow(run, ROW)


def _state(often, shard: int, u: np.ndarray, words: np.ndarray, of: np.ndarray, ints: list) -> tuple:
    """The row of the pairs of two customers or more, with their words only."""
    some, of = _numbered(of)
    return _row(often, shard, STATE, u=u, w=words[some], of=of, ints=ints)


def _pair_shards(stripes: DataFrame, lay) -> DataFrame:
    """For each shard the pairs by context and word; to the shards of its words
    their counts, pairs of one customer and of more; counts of contexts whose
    pairs are dealt out."""

    def merged(shard, rows):
        often = lay.value["often"]
        got = [_read(r, often, 1) for r in rows[PAIRS]]
        names, place = _numbered(np.concatenate([u for u, *_ in got]))
        words, of = _numbered(np.concatenate([w[of] for _, w, of, _, _ in got]))
        key = place * len(words) + of
        order = np.argsort(key)
        at = _starts(key[order])
        c = np.add.reduceat(np.concatenate([x[0] for *_, x, _ in got])[order], at)
        place, of = np.divmod(key[order[at]], len(words))
        u, many = names[place], c > 1
        count = lambda x: np.bincount(of, x, len(words)).astype(np.int64)
        told = [count(c), count(c == 1), count(many)]
        c_u, ones, pairs = (np.bincount(place, x).astype(np.int64) for x in (c, c == 1, c > 0))
        apart = _found(lay.value["apart"], names)[1]
        out = [_row(often, shard, PAIRS, u=u, w=words, of=of, ints=[c], sums=[
            int(c.sum()), int((c == 1).sum()), int((c == 2).sum()), int((~apart & (c_u > 0)).sum())])]
        known = told[0] > 0
        out += _messages(often, shard, words[known], [x[known] for x in told], lay.value)
        if many.any():
            out.append(_state(often, shard, u[many], words, of[many], [c[many], many[many], ones[place][many]]))
        if apart.any():
            out.append(_row(often, shard, APART, w=names[apart], ints=[v[apart] for v in (c_u, ones, pairs)]))
        return out

    def run(batches):
        for shard, rows in _by_shard(batches):
            yield _emit(merged(shard, rows))

    return _dealt(stripes).mapInArrow(run, ROW)


def _apart(rows: DataFrame, lay: dict, ints: int) -> np.ndarray:
    """Sums over the parts of the contexts that are dealt out (a few for each shard)."""
    out = np.zeros((ints, len(lay["apart"])), np.int64)
    for r in rows.where(F.col("kind") == APART).collect():
        _, w, _, got, _ = _read(r.asDict(), lay["often"], ints)
        np.add.at(out, (slice(None), _found(lay["apart"], w)[0]), np.array(got))
    return out


@functools.lru_cache
def stirling(d: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), c and t up to n."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0
    for c in range(n):
        t = np.arange(1, n + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = out[c, 1:] + np.log(np.where(c - t * d > 0, c - t * d, 0))
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], np.where(np.isnan(stay), -np.inf, stay))
    return out


def _uniform(seed: np.ndarray, sweep: int) -> np.ndarray:
    return (mix64(seed + np.uint64(0x9E3779B97F4A7C15 * (sweep + 1) % (1 << 64))) >> np.uint64(11)) / float(1 << 53)


def draw_tables(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, logs: np.ndarray, seed: np.ndarray,
                sweep: int) -> np.ndarray:
    """Numbers of tables of dishes with c customers, whose parent's
    probability is ``base``, in restaurants with ``others`` other tables."""
    t = np.ones(len(c), np.int64)
    draw = _uniform(seed, sweep)
    for lo, hi in ((2, 2), (3, 4), (5, 8), (9, 16), (17, 32), (33, 64), (65, 128), (129, 256), (257, EXACT)):
        rows, most = np.flatnonzero((c >= lo) & (c <= hi)), 320_000 // hi
        for at in range(0, len(rows), most):
            r = rows[at:at + most]
            k = np.arange(1, hi + 1)
            weight = logs[c[r], 1:hi + 1] + k * np.log(base[r])[:, None] \
                + np.cumsum(np.log(THETA + d * (others[r][:, None] + k - 1)), axis=1)
            t[r] = _inverse(weight, draw[r])
    rows = np.flatnonzero(c > EXACT)
    for at in range(0, len(rows), 2_000):
        r = rows[at:at + 2_000]
        t[r] = _draw_many(c[r], base[r], others[r], d, draw[r])
    return t


def _inverse(log_weight: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Number (from 1) of the column that each row's uniform number falls in."""
    weight = np.cumsum(np.exp(log_weight - log_weight.max(axis=1, keepdims=True)), axis=1)
    return 1 + (weight < draw[:, None] * weight[:, -1:]).sum(axis=1)


def _draw_many(c: np.ndarray, base: np.ndarray, others: np.ndarray, d: float, draw: np.ndarray) -> np.ndarray:
    """``draw_tables`` for more customers than the table of Stirling numbers
    holds: weights over the window that holds all but 1e-15 of the mass."""
    a = THETA / d + others
    lo_z, hi_z = np.full(len(c), -9.0), np.full(len(c), 600.0)

    def slope(z):  # of the log weight, and the number of tables whose saddle z is
        log_f, m = _saddle(z, d)
        t = c / m
        return log_f + np.log((a + t) * base / t), t

    for _ in range(45):
        z = (lo_z + hi_z) / 2
        up = slope(z)[0] > 0
        lo_z, hi_z = np.where(up, lo_z, z), np.where(up, z, hi_z)
    (s1, t1), (s0, t0) = slope(hi_z - 0.05), slope(hi_z + 0.05)
    sd = np.sqrt(np.maximum(t1 - t0, 1e-9) / np.maximum(s0 - s1, 1e-9))
    mode = np.minimum(slope(hi_z)[1], c)
    lo = np.maximum(1, np.floor(mode - 9 * sd - 4)).astype(np.int64)
    hi = np.minimum(c, np.ceil(mode + 9 * sd + 14)).astype(np.int64)
    t = np.empty(len(c), np.int64)

    def draw_rows(r, smooth):  # rows of like windows together, at most a million cells
        r = r[np.argsort((hi - lo)[r], kind="stable")]
        while len(r):
            n = len(r)
            while n > 1 and n * (hi - lo)[r[n - 1]] > 1_000_000:
                n = (n + 1) // 2
            now, r = r[:n], r[n:]
            at = lo[now][:, None] + np.arange((hi - lo)[now].max() + 1)
            k = np.minimum(at, hi[now][:, None])
            ratio = np.log((a[now][:, None] + k - 1) * base[now][:, None] / np.maximum(k - 1, 1))
            ratio[:, 0] = 0
            weight = np.where(at > hi[now][:, None], -np.inf, np.cumsum(ratio, axis=1) + smooth(now, k))
            t[now] = lo[now] - 1 + _inverse(weight, draw[now])

    # the smooth part of the weight: a polynomial through Chebyshev nodes of the window, but near
    # t = c, where the integral needs whole t, itself (such windows are some hundred wide)
    x = np.cos(np.pi * np.arange(NODES) / (NODES - 1))
    fit = np.linalg.inv(np.polynomial.chebyshev.chebvander(x, NODES - 1)).T

    def polynomial(r, k):
        at = (lo + hi)[r][:, None] / 2 + (hi - lo)[r][:, None] / 2 * x
        poly = log_coefficient(np.repeat(c[r], NODES), at.ravel(), d).reshape(at.shape) @ fit
        where = np.clip((2 * k - (lo + hi)[r][:, None]) / np.maximum(hi - lo, 1)[r][:, None], -1, 1)
        return np.polynomial.chebyshev.chebval(where, poly.T[:, :, None], tensor=False)

    def itself(r, k):
        cells = np.repeat(c[r], k.shape[1]), k.ravel().astype(float)
        return np.concatenate([log_coefficient(*(v[i:i + 20_000] for v in cells), d)
                               for i in range(0, k.size, 20_000)]).reshape(k.shape)

    draw_rows(np.flatnonzero(hi + 24 < c), polynomial)
    draw_rows(np.flatnonzero(hi + 24 >= c), itself)
    return t


def _saddle(z: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """log f(x) and x f'(x) / f(x) of f(x) = 1 - (1 - x)^d at x = 1 / (1 + e^-z)."""
    log_y = -np.logaddexp(0, z)  # y = 1 - x
    f = -np.expm1(d * log_y)
    return np.log(f), d * np.exp((d - 1) * log_y) / (1 + np.exp(-z)) / f


def log_coefficient(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log of [x^c] f(x)^t / t, f(x) = 1 - (1 - x)^d, which is the generalised
    Stirling number S(c, t) times t! d^t / (c! t).

    Cauchy's integral through the saddle point of the integrand by the
    midpoint rule, which converges geometrically: over a circle around 0 if
    the saddle is near, else over a parabola around the cut from 1, no nearer
    to the cut than 3 / c."""
    lo, hi = np.full(len(c), -9.0), np.log(c / 3)
    for _ in range(20):  # any contour gives the integral; one close to the saddle gives it exactly enough
        z = (lo + hi) / 2
        far = _saddle(z, d)[1] > c / t
        lo, hi = np.where(far, lo, z), np.where(far, z, hi)
    (_, m1), (log_f, m) = _saddle(z + 1e-3, d), _saddle(z, d)
    log_y = -np.logaddexp(0, z)
    x0, y0, log_x = np.exp(z + log_y), np.exp(log_y), z + log_y
    peak = t * log_f - c * log_x
    bend = np.maximum(t * (m1 - m) / 1e-3 / y0, 1e-12)  # second derivative by log x, whose derivative by z is y
    half = (np.arange(STEPS) + 0.5) / STEPS
    out = np.empty(len(c))
    for round_, r in ((True, np.flatnonzero(x0 < 0.5)), (False, np.flatnonzero(x0 >= 0.5))):
        if not len(r):
            continue
        if round_:
            width = 8 / np.sqrt(bend[r])
            width = np.where(width > 2, np.pi, width)
            x = x0[r][:, None] * np.exp(1j * width[:, None] * half)
            log_1 = 0.5 * np.log1p(np.abs(x) ** 2 - 2 * x.real) + 1j * np.arctan2(-x.imag, 1 - x.real)
            part, scale, at_x = -np.expm1(d * log_1), 1 / np.pi, log_x[r][:, None] + 1j * width[:, None] * half
        else:
            by_arm = 2 * y0[r] / x0[r]
            width = 8 / np.sqrt(bend[r] * by_arm ** 2 + np.maximum(c[r] - t[r] * m[r], 0) * by_arm)
            arm = 1 + 1j * width[:, None] * half
            y = y0[r][:, None] * arm ** 2
            part, scale = 1 - np.exp(d * (log_y[r][:, None] + 2 * np.log(arm))), 2 * y0[r] / np.pi
            at_x = 0.5 * np.log1p(np.abs(y) ** 2 - 2 * y.real) + 1j * np.arctan2(-y.imag, 1 - y.real)
        value = np.exp(t[r][:, None] * np.log(part) - c[r][:, None] * at_x - peak[r][:, None])
        if not round_:
            value = value * arm * np.exp(-at_x)
        out[r] = peak[r] + np.log(value.real.sum(axis=1) * width / STEPS * scale) - np.log(t[r])
    return out


class BackOff:
    """Weight of the parent in each restaurant after a sweep, by context."""

    def __init__(self, m: dict, totals: dict):
        self.m, self.contexts = m, totals["contexts"]

    def __getitem__(self, u: int) -> float:
        r = self.contexts.where(F.col("u") == int(u)).first()
        return (THETA + self.m["d1"] * r["children"]) / (THETA + r["c_u"]) if r else 1.0


def back_off(m: dict, totals: dict) -> BackOff:
    return BackOff(m, totals)


def _of_context(u: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums over the pairs of each context, for each pair; pairs come by context."""
    at = _starts(u)
    return np.repeat(np.add.reduceat(x, at), np.diff(np.append(at, len(u))))


def _sweep_pairs(state: DataFrame, m: dict, last: dict, k: int, lay) -> DataFrame:
    """A Gibbs sweep over the pairs of two customers or more: their new state,
    and to the shards of the words the sums of tables."""
    n0, tables0, children_apart = last["customers"], last["tables"], last["apart"]

    def run(batches):
        for shard, rows in _by_shard(batches):
            if STATE not in rows:
                continue
            often = lay.value["often"]
            u, words, of, (c, t, ones, *kept), _ = _read(rows[STATE][0], often, 3 + max(0, k - BURN_IN))
            customers, tau = (v[of] for v in _replies(rows.get(REPLY, []), words, 2, lay.value))
            children = ones + _of_context(u, t)
            place, apart = _found(lay.value["apart"], u)
            children[apart] = children_apart[place[apart]]
            own = customers - m["d0"] * tau - t + m["d0"] * np.minimum(tau, t)
            base = (np.maximum(own, 0) + (THETA + m["d0"] * tables0) * m["uniform"]) / (THETA + n0)
            t = draw_tables(c, base, children - t, m["d1"], stirling(m["d1"]), pair_hash(words[of], u + np.uint64(1_000_000)), k)
            out = [_row(often, shard, STATE, u=u, w=words, of=of, ints=[c, t, ones, *kept, *([t] if k >= BURN_IN else [])])]
            out += _messages(often, shard, words, [np.bincount(of, t, len(words)).astype(np.int64)], lay.value)
            if apart.any():
                names, at = np.unique(u[apart], return_inverse=True)
                out.append(_row(often, shard, APART, w=names, ints=[np.bincount(at, t[apart]).astype(np.int64)]))
            yield _emit(out)

    return state.mapInArrow(run, ROW)


def _word_row(often, shard: int, words: np.ndarray, ints: list) -> tuple:
    _, _, customers, tau, *_ = ints
    return _row(often, shard, WORDS, w=words, ints=ints, sums=[
        int(customers.sum()), int(tau.sum()), len(words), int((customers == 1).sum()), int((customers == 2).sum())])


def _first_words(rows: DataFrame, lay) -> DataFrame:
    """The words with counts, pairs of one customer, customers and tables, and
    the last two to the shards of the pairs of two customers or more."""

    def run(batches):
        for shard, rows in _by_shard(batches):
            often = lay.value["often"]
            told = [(r["src"], *_read(r, often, 3)[1:4:2]) for r in rows[MESSAGE]]
            words, of = _numbered(np.concatenate([w for _, w, _ in told]))
            n, ones, many = (np.bincount(of, np.concatenate([x[i] for *_, x in told])).astype(np.int64) for i in range(3))
            customers, tau = ones + many, np.ones(len(words), np.int64)
            out = [_word_row(often, shard, words, [n, ones, customers, tau])]
            for src, w, x in told:
                at = _found(words, w[x[2] > 0])[0]
                if len(at):
                    out.append(_row(often, src, REPLY, shard, ints=[customers[at], tau[at]]))
            yield _emit(out)

    return rows.mapInArrow(run, ROW)


def _sweep_words(rows: DataFrame, m: dict, last: dict, k: int, lay) -> DataFrame:
    """The words with new numbers of tables in the unigram restaurant."""
    tables0 = last["tables"]

    def run(batches):
        for shard, rows in _by_shard(batches):
            if WORDS not in rows:
                continue
            often = lay.value["often"]
            _, words, _, (n, ones, _, tau, *kept), _ = _read(rows[WORDS][0], often, 4 + 2 * max(0, k - BURN_IN))
            customers, told = ones.copy(), []
            for r in rows.get(MESSAGE, []):
                _, w, _, (t,), _ = _read(r, often, 1)
                at = _found(words, w)[0]
                customers[at] += t  # each word once in a row
                told.append((r["src"], at))
            some = np.flatnonzero(customers > 1)
            new = np.ones(len(words), np.int64)
            new[some] = draw_tables(customers[some], np.full(len(some), m["uniform"]), tables0 - tau[some], m["d0"], stirling(m["d0"]),
                                    mix64(words[some]), k)
            ints = [n, ones, customers, new, *kept, *([customers, new] if k >= BURN_IN else [])]
            yield _emit([_word_row(often, shard, words, ints)]
                        + [_row(often, src, REPLY, shard, ints=[customers[at], new[at]]) for src, at in told])

    return rows.mapInArrow(run, ROW)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _sums(rows: DataFrame, kind: int, n: int) -> list[int]:
    got = _kind(rows, kind).agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n))).first()
    return [x or 0 for x in got]


def _kind(rows: DataFrame, *kinds: int) -> DataFrame:
    return rows.where(F.col("kind").isin(*kinds))


def learn(docs: DataFrame) -> tuple[DataFrame, dict]:
    """The table of pairs (u, w, c) and the model: discounts, counts, the
    shards of pairs and words after the last sweep and the totals after each
    sweep."""
    with _shuffles_dropped(docs.sparkSession):
        return _learn(docs)


def _learn(docs: DataFrame) -> tuple[DataFrame, dict]:
    lay = outline(docs)
    sent = docs.sparkSession.sparkContext.broadcast(lay)
    shards = _stored(_pair_shards(_pair_stripes(docs, sent, True), sent), "lm-pairs")
    n, one, two, alone = _sums(shards, PAIRS, 4)
    c_u, ones, children = _apart(shards, lay, 3)
    words = _stored(_first_words(_dealt(_kind(shards, MESSAGE)), sent), "lm-words")
    _drop(shards, MESSAGE)
    customers, tables, v, one0, two0 = _sums(words, WORDS, 5)
    model = {"docs": docs, "lay": lay, "n": n, "v": v, "contexts": alone + int((c_u > 0).sum()),
             "d1": _discount(one, two), "d0": _discount(one0, two0), "uniform": 1 / (v + 1)}
    inner = {k: model[k] for k in ("d1", "d0", "uniform")}  # what the workers need
    history = [{"customers": customers, "tables": tables, "apart": children}]
    state = shards
    for k in range(SWEEPS):
        last, old, before = history[-1], state, words
        state = _stored(_sweep_pairs(_dealt(_kind(state, STATE), _kind(words, REPLY)), inner, last, k, sent), "lm-state")
        _drop(old, *([STATE] if old is shards else []))
        words = _stored(_sweep_words(_dealt(_kind(words, WORDS), _kind(state, MESSAGE)), inner, last, k, sent), "lm-words")
        _drop(before)
        _drop(state, MESSAGE)
        customers, tables = _sums(words, WORDS, 2)
        history.append({"customers": customers, "tables": tables, "apart": ones + _apart(state, lay, 1)[0]})
    _drop(words, REPLY)
    kept = history[BURN_IN + 1:]
    model |= {"history": history, "shards": _kind(shards, PAIRS), "state": _kind(state, STATE), "words": _kind(words, WORDS),
              "apart": [c_u, *(h["apart"] for h in kept)]}
    model["info"] = _info(model, sent)
    _drop(state)
    model["state"] = _kind(model["info"], INFO)
    for k, h in enumerate(kept):
        h["contexts"] = _context_table(model, sent, k)
    return _pair_rows(model, sent), model


def _pair_rows(model: dict, lay) -> DataFrame:
    """u, w, c: each pair of a context and a token of the texts, with its
    number in the training texts (0 if only texts held out have it)."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                u, words, of, (c,), _ = _read(r, lay.value["often"], 1)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, words[of], c)], names=["u", "w", "c"])

    return model["shards"].mapInArrow(run, "u long, w long, c long")


def _seated(rows: dict, often: np.ndarray) -> tuple:
    """The pairs of a shard: u, words, numbers of the pairs' words, c and
    numbers of tables in the kept sweeps."""
    u, words, of, (c,), _ = _read(rows[PAIRS][0], often, 1)
    count = SWEEPS - BURN_IN
    tables = [np.minimum(c, 1) for _ in range(count)]
    if INFO in rows:
        seated = [unplanes(x, int((c > 1).sum())) for x in rows[INFO][0]["x"][-count:]]
    else:
        seated = _read(rows[STATE][0], often, 3 + count)[3][3:] if STATE in rows else []
    for t, got in zip(tables, seated):
        t[c > 1] = got
    return u, words, of, c, tables


def _context_table(model: dict, lay, k: int) -> DataFrame:
    """u, c_u, children: the contexts after a kept sweep."""

    def run(batches):
        for _, rows in _by_shard(batches):
            u, _, _, c, tables = _seated(rows, lay.value["often"])
            at = _starts(u)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                u[at].view(np.int64), np.add.reduceat(c, at), np.add.reduceat(tables[k], at))], names=["u", "c_u", "children"])

    return _dealt(model["shards"], model["state"]).mapInArrow(run, "u long, c_u long, children long") \
        .groupBy("u").agg(F.sum("c_u").alias("c_u"), F.sum("children").alias("children")).where("c_u > 0")


def _answers(model: dict, lay) -> DataFrame:
    """To each shard of pairs the counts of its words, and their customers and
    tables in the kept sweeps."""
    count = 1 + 2 * (SWEEPS - BURN_IN)

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                words = unpacked(r["w"], r["nw"], lay.value["often"])
                yield _emit(list(_messages(lay.value["often"], r["shard"], words, [], lay.value)))

    def answer(batches):
        for shard, rows in _by_shard(batches):
            often, words, known = lay.value["often"], np.zeros(0, np.uint64), [np.zeros(0, np.int64)] * count
            if WORDS in rows:
                _, words, _, (n, _, _, _, *kept), _ = _read(rows[WORDS][0], often, 3 + count)
                known = [n, *kept]
            for r in rows.get(MESSAGE, []):
                at, there = _found(words, _read(r, often, 0)[1])
                ints = [np.zeros(len(at), np.int64) for _ in known]
                for x, v in zip(ints, known):
                    x[there] = v[at[there]]
                yield _emit([_row(often, r["src"], REPLY, shard, ints=ints)])

    return _stored(_dealt(model["words"], model["shards"].mapInArrow(ask, ROW)).mapInArrow(answer, ROW), "lm-answers")


def _info(model: dict, lay) -> DataFrame:
    """For each shard what predictions need of its words and of the tables of
    its pairs, and the pairs that make up HOT of the tokens with their predictions."""
    count, often_c, inner = 1 + 2 * (SWEEPS - BURN_IN), max(1.0, model["n"] * HOT), _inner(model)

    def run(batches):
        for shard, rows in _by_shard(batches):
            often = lay.value["often"]
            u, words, of, c, tables = _seated(rows, often)
            info, hot = _replies(rows[REPLY], words, count, lay.value), c >= often_c
            out = [_row(often, shard, INFO, ints=info, raw=[planes(t[c > 1]) for t in tables])]
            if hot.any():
                p, _ = _predicted(u, c, tables, [x[of] for x in info], inner, lay.value)
                some, at = _numbered(of[hot])
                out.append(_row(often, shard, HOTTEST, u=u[hot], w=words[some], of=at, ints=[info[0][of[hot]]],
                                raw=[p[hot].tobytes()]))
            yield _emit(out)

    answers = _answers(model, lay)
    out = _stored(_dealt(model["shards"], model["state"], answers).mapInArrow(run, ROW), "lm-info")
    _drop(answers)
    return out


def _inner(model: dict) -> dict:
    return {k: model[k] for k in ("d1", "d0", "uniform", "apart")} \
        | {"history": [{k: h[k] for k in ("customers", "tables")} for h in model["history"][BURN_IN + 1:]]}


def _predicted(u: np.ndarray, c: np.ndarray, tables: list, info: list, m: dict, lay: dict) -> tuple:
    """Averaged P(w | u) of pairs, and P(w) in each kept seating."""
    place, apart = _found(lay["apart"], u)
    c_u, *children = (_of_context(u, x) for x in (c, *tables))
    for mine, all_parts in zip((c_u, *children), m["apart"]):
        mine[apart] = all_parts[place[apart]]
    p0 = [(info[1 + 2 * k] - m["d0"] * info[2 + 2 * k] + (THETA + m["d0"] * h["tables"]) * m["uniform"])
          / (THETA + h["customers"]) for k, h in enumerate(m["history"])]
    weight = [(THETA + m["d1"] * x) / (THETA + c_u) for x in children]
    return (c - m["d1"] * sum(tables) / len(tables)) / (THETA + c_u) \
        + sum(a * b for a, b in zip(weight, p0)) / len(tables), p0


def _of_final(rows: dict, m: dict, lay: dict) -> tuple:
    """u, w, c, n, p and p0 of the pairs of a shard."""
    u, words, of, c, tables = _seated(rows, lay["often"])
    info = [x[of] for x in _read(rows[INFO][0], lay["often"], 1 + 2 * len(tables))[3]]
    return u, words[of], c, info[0], *_predicted(u, c, tables, info, m, lay)


def pair_predictions(pairs: DataFrame, model: dict) -> DataFrame:
    """u, w, c, n (the word's count), p (averaged P(w | u)) and p0 (P(w) in
    each kept seating) of those of the model's pairs that are in ``pairs``."""
    lay, m = pairs.sparkSession.sparkContext.broadcast(model["lay"]), _inner(model)

    def run(batches):
        for _, rows in _by_shard(batches):
            u, w, c, n, p, p0 = _of_final(rows, m, lay.value)
            seats = pa.ListArray.from_arrays(pa.array(np.arange(len(u) + 1) * len(p0), pa.int32()), pa.array(np.array(p0).T.ravel()))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (u.view(np.int64), w.view(np.int64), c, n, p)), seats],
                                             names=["u", "w", "c", "n", "p", "p0"])

    return _dealt(model["shards"], model["state"]) \
        .mapInArrow(run, "u long, w long, c long, n long, p double, p0 array<double>") \
        .join(pairs.select("u", "w"), ["u", "w"], "left_semi")


def predictions(pairs: DataFrame, model: dict) -> DataFrame:
    """One row for each known word: w, n, us, cs, ps (its contexts, counts and
    predictions in them) and p0."""
    return pair_predictions(pairs, model).where("c > 0").groupBy("w", "n", "p0") \
        .agg(F.collect_list(F.struct("u", "c", "p")).alias("r")) \
        .select("w", "n", F.col("r.u").alias("us"), F.col("r.c").alias("cs"), F.col("r.p").alias("ps"), "p0")


def _extended(docs: DataFrame, model: dict, lay) -> dict:
    """The model with the pairs of other texts, which have no customers."""
    both = _pair_stripes(docs, lay, False).unionByName(model["shards"])
    with _shuffles_dropped(docs.sparkSession):
        pairs = _stored(_pair_shards(both, lay), "lm-pairs")
        _drop(pairs, MESSAGE, STATE, APART)
        model = model | {"docs": docs, "shards": _kind(pairs, PAIRS)}
        info = _info(model, lay)
        return model | {"info": info, "state": _kind(info, INFO)}


def score(docs: DataFrame, pairs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    n, v, lay = model["n"], model["v"], spark.sparkContext.broadcast(model["lay"])
    if not docs.sameSemantics(model["docs"]):  # pairs that the model has not met
        model = _extended(docs, model, lay)
    inner = _inner(model)
    hot = [(u, w[of], k, np.frombuffer(p[0])) for u, w, of, (k,), p in (  # at most 1 / HOT pairs
        _read(r.asDict(), model["lay"]["often"], 1) for r in _kind(model["info"], HOTTEST).collect())]
    hot = [np.concatenate(x) for x in zip(*hot)] if hot else [np.zeros(0, t) for t in (np.uint64, np.uint64, float, float)]
    key = pair_hash(hot[1], hot[0])
    order = np.argsort(key)
    log_base = lambda c: np.log10((c + 1) / (n + v + 1))
    known = spark.sparkContext.broadcast((key[order], np.log10(hot[3])[order], log_base(hot[2].astype(float))[order]))
    # names a row's content; repeated rows share their sums
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))

    def split(batches):
        """A row of the sums over each text's hot pairs, and rows of its other pairs to their shards."""
        keys, p, base = known.value
        held, texts = [], 0
        for batch in _batches(batches):
            w, counts = tokens(batch.column("text"))
            u, doc = contexts(w, counts), np.repeat(np.arange(len(counts)), counts)
            pair, key = pair_hash(w, u), batch.column("key").to_numpy()
            at, is_hot = _found(keys, pair)
            sums = lambda x: np.bincount(doc[is_hot], x, len(counts)).astype(float)  # noqa: E731, B023
            ids = batch.column("doc_id")
            yield _emit([_row(lay.value["often"], key[0] % lay.value["shards"], EASY, ints=[counts, sums(None).astype(np.int64)], raw=[
                ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), ids.fill_null(0).to_numpy().tobytes(), key.tobytes(),
                sums(base[at[is_hot]]).tobytes(), sums(p[at[is_hot]]).tobytes()])])
            rest = np.flatnonzero(~is_hot)
            name = mix64(pair[rest]) ^ mix64(doc[rest].astype(np.uint64))
            order = np.argsort(name)
            first = _starts(name[order])
            i, times = rest[order[first]], np.diff(np.append(first, len(rest)))
            held.append((pair[i], *(x.astype(np.int32) for x in (_shard_of(u[i], w[i], lay.value), doc[i] + texts, times)), key))
            texts += len(counts)
            if sum(len(x[0]) for x in held) > 1_500_000:
                yield from emit(held)
                texts = 0
        if held:
            yield from emit(held)

    def emit(held):
        pair, shard, doc, times, keys = (np.concatenate(x) for x in zip(*held))
        held.clear()
        for r in _split(shard, np.argsort(pair)):
            mine, at = _numbered(doc[r])
            yield _emit([_row(lay.value["often"], shard[r[0]], TOKENS, ints=[at, times[r]], raw=[
                planes(np.diff(pair[r], prepend=np.uint64(0)).view(np.int64)), keys[mine].tobytes()])])

    def logs(rows):
        """Ascending hashes of a shard's pairs, numbers of their words, log P(w | u); counts of the words."""
        u, words, of, c, tables = _seated(rows, lay.value["often"])
        info, log_p = _read(rows[INFO][0], lay.value["often"], 1 + 2 * len(tables))[3], np.empty(len(u))
        at = _starts(u)
        cuts = np.unique(at[np.searchsorted(at, np.arange(0, len(u), 100_000), side="right") - 1])
        for a, b in zip(cuts, [*cuts[1:], len(u)]):  # whole contexts at a time: less memory
            p, _ = _predicted(u[a:b], c[a:b], [t[a:b] for t in tables], [x[of[a:b]] for x in info], inner, lay.value)
            log_p[a:b] = np.log10(p)
        del c, tables
        pair = pair_hash(words[of], u)
        order = np.argsort(pair)
        return pair[order], of[order], log_p[order], info[0]

    def looked_up(batches):
        sums, held = [], 0
        for _, rows in _by_shard(batches):
            for r in rows.get(EASY, []):
                _, _, _, (counts, n_known), (valid, *raw) = _read(r, lay.value["often"], 2)
                ids, keys, base, p = (np.frombuffer(x, t) for x, t in zip(raw, (np.int64, np.int64, float, float)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, mask=~np.frombuffer(valid, bool)), pa.array(keys), pa.array(counts), pa.array(n_known),
                    pa.array(base), pa.array(p)], names=names)
            if TOKENS not in rows:
                continue
            pair, of, log_p, counts = logs(rows)
            known, base = counts > 0, log_base(counts.astype(float))
            for r in rows[TOKENS]:
                *_, (doc, times), (steps, keys) = _read(r, lay.value["often"], 2)
                at = _found(pair, np.cumsum(unplanes(steps, r["n"]).view(np.uint64)))[0]
                keys = np.frombuffer(keys, np.int64)
                sums.append((keys, *(np.bincount(doc, times * x, len(keys)) for x in (known[of[at]], base[of[at]], log_p[at]))))
                held += len(keys)
            del pair, of, log_p, counts, base, rows
            if held > 1_000_000:
                sums = [summed(sums)]
                held = len(sums[0][0])
                if held > 500_000:
                    yield out(sums[0])
                    sums, held = [], 0
        if sums:
            yield out(summed(sums))

    def summed(parts):
        keys, at = _numbered(np.concatenate([x[0] for x in parts]))
        return keys, *(np.bincount(at, np.concatenate([x[i] for x in parts])) for i in (1, 2, 3))

    def out(sums):
        none = pa.nulls(len(sums[0]), pa.int64())
        return pa.RecordBatch.from_arrays([none, pa.array(sums[0]), none, pa.array(sums[1].astype(np.int64)), pa.array(sums[2]),
                                           pa.array(sums[3])], names=names)

    names = ["doc_id", "key", "n_tokens", "n_known", "base_score", "score"]
    met = _dealt(model["shards"], model["state"], rows.mapInArrow(split, ROW))
    parts = met.mapInArrow(looked_up, "doc_id long, key long, n_tokens long, n_known long, base_score double, score double")
    copies = F.count("n_tokens")  # one in each row of a text's hot pairs
    each = lambda c: (F.sum(c) / copies).alias(c)
    return parts.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), copies.cast("int").alias("copies"),
        each("n_known"), each("base_score"), each("score")) \
        .withColumn("_copy", F.explode(F.expr("sequence(1, copies)"))).select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), "n_tokens", F.col("n_known").cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), "base_score", "score")


def perplexity(scored: DataFrame, *by: str) -> DataFrame:
    """Perplexity per token of scored documents, by the given columns."""
    return scored.groupBy(*by).agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"),
                                   F.pow(F.lit(10.0), -F.sum("base_score") / F.sum("n_tokens")).alias("base_perplexity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *learn(docs))
