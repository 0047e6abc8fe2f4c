"""Quality classifier: positive-unlabelled learning with the non-negative
unbiased risk.

Only trusted positives (labels.quality = 1) of the training fold are used as
labels; the other class is never shown.  With class prior p, positives P and
unlabelled rows U, a linear model f minimises

    p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)]),   l(z) = log(1 + exp(-z)),

and where the bracket is negative the step goes against it.  The prior is
estimated first, from the scores of a plain P-against-U model on rows it was
not fitted on: U holds at least a share p of whatever region P fills, so p is
at most the least ratio of the two shares over the top-score regions.

Features are taken from the whole text's bytes and words: shares of letters,
cases, digits, white space and each punctuation mark, word lengths, repeated
words, repeated neighbours and repeated lines.  Labels, lang, source and
doc_id are never features.  The model is fitted on a bounded sample, the first
MOST_POSITIVE positives and MOST_UNLABELLED rows of the training fold in hash
order; every row is scored.

Defined cases: a null text counts as empty and gets the score of the empty
text; labels that are null, contradictory or for unknown documents are not
trusted; without trusted positives every score is 0.5; repeated rows are
scored each; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import slices, table, utf8, word_hashes

MOST_POSITIVE = MOST_UNLABELLED = 20_000
FOLDS, HELD_OUT = 3, 1
_CLASSES = np.zeros((256, 8 + 33), np.float64)
_CLASSES[65:91, 0] = _CLASSES[97:123, 1] = _CLASSES[48:58, 2] = _CLASSES[128:, 3] = 1
_CLASSES[[32, 9], 4] = _CLASSES[[10, 13], 5] = 1
_CLASSES[:9, 6] = _CLASSES[14:32, 6] = _CLASSES[[11, 12, 127], 7] = 1
for _k, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _CLASSES[_c, 8 + _k] = 1
N_FEATURES = _CLASSES.shape[1] + 8


def features(texts: pa.Array) -> np.ndarray:
    """One row of N_FEATURES numbers per text."""
    data, offsets = utf8(texts)
    words, counts = word_hashes(texts)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((len(counts), N_FEATURES))
    n = _CLASSES.shape[1]
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        text, w = data[a:b], words[bounds[k]:bounds[k + 1]]
        if not len(text):
            continue
        out[k, :n] = np.sqrt(np.bincount(text, minlength=256) @ _CLASSES / len(text))
        out[k, n] = np.log1p(len(text))
        lines = np.array([hash(x) for x in text.tobytes().split(b"\n") if x])
        out[k, n + 1] = 1 - len(np.unique(lines)) / max(1, len(lines))
        if len(w):
            same = np.sort(w)
            runs = np.diff(np.concatenate([[0], np.flatnonzero(same[1:] != same[:-1]) + 1, [len(w)]]))
            out[k, n + 2:] = [np.log1p(len(w)), len(text) / len(w) / 10, len(runs) / len(w), runs.max() / len(w),
                              (w[1:] == w[:-1]).mean() if len(w) > 1 else 0, np.sqrt((runs == 1).sum() / len(w))]
    return out


def _descend(grad, size: int, steps: int = 600, rate: float = 0.05) -> np.ndarray:
    """Adam on a full-batch gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _decay(p: np.ndarray) -> float:
    """Weight of the squared norm: the fewer positives, the more."""
    return 1e-3 + 1 / max(1, len(p))


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among ``u``, from positives ``p``."""
    x, y = np.concatenate([p[::2], u[::2]]), np.concatenate([np.ones(len(p[::2])), np.zeros(len(u[::2]))])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = _descend(lambda w: x.T @ (weight * (_sigmoid(x @ w) - y)) + _decay(p) * w, x.shape[1])
    sp, su = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0, 0.5, 51))
    in_p, in_u = 1 - np.searchsorted(sp, cuts) / len(sp), 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(20) / 2 / len(su)) + np.sqrt(np.log(20) / 2 / len(sp))
    at = np.argmin((in_u + slack) / in_p)
    return float(np.clip(in_u[at] / in_p[at], 0.05, 0.98))


def fit(p: np.ndarray, u: np.ndarray) -> dict:
    """Model from feature rows of trusted positives and unlabelled rows."""
    if not len(p) or not len(u):
        return {"mean": np.zeros(N_FEATURES), "std": np.ones(N_FEATURES), "w": np.zeros(N_FEATURES + 1), "prior": None}
    mean, std = u.mean(axis=0), u.std(axis=0) + 1e-3
    p, u = (_scaled(x, mean, std) for x in (p, u))
    prior = estimate_prior(p, u)

    def grad(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        on_p = -prior * (p.T @ _sigmoid(-fp)) / len(p)
        on_n = (u.T @ _sigmoid(fu)) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        risk_n = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        decay = _decay(p) * w
        return on_p + on_n + decay if risk_n >= 0 else decay - on_n

    return {"mean": mean, "std": std, "w": _descend(grad, N_FEATURES + 1), "prior": prior}


def _scaled(x: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.hstack([np.clip((x - mean) / std, -5, 5), np.ones((len(x), 1))])


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    return _sigmoid(_scaled(x, model["mean"], model["std"]) @ model["w"])


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(HELD_OUT))


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the bounded samples of positives and unlabelled rows."""
    trusted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id") \
        .agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = 1 AND hi = 1").select("doc_id")
    ids = docs.select("doc_id").where(fold(F.col("doc_id")) != HELD_OUT).distinct()
    first = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = first(ids.join(trusted, "doc_id", "left_semi"), MOST_POSITIVE).select("doc_id", F.lit(1).alias("p")) \
        .unionByName(first(ids, MOST_UNLABELLED).select("doc_id", F.lit(0).alias("p"))) \
        .groupBy("doc_id").agg(F.max("p").alias("p"), F.min("p").alias("q"))
    picked = F.broadcast(picked)  # at most MOST_POSITIVE + MOST_UNLABELLED rows

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                x = features(batch.column("text")).astype(np.float32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("p"), batch.column("q"), batch.column("k"),
                    pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "p", "q", "k", "x"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("k")).join(picked, "doc_id") \
        .mapInArrow(run, "doc_id long, p int, q int, k long, x binary") \
        .groupBy("doc_id", "p", "q").agg(F.min_by("x", "k").alias("x")).orderBy("doc_id").toPandas()
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]]).astype(float) if len(rows) else np.zeros((0, N_FEATURES))
    order = np.argsort([int(i) * 0x9E3779B97F4A7C15 % (1 << 64) for i in rows["doc_id"]], kind="stable") if len(rows) else []
    p, q, x = rows["p"].to_numpy()[order], rows["q"].to_numpy()[order], x[order]
    return x[p == 1], x[q == 0]


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with score and predicted (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*(F.col(f"`{c}`") for c in keep))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                s = predict(model, features(batch.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in keep), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    names=[*keep, "score", "predicted"])

    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    return fit(*training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "quality")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", "predicted")
