"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct 5-word shingles (64-bit hashes).  Equal
sets form a class; everything after works on one row per class.  A class's
signature has 40 minima of 16 bits.  Two signatures that differ in at most 19
of 40 places must agree, by the pigeonhole principle, in all but one place of
one of their 10 chunks of 4 places; so each chunk is indexed under its 4 keys
that leave one place out, and classes that share a key are all pairs within
that distance.  (At a similarity of 0.75 the distance exceeds 19 in 0.06
percent of pairs, at 0.8 in 0.002 percent.)  Pairs within the distance are confirmed
on their full sets.

Only connections matter for the components, so the pairs are confirmed in two
rounds, without ever listing the pairs of a group of copies: first each key's
members against one hub of the key (a star: one pair per member; keys choose
their hubs by HUB_ORDERS different orders, so a group has several); then every
pair of members that the first round left in different components.  The second
round compares members where they meet, in blocks of CHUNK, by their bottom-k
sketches (the LOW smallest shingle hashes; the whole set if it has no more),
and only pairs that the sketches do not refute are confirmed.  The sketches
decide clear cases only, six standard deviations away: a pair at a similarity
of 0.75 is refuted wrongly with probability 7e-9 if its texts have more than
LOW shingles, never if they have fewer.

Defined cases: a null or empty text has no shingles and links with nothing; a
text of 1 to 4 words is one shingle; rows without doc_id link with nothing and
are kept; repeated rows (and equal texts) share a class, only rows of its
smallest doc_id are kept; rows of one doc_id with different texts are compared
as different texts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import (blocks_of, connected_components, mix64, pack, pair_blocks, pairs_in_groups, slices,
                                   stored, table, unpack, word_hashes)

WORDS, PLACES, CHUNKS = 5, 40, 10
PER_CHUNK = PLACES // CHUNKS
DISTANCE = 2 * CHUNKS - 1      # one error may be allowed in each chunk
SIMILAR = 75                   # percent
CHUNK = 2048                   # members compared in one block
HUB_ORDERS = 8
LOW, LEAST, MARGIN = 256, SIMILAR / 100 - 6 * (0.75 * 0.25 / 256) ** 0.5, 0.01
_rng = np.random.default_rng(20240229)
_ORDER = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64)


def shingles(texts: pa.Array):
    """For each text the sorted array of its distinct shingle hashes."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(len(words))       # words from here to the text's end
    n = np.repeat(counts, counts)
    is_start = (left >= WORDS) | ((left == n) & (n < WORDS))
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    total = np.minimum(left, WORDS).astype(np.uint64) * _ORDER[WORDS]
    for k in range(WORDS):
        total += np.where(left > k, padded[k:k + len(words)], np.uint64(0)) * _ORDER[k]
    total = mix64(total)[is_start]
    upto = np.concatenate([[0], np.cumsum(is_start)])
    bounds = upto[np.concatenate([[0], ends])]
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(total[a:b])


def class_of(hashes: np.ndarray) -> int:
    """One signed 64-bit name for a set."""
    if not len(hashes):
        return 0
    total = int(mix64(hashes ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)) + len(hashes) * 0xE7037ED1A0B428DB
    return int(mix64(np.array([total % (1 << 64)], np.uint64)).view(np.int64)[0])


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at:at + 4096, None] * _MUL + _ADD
        np.minimum(low, block.min(axis=0), out=low)
    return (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)


def content_key() -> Column:
    """Names a row's id and text; equal for repeated rows only."""
    return F.xxhash64("doc_id", "text")


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key, cls, n_shingles, sig (array<short>; null without
    shingles) and low (the upper 32 bits of its LOW smallest hashes)."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = list(shingles(batch.column("text")))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("key"), pa.array([class_of(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int16())),
                    pa.array([(s[:LOW] >> np.uint64(32)).astype(np.uint32).tobytes() for s in sets], pa.binary())],
                    names=["doc_id", "key", "cls", "n_shingles", "sig", "low"])

    return docs.select("doc_id", "text", content_key().alias("key")) \
        .mapInArrow(run, "doc_id long, key long, cls long, n_shingles long, sig array<short>, low binary")


def chunk_keys(classes: DataFrame) -> DataFrame:
    """(key, cls): for each chunk and each place left out of it, one key; its
    lowest 6 bits name them."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column("sig").flatten().to_numpy().view(np.uint16).reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
            out = np.empty((len(sig), CHUNKS, PER_CHUNK), np.uint64)
            for skip in range(PER_CHUNK):
                packed = np.zeros((len(sig), CHUNKS), np.uint64)
                for place in range(PER_CHUNK):
                    if place != skip:
                        packed = (packed << np.uint64(16)) | sig[:, :, place]
                tag = (np.arange(CHUNKS) * PER_CHUNK + skip).astype(np.uint64)
                out[:, :, skip] = (mix64(packed ^ mix64(tag)) & ~np.uint64(63)) | tag
            cls = np.repeat(batch.column("cls").to_numpy(), PLACES)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(cls)], names=["key", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "key long, cls long")


def confirm(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""
    pairs = stored(pairs, "dup-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    reps = classes.join(ids, "cls", "left_semi").select("cls", F.col("rep").alias("doc_id"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                sets = list(shingles(batch.column("text")))
                yield pa.RecordBatch.from_arrays([
                    batch.column("cls"), pa.array([class_of(s) for s in sets], pa.int64()),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["cls", "own", "members"])

    sets = docs.select("doc_id", "text").join(reps, "doc_id").select("cls", "text") \
        .mapInArrow(run, "cls long, own long, members array<long>").where("cls = own").select("cls", "members")
    sets = stored(sets.dropDuplicates(["cls"]), "dup-sets")
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("members").alias(f"m{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    common = F.size(F.array_intersect("ma", "mb"))
    return both.select("a", "b", common.alias("n"), (F.size("ma") + F.size("mb")).alias("m")) \
        .where(100 * F.col("n") >= SIMILAR * (F.col("m") - F.col("n"))).select("a", "b")


def near(a: Column, b: Column) -> Column:
    """Signatures within DISTANCE, of (cls, sig, n) structs whose sizes allow
    the similarity."""
    differ = F.size(F.filter(F.zip_with(a["sig"], b["sig"], lambda x, y: x != y), lambda x: x))
    sizes = F.least(a["n"], b["n"]) * 100 >= F.greatest(a["n"], b["n"]) * SIMILAR
    return sizes & (differ <= DISTANCE)


def first_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first key (chunk * PER_CHUNK + place left out) that the signatures
    x and y (pairs, PLACES) share."""
    same = (x == y).reshape(len(x), CHUNKS, PER_CHUNK)
    chunk = (same.sum(axis=2) >= PER_CHUNK - 1).argmax(axis=1)
    return chunk * PER_CHUNK + same[np.arange(len(x)), chunk].argmin(axis=1)  # all equal: place 0


def sketch_allows(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Whether bottom-k sketches (pairs, LOW), padded with the largest value,
    leave a similarity of SIMILAR possible."""
    pad = np.iinfo(np.uint32).max
    z = np.sort(np.concatenate([x, y], axis=1), axis=1)
    real = z != pad
    new = real.copy()
    new[:, 1:] &= z[:, 1:] != z[:, :-1]
    within = np.cumsum(new, axis=1, dtype=np.int32)
    whole = (nx <= LOW) & (ny <= LOW)
    most = np.where(whole, 2 * LOW, LOW)[:, None]
    union = np.minimum(within[:, -1], most[:, 0])
    common = (real & ~new & (within <= most)).sum(axis=1)
    return common >= np.where(whole, SIMILAR / 100 - MARGIN, LEAST) * union


def cross_pairs(members: DataFrame) -> DataFrame:
    """(key, cls, comp, n, sig, low) -> pairs of classes of one key that are in
    different components, within the distance, not refuted by their sketches
    and meet under this key first."""

    def run(batches):
        for t, sizes in blocks_of(batches, ["key", "_bi", "_bj"], 16384):
            col = {c: t.column(c).to_numpy() for c in ("key", "cls", "comp", "n", "_bi", "_bj", "_c")}
            sig = t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, PLACES)
            low = np.full((len(sig), LOW), np.iinfo(np.uint32).max, np.uint32)
            for k, v in enumerate(t.column("low").to_pylist()):
                v = np.frombuffer(v, np.uint32)
                low[k, :len(v)] = v
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in pairs_in_groups(sizes, 200_000):
                ok = (col["comp"][i] != col["comp"][j]) & ((col["_c"][i] != col["_c"][j]) | (col["_bi"][i] == col["_bj"][i]))
                ok &= np.minimum(col["n"][i], col["n"][j]) * 100 >= np.maximum(col["n"][i], col["n"][j]) * SIMILAR
                i, j = i[ok], j[ok]
                ok = (sig[i] != sig[j]).sum(axis=1) <= DISTANCE
                i, j = i[ok], j[ok]
                ok = first_key(sig[i], sig[j]) == (col["key"][i] & 63)
                i, j = i[ok], j[ok]
                for at in range(0, len(i), 8192):
                    x, y = i[at:at + 8192], j[at:at + 8192]
                    ok = sketch_allows(low[x], low[y], col["n"][x], col["n"][y])
                    a.append(col["cls"][x[ok]])
                    b.append(col["cls"][y[ok]])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = pair_blocks(members, ["key"], "cls", CHUNK)
    return dealt.repartition("key", "_bi", "_bj").sortWithinPartitions("key", "_bi", "_bj") \
        .select("key", "_bi", "_bj", "_c", "cls", "comp", "n", "sig", "low").mapInArrow(run, "a long, b long").distinct()


def link_classes(classes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of classes, enough of them to join every component."""
    keys = chunk_keys(classes)
    order = F.xxhash64("cls", F.pmod("key", F.lit(HUB_ORDERS)))
    hubs = keys.groupBy("key").agg(F.min_by("cls", order).alias("hub"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    shared = stored(keys.join(hubs.where("lo < hi").select("key", "hub"), "key"), "dup-keys")
    info = classes.select("cls", F.col("n_shingles").alias("n"), "sig")
    tagged = lambda c: info.select(F.col("cls").alias(c), F.struct("sig", "n").alias(f"i{c}"))
    star = shared.where("cls <> hub").select(F.least("hub", "cls").alias("a"), F.greatest("hub", "cls").alias("b")).distinct() \
        .join(tagged("a"), "a").join(tagged("b"), "b").where(near(F.col("ia"), F.col("ib"))).select("a", "b")
    first = stored(confirm(star, classes, docs), "dup-links")
    comp = connected_components(first).select(F.col("node").alias("cls"), F.col("root").alias("comp"))
    placed = stored(shared.select("key", "cls").join(comp, "cls", "left")
                    .withColumn("comp", F.coalesce("comp", "cls")), "dup-placed")
    open_keys = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    members = stored(placed.join(open_keys, "key", "left_semi").join(info, "cls"), "dup-members")
    low = rows.select("cls", "low").join(members.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"])
    members = members.join(low, "cls")
    second = stored(confirm(cross_pairs(members), classes, docs), "dup-links")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, key (see content_key), cls, n_shingles,
    root (names the group; null for a row that links with nothing by
    definition), component_id, kept."""
    rows = stored(sketch(docs), "dup-sketch")
    classes = stored(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "dup-classes")
    comp = connected_components(link_classes(classes, rows, docs)).select(F.col("node").alias("cls"), "root")
    named = classes.select("cls", "rep").join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("cls", "root", "component_id")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return rows.drop("sig", "low").join(named, "cls", "left").withColumn("root", F.when(~alone, F.col("root"))) \
        .withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: of the rows with the group's
    smallest doc_id, the one with the smallest key."""
    rows = near_duplicates(docs)
    chosen = rows.where("kept AND root IS NOT NULL").groupBy("root").agg(F.min("key").alias("_key")).select("_key", F.lit(True).alias("_one"))
    alone = rows.where("root IS NULL").select(F.col("key").alias("_key"), F.lit(False).alias("_one")).distinct()
    keys = stored(chosen.unionByName(alone), "dup-kept")
    found = pack(docs, content_key().alias("_key")).join(keys, "_key")
    # repeated rows are the only ones that share a key
    repeated = rows.where("root IS NOT NULL").groupBy(F.col("key").alias("_key")).count().where("count > 1").select("_key")
    repeated = stored(repeated, "dup-repeated")
    once = found.join(repeated, "_key", "left_anti")
    more = found.where("_one").join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
    return unpack(once.unionByName(more), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE
         w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
