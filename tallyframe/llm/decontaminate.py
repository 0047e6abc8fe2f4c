"""Benchmark decontamination: word windows of benchmark items found in the
training documents, and the spans or documents that hold them removed.

A window is WINDOW consecutive words of an item, or a shorter item's whole
sequence.  The items' windows form a hash set that is broadcast to the scan
of the documents: every window of a document's words is looked up by hash,
and each hit is verified byte by byte against the window's words.  The set's
size is counted before: beyond MOST_WINDOWS rows or MOST_BYTES it is cut by
hash into parts of that size on average, and the scans of the parts follow one
another, each adding its hits to the rows, so that nothing is left out.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
lower-cased.

Defined cases: a null or empty text, or one without words, has no words and no
hit; an item without words has no window; items are told apart by item_id as a
string, null counting as the empty string, so rows with one item_id are one
item; repeated documents give repeated rows; other columns are kept and do not
clash; an empty benchmark hits nothing, an empty table gives an empty result.
A text of any length is scanned whole, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import mix64, pack, slices, stored, table, unpack, utf8, word_hashes

WINDOW = 10
# the broadcast's bound: (window, item) rows and bytes of windows of a part, on
# average over the parts, which are cut by a uniform hash
MOST_WINDOWS, MOST_BYTES = 1 << 20, 64 << 20
CHAIN = 4  # parts looked up in one stage; its documents are written before the next
_NORMAL = np.full(256, 0x20, np.uint8)
_NORMAL[0x30:0x3A], _NORMAL[0x61:0x7B], _NORMAL[0x80:] = np.arange(0x30, 0x3A), np.arange(0x61, 0x7B), np.arange(0x80, 0x100)
_NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
_STEP = np.uint64(0x9E3779B97F4A7C55)
SPANS = "array<struct<start:int,end:int>>"


class Words:
    """The words of a text column: hashes, byte ranges, and each word's text."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = utf8(column)
        normal = _NORMAL[self.data]
        texts = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(self.offsets.astype(np.int64)), pa.py_buffer(normal))
        self.hashes, self.counts = word_hashes(texts)
        self.ends = np.cumsum(self.counts)        # of each text, in words
        self.starts = self.ends - self.counts
        inside = np.zeros(len(normal) + 1, bool)
        inside[:-1] = normal != 0x20
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        edges = self.offsets[1:-1][self.offsets[1:-1] < len(normal)]
        opens[edges] = inside[edges]              # a word never reaches into the next text
        self.first = np.flatnonzero(opens)
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | opens[1:]
        self.last = np.flatnonzero(closes) + 1
        self.normal, self.inside = normal, inside[:-1]

    def left(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.ends, self.counts) - np.arange(len(self.hashes))

    def windows(self, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The hash of the window of each length that begins at each word
        (those that reach beyond their text too)."""
        n, h = len(self.hashes), np.zeros(len(self.hashes), np.uint64)
        for k in range(1, max(lengths, default=0) + 1):
            if n < k:
                return
            h = h[:n - k + 1] * _STEP + self.hashes[k - 1:]
            if k in lengths:
                yield k, mix64(h + np.uint64(k))

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """All words with one space after each, and where each begins."""
        size = self.last - self.first
        at = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(at[-1], 0x20, np.uint8)
        kept = self.normal[self.inside]
        out[np.arange(len(kept)) + np.repeat(np.arange(len(size)), size)] = kept
        return out, at


# ---------------------------------------------------------------- hash set


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(hash, k, words, item) of every window of every item."""
    def find(batches):
        for batch in batches:
            for part in slices(batch):
                w = Words(part.column("text"))
                short = np.repeat(w.counts, w.counts)
                text, at = w.joined()
                for k, h in w.windows(list(range(1, window + 1))):
                    i = np.flatnonzero((w.left()[:len(h)] >= k) & ((k == window) | (short[:len(h)] == k)))
                    if len(i):
                        whole = text.tobytes()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(h[i].view(np.int64)), pa.array(np.full(len(i), k, np.int32)),
                            pa.array([whole[at[j]:at[j + k] - 1].decode() for j in i], pa.string()),
                            part.column("item").take(pa.array(np.searchsorted(w.ends, i, side="right")))],
                            ["hash", "k", "words", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInArrow(find, "hash long, k int, words string, item string").distinct()


class HashSet:
    """Windows by ascending hash, their words, and the items of each."""

    def __init__(self, rows: pa.Table):
        names = rows.column("item").combine_chunks().dictionary_encode()
        self.items = sorted(names.dictionary.to_pylist())
        rank = {name: i for i, name in enumerate(self.items)}
        item = np.array([rank[x] for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] \
            if rows.num_rows else np.zeros(0, np.int64)
        rows = rows.append_column("rank", pa.array(item)).sort_by([("hash", "ascending"), ("words", "ascending")])
        h = rows.column("hash").to_numpy().view(np.uint64)
        words, k = rows.column("words").to_pylist(), rows.column("k").to_numpy()
        order = np.argsort(h, kind="stable")      # ascending as unsigned; equal hashes keep their words together
        new = np.array([i == 0 or h[a] != h[order[i - 1]] or words[a] != words[order[i - 1]] for i, a in enumerate(order)], bool)
        at = np.flatnonzero(new)
        self.ranks, self.rank_at = rows.column("rank").to_numpy()[order], np.concatenate([at, [len(order)]])
        self.hashes, self.k = h[order[at]], k[order[at]]
        data = [words[a].encode() for a in order[at]]
        self.at = np.concatenate([[0], np.cumsum([len(x) for x in data], dtype=np.int64)]).astype(np.int64)
        self.words = np.frombuffer(b"".join(data), np.uint8)
        self.lengths = sorted(set(self.k.tolist()))
        bits = max(16, int(np.ceil(np.log2(16 * len(self.hashes) + 1))))
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)    # most windows end here: one look-up
        self.maybe[self.hashes & self.mask] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, window) of every verified occurrence."""
        left, found = None, []
        for k, h in w.windows(self.lengths):
            i = np.flatnonzero(self.maybe[h & self.mask])
            if not len(i):
                continue
            left = w.left() if left is None else left
            i = i[left[i] >= k]
            at, to = (np.searchsorted(self.hashes, h[i], side=s) for s in ("left", "right"))
            many = to - at                        # more than one only where hashes clash
            i, j = np.repeat(i, many), np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append((i[self.k[j] == k], j[self.k[j] == k]))
        if not any(len(i) for i, _ in found):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i, j = (np.concatenate(x) for x in zip(*found))
        return self._verified(w, i, j)

    def _verified(self, w: Words, i: np.ndarray, j: np.ndarray, most: int = 1 << 22):
        text, at = w.joined()
        size = at[i + self.k[j]] - 1 - at[i]
        same = size == self.at[j + 1] - self.at[j]
        i, j, size = i[same], j[same], size[same]
        ok, upto, a = np.ones(len(i), bool), np.cumsum(size), 0
        while a < len(i):                         # blocks of bounded bytes
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
            n = size[a:b]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            differ = text[np.repeat(at[i[a:b]], n) + inner] != self.words[np.repeat(self.at[j[a:b]], n) + inner]
            ok[a:b] = np.bincount(np.repeat(np.arange(b - a), n), differ, b - a) == 0
            a = b
        return i[ok], j[ok]


def hash_sets(benchmark: DataFrame, window: int = WINDOW) -> Iterator[HashSet]:
    """The hash set, in as many parts as its bound asks for."""
    rows = stored(item_windows(benchmark, window), "decontaminate-windows")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words").cast("bigint")), F.lit(0))).first()
    parts = max(1, -(-n // MOST_WINDOWS), -(-size // MOST_BYTES))
    for p in range(parts):
        yield HashSet(rows.where(F.pmod(F.col("hash"), F.lit(parts)) == p).toArrow())


# --------------------------------------------------------------------- scan


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def scan_slice(part: pa.RecordBatch, hash_set: HashSet, clean: bool) -> pa.RecordBatch:
    """The slice with the hits of one part of the hash set added."""
    w = Words(part.column("text"))
    i, j = hash_set.hits(w)
    n = len(w.hashes)
    old = part.column("spans").flatten()          # word ranges found before
    base = np.repeat(w.starts, part.column("spans").value_lengths().to_numpy())
    depth = np.zeros(n + 1, np.int64)
    for at, sign in ((i, 1), (base + old.field("start").to_numpy(), 1), (i + hash_set.k[j], -1), (base + old.field("end").to_numpy(), -1)):
        np.add.at(depth, at, sign)
    # a window that ends with its text opens and closes between two texts: spans are cut there
    hit = np.cumsum(depth[:-1]) > 0
    text = np.repeat(np.arange(len(w.counts)), w.counts)
    edge = np.ones(n, bool)
    edge[1:] = text[1:] != text[:-1]
    begins, finish = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | edge[1:]
    finish[:-1] &= ~hit[1:] | edge[1:]
    begins, finish = np.flatnonzero(begins), np.flatnonzero(finish)
    per_text = np.bincount(text[begins], minlength=len(w.counts))
    local = w.starts[text[begins]]
    spans = pa.StructArray.from_arrays([pa.array((begins - local).astype(np.int32)), pa.array((finish + 1 - local).astype(np.int32))],
                                       ["start", "end"])
    items = part.column("items").to_pylist()
    if len(i):
        pair = np.unique(np.stack([text[i], j]), axis=1)
        many = hash_set.rank_at[pair[1] + 1] - hash_set.rank_at[pair[1]]
        at = np.repeat(hash_set.rank_at[pair[1]] - np.cumsum(many) + many, many) + np.arange(many.sum())
        found = np.unique(np.stack([np.repeat(pair[0], many), hash_set.ranks[at]]), axis=1)
        for t in np.unique(found[0]):
            mine = {hash_set.items[r] for r in found[1][found[0] == t]}
            items[t] = sorted(mine.union(items[t]))
    columns = {"n_words": pa.array(w.counts), "n_hit": pa.array(np.bincount(text[hit], minlength=len(w.counts))),
               "spans": _lists(spans, per_text), "items": pa.array(items, pa.list_(pa.string()))}
    if clean:
        texts = part.column("text").to_pylist()
        data, cut = w.data, np.searchsorted(begins, w.starts)
        for t in np.flatnonzero(per_text):
            at, kept = w.offsets[t], []
            for s in range(cut[t], cut[t] + per_text[t]):
                kept.append(data[at:w.first[begins[s]]].tobytes())
                at = w.last[finish[s]]
            texts[t] = b"".join([*kept, data[at:w.offsets[t + 1]].tobytes()]).decode()
        columns["clean"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([columns.get(c, part.column(c)) for c in part.schema.names], part.schema.names)


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False) -> DataFrame:
    """The documents packed as _in, their text, and: n_words, n_hit (words
    inside a window's occurrence), spans (ranges of such words), items (ids of
    items with an occurring window, sorted) and clean, the text without the
    spans if ``clean``, else null."""
    null = lambda t: F.lit(None).cast(t)
    out = pack(docs, "text").withColumns({
        "n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "spans": F.array().cast(SPANS),
        "items": F.array().cast("array<string>"), "clean": null("string")})
    for n, part in enumerate(hash_sets(benchmark, window)):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def look_up(batches, held=held):
            for batch in batches:
                for piece in slices(batch):
                    yield scan_slice(piece, held.value, clean)

        out = (stored(out, "decontaminate-docs") if n and n % CHAIN == 0 else out)
        out = out.mapInArrow(look_up, out.schema)
    return out


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, hit words and all between them cut out of their texts;
    a column n_chars follows."""
    found = scan(docs, benchmark, window, clean=True)
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        old = F.col("_in.n_chars")
        changed["n_chars"] = F.when(F.col("n_hit") > 0, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(old)
    return unpack(found, docs.columns, **changed)


def remove_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: float = 0.0) -> DataFrame:
    """The documents of whose words no more than the share ``least`` is hit."""
    found = scan(docs, benchmark, window)
    return unpack(found.where(F.col("n_hit") <= F.lit(least) * F.col("n_words")), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against all benchmark items."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("_in.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT *, least(len(w), {WINDOW}) AS k FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM
         (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
dw AS (SELECT rid, k, i, array_to_string(w[i:i + k - 1], ' ') AS words FROM
         (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
h AS (SELECT rid, i, k, item FROM dw JOIN iw USING (k, words)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS p FROM h) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)"""
