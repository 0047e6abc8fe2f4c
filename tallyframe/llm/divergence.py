"""Source divergence audit: how the vocabulary of each source differs from that
of the other sources of its language, and which terms set it apart.

Stripes: a task folds whole documents into a hash table, language and term to
its document frequency and its counts by source; when the table is full it is
spilled, that is, sent on and begun anew.  Partial stripes are merged by
(language, term) with Spark aggregates; a term that holds a large share of all
words is one short row a spill by then.  The merged stripes of kept terms emit
the divergences: each a term's rows, and its share of every pair of sources
that both use it, summed in the task over all its stripes.

Two sources that lack a term differ in it by a constant, and one that has it
differs from all that lack it by an amount that its count alone decides, so
only the pairs that meet in a stripe are formed; the rest follows from each
source's counts of counts.

Probabilities are integers in units of 1e-9, all arithmetic is exact: counts
times 1e9 as decimals, divergences in 64 bits (p and q are at most 1e9 + 1).

Defined cases: null text, lang and source count as empty strings; a source
without terms, or a language without kept terms, still gives its pairs; a
language of one source gives no pairs; repeated rows count as often as they
occur; other columns play no part; an empty table gives an empty result; long
texts are counted in pieces of PIECE bytes that end between terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import pairs_in_groups, slices, stored, table

LEAST_DOCS = 10      # documents of a language that a kept term occurs in
TOP_TERMS = 10       # terms reported for each source (a top-k report)
UNIT = 1_000_000_000
MOST_CELLS = 250_000  # cells of a task's hash table, about 80 MB, before it is spilled
PIECE = 1 << 20
MOST_GROUPS = 100_000  # (lang, source) totals are broadcast up to this many, else joined by shuffle
# letters stay, A-Z in lower case, bytes of other alphabets too; all else ends a term
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
CELLS = "lang string, term string, source string, n long, df long"


# ------------------------------------------------------------------- stripes


def terms(text: bytes) -> Counter:
    """The counts of a whole text's terms."""
    out, at = Counter(), 0
    while at < len(text):
        piece = text[at:at + PIECE].translate(_LETTERS)
        end = len(piece) if at + PIECE >= len(text) else piece.rfind(b" ") + 1
        if not end:                              # one term longer than a piece
            end = next((k for k in range(at + PIECE, len(text)) if _LETTERS[text[k]] == 0x20), len(text)) - at
            piece = text[at:at + end].translate(_LETTERS)
        out.update(piece[:end].split())
        at += end
    return out


def fold(batches, most: int) -> Iterator[pa.RecordBatch]:
    """Documents (lang, source, text) to the cells of partial stripes: a term's
    count n in a source; its document frequency stands in the first of them."""
    stripes: dict[str, dict[bytes, dict]] = {}
    names: dict[str, str] = {}
    cells = 0

    def batch_of(lang, *columns):
        types = (pa.binary(), pa.string(), pa.int64(), pa.int64())
        term, *rest = (pa.array(c, t) for c, t in zip(columns, types))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(term)), term.cast(pa.string()), *rest],
                                          ["lang", "term", "source", "n", "df"])

    def spill():
        for lang, mine in stripes.items():
            term, source, count, docs = [], [], [], []
            for t, stripe in mine.items():
                docs.append(stripe.pop(None))
                docs.extend([0] * (len(stripe) - 1))
                term.extend([t] * len(stripe))
                source.extend(stripe)
                count.extend(stripe.values())
                if len(term) >= 1 << 16:
                    yield batch_of(lang, term, source, count, docs)
                    term, source, count, docs = [], [], [], []
            if term:
                yield batch_of(lang, term, source, count, docs)

    for batch in batches:
        for part in slices(batch):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text"))):
                source = names.setdefault(source, source)
                mine = stripes.setdefault(lang, {})
                for term, n in terms(text).items():
                    stripe = mine.get(term)
                    if stripe is None:
                        mine[term] = {None: 1, source: n}
                        cells += 1
                        continue
                    stripe[None] += 1
                    if source in stripe:
                        stripe[source] += n
                    else:
                        stripe[source] = n
                        cells += 1
                if cells >= most:
                    yield from spill()
                    stripes, names, cells = {}, {}, 0
    yield from spill()


def merged_stripes(docs: DataFrame, least_docs: int = LEAST_DOCS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, term, df, total, cells: [(source, n)]) of each kept term."""
    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    partial = texts.mapInArrow(lambda batches: fold(batches, most_cells), CELLS)
    # one exchange by stripe serves both aggregates
    merged = partial.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return merged.groupBy("lang", "term").agg(
        F.sum("df").alias("df"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")) \
        .where(F.col("df") >= least_docs)


# --------------------------------------------------------------- divergences


def share(count: Column, d: Column) -> Column:
    """p of a count; d is N + 2 V (1 where there is no kept term)."""
    scaled = (count + 2).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", scaled, d.cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def totals(docs: DataFrame, stripes: DataFrame) -> DataFrame:
    """(lang, source, gid, v, d, base, dl) of every occurring group: its
    number, V, N + 2 V, p of an absent term, and the language's N + 2 V."""
    counts = stripes.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = stripes.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("nl"))
    groups = docs.select("lang", "source").distinct().join(langs, "lang", "left").join(counts, ["lang", "source"], "left")
    zero = F.lit(0).cast("long")
    v, some = F.coalesce("v", zero), lambda n: F.greatest(n, F.lit(1).cast("long"))
    out = groups.select("lang", "source", F.monotonically_increasing_id().alias("gid"), v.alias("v"),
                        some(F.coalesce("n", zero) + 2 * v).alias("d"), some(F.coalesce("nl", zero) + 2 * v).alias("dl"))
    return stored(out.withColumn("base", share(zero, F.col("d"))), "divergence-groups")


def shared_terms(batches) -> Iterator[pa.RecordBatch]:
    """Priced stripes to (a, b, x): over the terms that groups a < b share,
    their divergence less what the lack of either or both would give."""
    held: dict[tuple[int, int], int] = {}

    def emit():
        keys = np.array(list(held), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(held.values()), pa.int64())],
                                          ["a", "b", "x"])

    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for batch in batches:
        cells = batch.column("cells")
        flat = cells.flatten()
        gid, p, base = (flat.field(c).to_numpy() for c in ("gid", "p", "base"))
        for i, j in pairs_in_groups(cells.value_lengths().to_numpy(), 1 << 19):
            x = f(p[i], p[j]) - f(p[i], base[j]) - f(base[i], p[j]) + f(base[i], base[j])
            a, b = np.minimum(gid[i], gid[j]), np.maximum(gid[i], gid[j])
            order = np.lexsort((b, a))
            a, b, x = a[order], b[order], x[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            for key, n in zip(zip(a[first].tolist(), b[first].tolist()), np.add.reduceat(x, first).tolist()):
                held[key] = held.get(key, 0) + n
            if len(held) > 1 << 18:
                yield emit()
                held.clear()
    yield emit()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source,
    text): part ``pair`` holds the divergence from each other source of the
    language, ``term`` the ``top`` terms that the source uses more than its
    language does.  value is in units of 1e-9, ranks go by it."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    stripes = stored(merged_stripes(docs, least_docs, most_cells), "divergence-stripes")
    groups = totals(docs, stripes)
    known = F.broadcast(groups) if groups.count() <= MOST_GROUPS else groups
    priced = stripes.select("lang", "term", "total", F.inline("cells")).join(known, ["lang", "source"]) \
        .withColumn("p", share(F.col("n"), F.col("d")))
    priced = stored(priced.withColumn("q", share(F.col("total"), F.col("dl")))
                    .select("lang", "source", "term", "gid", "base", "p", "q"), "divergence-priced")

    # pairs: all terms as if absent, each source's own terms, the shared ones
    shared = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("gid", "p", "base")).alias("cells")) \
        .where(F.size("cells") > 1).select("cells").mapInArrow(shared_terms, "a long, b long, x long")
    side = lambda x: known.select("lang", F.col("gid").alias(x), F.col("base").alias(f"base_{x}"), "v")
    other = F.col("a") != F.col("b")
    absent = side("a").join(side("b").drop("v"), "lang").where(other) \
        .select("a", "b", (F.col("v") * apart(F.col("base_a"), F.col("base_b"))).alias("x"))
    own = priced.groupBy("lang", F.col("gid").alias("a"), F.col("base").alias("base_a"), "p").agg(F.count("*").alias("m")) \
        .join(side("b").drop("v"), "lang").where(other) \
        .select("a", "b", (F.col("m") * (apart(F.col("p"), F.col("base_b")) - apart(F.col("base_a"), F.col("base_b")))).alias("x"))
    mirrored = lambda df: df.union(df.select("b", "a", "x"))
    own = own.groupBy("a", "b").agg(F.sum("x").alias("x"))
    sums = absent.union(mirrored(own)).union(mirrored(shared)).groupBy("a", "b").agg(F.sum("x").alias("value"))
    name = lambda x, *more: known.select(F.col("gid").alias(x), F.col("source").alias("source" if x == "a" else "item"), *more)
    pairs = sums.join(name("a", "lang"), "a").join(name("b"), "b").select("lang", "source", "item", "value")

    by = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    rank = F.row_number().over(by)
    marked = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs.withColumn("rank", rank), "pair").unionByName(
        out(marked.withColumn("rank", rank).where(F.col("rank") <= top), "term"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (lang, source) of the documents against its language."""
    return audit(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
gn AS (SELECT g.lang, g.source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total, coalesce(any_value(v), 0) AS v
       FROM g LEFT JOIN c USING (lang, source) LEFT JOIN v ON v.lang = g.lang GROUP BY g.lang, g.source),
ln AS (SELECT lang, sum(total) AS total FROM gn GROUP BY lang),
p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
             1 + CAST({UNIT} AS HUGEINT) * (coalesce(c.n, 0) + 2) // (gn.total + 2 * gn.v) AS p
      FROM gn JOIN kept k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
q AS (SELECT k.lang, k.term, 1 + CAST({UNIT} AS HUGEINT) * (sum(c.n) + 2) // (any_value(ln.total) + 2 * any_value(v.v)) AS q
      FROM kept k JOIN c USING (lang, term) JOIN ln ON ln.lang = k.lang JOIN v ON v.lang = k.lang GROUP BY k.lang, k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
tm AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
       FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
      FROM (SELECT * FROM pr UNION ALL SELECT * FROM tm))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""
