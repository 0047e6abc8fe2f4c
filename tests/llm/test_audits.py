"""Dataset manifest, benchmark decontamination and source audit against brute
force, with the cases their docstrings define."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import common, decontaminate, divergence, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "pos long, tree long, block string, hash string, spans string, items string, clean string, n long, term string, cells string"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus():
    """Sources of very different sizes, nulls in every column, empty and long
    texts, repeated rows and repeated ids."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "DELTA", "naïve", "x1", "été", "one-two", "z"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 40))) + rng.choice(["", "\n", "\n\nend"])
    rows = [(k, text(), rng.choice(["en", "de"]), "big", 7) for k in range(90)]
    rows += [(k, text(), rng.choice(["en", "de", None]), f"s{k % 7}", None) for k in range(100, 130)]
    rows += [(500, "", "en", "only", 0), (501, None, None, None, None), (None, None, None, None, None), (None, "a\nb", "en", None, 3),
             (502, "same", "en", "big", 4), (502, "same", "en", "big", 4), (502, "other\n", "en", "big", 4),
             (600, "long word " * 30_000 + "Alpha", "en", "s1", 1), (601, "y" * 50_000, "fr", "ünï", 1), (602, " \n\t ", "fr", "lone", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    data = corpus()
    return spark.createDataFrame([(*r, 1, 2, *["keep"] * 5, 3, "keep", "keep") for r in data], f"{DOCS}, {EXTRA}").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


# -------------------------------------------------------------------- manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return H("".join(field(x) for x in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root, and each node's [(left siblings, right siblings)]."""
    steps, at, of = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(at) > 1:
        for i, j in enumerate(of):
            run = j - j % 3
            steps[i].append(("".join(at[run:j]), "".join(at[j + 1:run + 3])))
        at, of = [H("".join(at[k:k + 3])) for k in range(0, len(at), 3)], [j // 3 for j in of]
    return at[0], steps


def manifest_by_hand(data):
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = collections.defaultdict(list)
    for r in data:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        probe = leaf(r, r[1].replace("\n", "")) if even and r[1] is not None else leaf(r, r[1])
        groups[r[3]].append((r[0], leaf(r, r[1]), probe))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (first(x[0]), x[1]))
    tops = {s: climb([x[1] for x in g]) for s, g in groups.items()}
    root, across = climb([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, across):
        for (doc_id, h, probe), own in zip(groups[s], tops[s][1]):
            node = probe
            for a, b in own + up:
                node = H(a + node + b)
            out.append((doc_id, h, tops[s][0], root, "".join(a + b for a, b in own + up), node, node == root))
    return collections.Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest_against_brute_force(spark, docs, levels):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("source", "doc_id", merkle.leaf().alias("leaf"),
                         F.when(even, merkle.leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).alias("probe"), "pos", "hash")
    got = merkle.manifest(leaves, levels)
    want = manifest_by_hand(corpus())
    assert rows_of(got, "doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("proof")), "folded_root", "verified") == want
    assert {r[6] for r in want} == {True, False}


def test_manifest_of_little(spark, none):
    leaves = lambda df: df.select("source", "doc_id", merkle.leaf().alias("leaf"), F.lit(None).cast("string").alias("probe"))
    assert merkle.manifest(leaves(none)).collect() == []
    one = leaves(spark.createDataFrame([(1, "a", "en", "s", 1)], DOCS))
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] == r["folded_root"] and r["proof"] == "" and r["verified"]
    many = leaves(spark.createDataFrame([(k, "a", "en", f"s{k:02}", 1) for k in range(11)], DOCS))  # as many sources as documents
    got = merkle.manifest(many, 1).collect()
    assert len({r["root"] for r in got}) == 1 and all(r["verified"] and r["subroot"] == r["leaf"] for r in got)
    assert all(merkle.fold(r["leaf"], r["proof"]) == r["root"] != merkle.fold(H("x"), r["proof"]) for r in got)


# --------------------------------------------------------------- decontamination

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [(1, "The quick brown fox jumps over the lazy dog again and again today"), (2, "alpha beta"), (3, "Alpha, BETA!"), (4, ""),
         (5, None), (None, "z z z"), (1, "second text of item one, with more than ten words in it, really"), (6, "été"), (7, "... --- ...")]
LEAKS = [(700, "so: the QUICK brown fox jumps over the lazy dog again, and again -- today! end", "en", "t", 1),
         (701, "the quick brown fox jumps over the lazy dog", "en", "t", 1), (702, "z z z z z|alpha/beta", "en", "t", 1),
         (703, "z z", "en", "t", 1), (704, "alpha", "en", "t", 1), (705, "beta alpha beta alpha", "en", "t", 1),
         (706, "quick brown fox jumps over the lazy dog again and " * 2000, "en", "t", 1), (707, "ÉTÉ été", "en", "t", 1)]


def leaks_by_hand(data, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(lower(text))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add(str(item) if item is not None else "")
    lengths = {len(w) for w in windows}
    out = []
    for r in data:
        w = TOKEN.findall(lower(r[1]))
        hit, ids = set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i:i + k]))
                if found:
                    hit.update(range(i, i + k))
                    ids |= found
        out.append((r[0], len(w), len(hit), tuple(sorted(ids))))
    return collections.Counter(out)


def leaks(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.scan(docs, bench).select(F.col("_in.doc_id"), "n_words", "n_hit", "items")
    return collections.Counter((r[0], r[1], r[2], tuple(r[3])) for r in found.collect())


@pytest.fixture(scope="module")
def leaky(spark, docs):
    return docs.unionByName(spark.createDataFrame([(*r, 1, 2, *["keep"] * 5, 3, "keep", "keep") for r in LEAKS], docs.schema))


def test_leaks_against_brute_force(spark, leaky):
    want = leaks_by_hand(corpus() + LEAKS, ITEMS)
    assert leaks(spark, leaky, ITEMS) == want and sum(n for r, n in want.items() if r[2]) > 20


def test_hash_set_in_parts(spark, leaky, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WINDOWS", 2)
    assert len(list(decontaminate.hash_sets(spark.createDataFrame(ITEMS, "item_id long, text string")))) > decontaminate.CHAIN
    assert leaks(spark, leaky, ITEMS) == leaks_by_hand(corpus() + LEAKS, ITEMS)


def test_clashing_hashes_are_told_apart(spark, leaky, monkeypatch):
    monkeypatch.setattr(decontaminate, "mix64", lambda x: common.mix64(x) & np.uint64(1))
    assert leaks(spark, leaky, ITEMS) == leaks_by_hand(corpus() + LEAKS, ITEMS)


def test_removal(spark, leaky, none):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.remove_spans(leaky, bench)
    assert got.columns == leaky.columns and got.count() == leaky.count()
    kept = {r["doc_id"]: r for r in got.where("doc_id >= 700").collect()}
    assert kept[700]["text"] == "so: ! end" and kept[700]["n_chars"] == 9 and kept[700]["items"] == "keep"
    assert kept[701]["text"] == LEAKS[1][1] and kept[701]["n_chars"] == 1
    assert kept[702]["text"] == "" and kept[705]["text"] == "beta  alpha" and kept[707]["text"] == "ÉTÉ "
    whole = decontaminate.remove_documents(leaky, bench)
    hit = {r[0] for r in leaks_by_hand(corpus() + LEAKS, ITEMS) if r[2]}
    assert {r["doc_id"] for r in whole.collect()} == {r[0] for r in corpus() + LEAKS} - hit
    assert leaks(spark, leaky, [(1, None)]) == leaks_by_hand(corpus() + LEAKS, [])
    assert leaks(spark, none, ITEMS) == {} and decontaminate.scan(leaky, none.select(F.col("doc_id").alias("item_id"), "text")) \
        .where("n_hit > 0").isEmpty()


# ------------------------------------------------------------------------ audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_by_hand(data, least, top=10):
    text = [(r[2] or "", r[3] or "", TERM.findall(lower(r[1]))) for r in data]
    out = collections.Counter()
    for lang in {t[0] for t in text}:
        mine = [t for t in text if t[0] == lang]
        df = collections.Counter(w for t in mine for w in set(t[2]))
        kept = [w for w, n in df.items() if n >= least]
        count = {s: collections.Counter() for s in {t[1] for t in mine}}
        for _, s, words in mine:
            count[s].update(w for w in words if df[w] >= least)
        price = lambda c: {w: 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}
        p = {s: price(c) for s, c in count.items()}
        q = price(sum(count.values(), collections.Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            parts = {"pair": [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in count if o != s],
                     "term": [(f(p[s][w], q[w]), w) for w in kept if count[s][w] and p[s][w] > q[w]]}
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                for k, (value, item) in enumerate(found[:top if part == "term" else None]):
                    out[lang, s, part, item, value, k + 1] += 1
    return out


@pytest.mark.parametrize("least, cells", [(10, 400_000), (1, 25), (2, 7), (10_000, 100)])
def test_audit_against_brute_force(spark, docs, least, cells):
    got = divergence.audit(docs, least, most_cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert rows_of(got, *got.columns) == audit_by_hand(corpus(), least)


def test_audit_of_hot_source_and_many_sources(spark, none, monkeypatch):
    rng = random.Random(3)
    data = [(k, " ".join(f"w{chr(97 + min(25, int(rng.expovariate(0.2))))}" for _ in range(30)), "en",
             "hot" if k % 3 else f"s{rng.randrange(40)}", 1) for k in range(400)]
    df = spark.createDataFrame(data, DOCS)
    assert rows_of(divergence.audit(df), "lang", "source", "part", "item", "value", "rank") == audit_by_hand(data, 10)
    monkeypatch.setattr(divergence, "MOST_GROUPS", 3)  # totals joined by shuffle
    assert rows_of(divergence.audit(df), "lang", "source", "part", "item", "value", "rank") == audit_by_hand(data, 10)
    assert divergence.audit(none).collect() == []


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = ("word, été " * 40 + "x" * 90 + " End").encode()
    whole = divergence.terms(text)
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert divergence.terms(text) == whole and whole["x".encode() * 90] == 1 and whole[b"end"] == 1


def test_prices_are_exact(spark):
    """A quotient just below a whole number is not rounded up."""
    n, d = 2_999_999_999, 3_000_000_001
    got = spark.range(1).select(divergence.share(F.lit(n).cast("long"), F.lit(d).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // d
    d = 10**15 + 1
    got = spark.range(1).select(divergence.share(F.lit(d - 3).cast("long"), F.lit(d).cast("long"))).first()[0]
    assert got == 1 + 10**9 * (d - 1) // d == 10**9
