"""Merkle dataset manifest: a hash tree over each source's documents, a tree
over the sources' roots, and for every document the proof that leads from its
leaf to the root of the whole dataset.

Trees have three children a node.  A superblock is 3^LEVELS consecutive nodes
of one level, so its top is a node too.  Going up, superblocks are reduced to
their tops, level group by level group, until one node a source remains, and
the same is done with these.  Coming down, each superblock's nodes are
cogrouped with the one row that holds its top's path to the root; the last
cogroup holds leaves and finishes the local reduction, joins the proofs and
folds them.  No task holds more than one superblock, whatever a source's size,
and the driver reads one number a level group.

Defined cases: a null field is written ``-`` (an empty text ``0:``); documents
without doc_id come first in their source and those without source form the
first source; documents of equal doc_id are ordered by their leaves, so that
repeated rows, whose leaves are equal, give the same tree in any order; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import stored, table

ARITY = 3
LEVELS = 7  # a superblock has 3^7 = 2,187 nodes
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]  # fixed order of a leaf's fields
# a path is written level by level, "left siblings.right siblings", from the leaf on
SIDE, STEP = ".", ";"
PROOF = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"


def encoded(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**changed: Column) -> Column:
    """The leaf of a document, some of its fields changed."""
    return F.sha2(F.concat(*(encoded(changed.get(c, F.col(c))) for c in FIELDS)), 256)


# ------------------------------------------------------------------ numbering


def numbered(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``df``, sorted and written, with _at, and its runs: the rows of one group
    in one file part, (group, _part, _first, _before, _n).  A row's position in
    its group is _at - _first + _before, the group has _n rows.  Range
    partitions split any large group; one row a run is summed across parts."""
    placed = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                    .withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    runs = placed.groupBy(*group, part_of("_at").alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_k"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, runs.select(*group, "_part", "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"),
                               F.sum("_k").over(whole).alias("_n"))


def part_of(at: str) -> Column:
    return F.shiftright(F.col(at), 33)


def place(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves as nodes (tree, n, pos, ...), and the trees (tree, n, one row a
    source): trees are numbered by source."""
    placed, runs = numbered(leaves, ["source"], ["doc_id", "leaf"])
    runs = stored(runs, "merkle-runs")
    sources, spans = numbered(runs.select("source", F.col("_n").alias("n")).distinct(), [], ["source"])
    trees = sources.join(spans.select("_part", "_first", "_before"), part_of("_at") == F.col("_part")) \
        .select("source", "n", (F.col("_at") - F.col("_first") + F.col("_before")).alias("tree"))
    trees = stored(trees, "merkle-trees")
    named = runs.join(trees.select(F.col("source").alias("_s"), "tree", "n"), F.col("source").eqNullSafe(F.col("_s"))) \
        .select(F.col("source").alias("_s"), "_part", "_first", "_before", "tree", "n")
    nodes = placed.join(named, (part_of("_at") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_s"))) \
        .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_s", "_part", "_first", "_before", "_at")
    return nodes, trees.select("tree", "n")


# ---------------------------------------------------------------- superblocks


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def rise(hashes: list[str], n: int, levels: int) -> list[list[str]]:
    """The nodes of each level over consecutive nodes of one superblock: until
    one is left if it is its whole tree (of n nodes), else all its levels."""
    out = [hashes]
    whole = n <= ARITY ** levels
    while (len(out[-1]) > 1) if whole else (len(out) <= levels):
        at = out[-1]
        out.append([digest("".join(at[i:i + ARITY])) for i in range(0, len(at), ARITY)])
    return out


def paths(nodes: list[list[str]], outer: str) -> list[str]:
    """The path of each lowest node: its siblings level by level, then those of
    the superblock's top."""
    below = [outer]
    for at in reversed(nodes[:-1]):
        below = [SIDE.join(("".join(at[i - i % ARITY:i]), "".join(at[i + 1:i - i % ARITY + ARITY])))
                 + (STEP + below[i // ARITY] if below[i // ARITY] else "") for i in range(len(at))]
    return below


def fold(node: str, path: str) -> str:
    """The root to which a node and its path lead."""
    for step in path.split(STEP) if path else []:
        left, right = step.split(SIDE)
        node = digest(left + node + right)
    return node


def _block(levels: int) -> Column:
    return F.expr(f"pos div {ARITY ** levels}").alias("block")


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, n, pos, hash): the top of each superblock, nodes of a tree of n."""
    def top(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        n = int(g["n"].iloc[0])
        return pd.DataFrame({"tree": g["tree"].iloc[:1], "n": -(-n // ARITY ** levels), "pos": g["block"].iloc[:1],
                             "hash": rise(g["hash"].tolist(), n, levels)[-1][:1]})

    blocks = nodes.select("tree", "n", "pos", "hash", _block(levels))
    return blocks.groupBy("tree", "block").applyInPandas(top, "tree long, n long, pos long, hash string")


def reduced(nodes: DataFrame, most: int, levels: int) -> list[DataFrame]:
    """``nodes`` (trees of at most ``most``), their superblocks' tops, the tops
    of these, ... up to one node a tree.  Trees that have come to one node stay
    as they are."""
    out = [nodes]
    while most > 1:
        out.append(stored(tops(out[-1], levels), "merkle-tops"))
        most = -(-most // ARITY ** levels)
    return out


def inner_paths(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, path, subroot, root) of ``nodes``, from the same of their
    superblocks' tops."""
    def down(key, g: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        g, o = g.sort_values("pos"), o.iloc[0]
        found = paths(rise(g["hash"].tolist(), int(g["n"].iloc[0]), levels), o["path"])
        return pd.DataFrame({"tree": g["tree"], "pos": g["pos"], "path": found, "subroot": o["subroot"], "root": o["root"]})

    left = nodes.select("tree", "n", "pos", "hash", _block(levels)).groupBy("tree", "block")
    right = outer.withColumnRenamed("pos", "block").groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(down, "tree long, pos long, path string, subroot string, root string")


def descend(levels_up: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """Paths of the superblocks of the lowest nodes, from those of the trees."""
    for nodes in reversed(levels_up[1:-1]):
        outer = stored(inner_paths(nodes, outer, levels), "merkle-paths")
    return outer


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row a leaf of (source, doc_id, leaf, probe): doc_id, leaf, subroot
    (its source's root), root, proof (its path: ``left.right`` digests of the
    siblings level by level, joined by ``;``), folded_root (the root to which
    probe, the leaf to be verified, and the proof lead) and verified."""
    nodes, trees = place(leaves)
    most = [r or 1 for r in trees.agg(F.max("n"), F.count("*")).first()]
    up = reduced(nodes.withColumn("hash", F.col("leaf")), most[0], levels)
    # one node a tree is left: leaves of the tree of all sources
    subroots = stored(up[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(most[1]).cast("long").alias("n"),
                                    F.col("tree").alias("pos"), "hash"), "merkle-subroots")
    over = reduced(subroots, most[1], levels)
    top = over[-1].select("tree", "pos", F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"),
                          F.col("hash").alias("root"))
    across = top if len(over) == 1 else stored(inner_paths(subroots, descend(over, top, levels), levels), "merkle-paths")
    outer = across.drop("subroot").join(subroots.select("pos", F.col("hash").alias("subroot")), "pos") \
        .select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root")
    outer = descend(up, stored(outer, "merkle-paths"), levels)

    def finish(key, g: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        g, o = g.sort_values("pos"), o.iloc[0]
        proofs = paths(rise(g["leaf"].tolist(), int(g["n"].iloc[0]), levels), o["path"])
        probes = g["probe"].where(g["probe"].notna(), g["leaf"])
        out = g[["doc_id", "leaf"]].assign(subroot=o["subroot"], root=o["root"], proof=proofs,
                                           folded_root=[fold(h, p) for h, p in zip(probes, proofs)])
        return out.assign(verified=out["folded_root"] == out["root"])

    left = nodes.select("tree", "n", "pos", F.col("doc_id").cast("long").alias("doc_id"), "leaf", "probe", _block(levels))
    right = outer.withColumnRenamed("pos", "block")
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInPandas(finish, PROOF)


def siblings(proof: Column) -> Column:
    """The digests of a proof, level by level, left to right."""
    return F.translate(proof, SIDE + STEP, "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; those whose crc32 of the id is even are
    verified against a text that lost its line feeds."""
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select("source", "doc_id", leaf().alias("leaf"),
                         F.when(even, leaf(text=F.replace("text", F.lit("\n"), F.lit("")))).alias("probe"))
    return manifest(leaves).select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"),
                                   "folded_root", "verified")


def _sql() -> str:
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    hashed = lambda text: "sha256(" + " || ".join(enc(text if c == "text" else c) for c in FIELDS) + ")"
    # crc32 by bits over the id's decimal characters
    crc = ("xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda s: CAST(ord(s) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) "
           "FOR i IN range(8)]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
    return f"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS rid, doc_id, source, {hashed('text')} AS leaf,
         CASE WHEN {crc} % 2 = 0 THEN {hashed("replace(text, chr(10), '')")} END AS probe FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
             dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM l),
nodes AS (SELECT tree, 0 AS lvl, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM p
          UNION ALL
          SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
          FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 3),
subs AS (SELECT tree, h FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS lvl, tree AS pos, h, count(*) OVER () AS n FROM subs
         UNION ALL
         SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3)
         FROM tops WHERE n > 1 GROUP BY lvl, pos // 3),
steps AS (
  SELECT rid, 0 AS part, lvl, coalesce(string_agg(h, '' ORDER BY a.pos) FILTER (WHERE a.pos < p.pos // CAST(pow(3, lvl) AS BIGINT)), '') AS lt,
         coalesce(string_agg(h, '' ORDER BY a.pos) FILTER (WHERE a.pos > p.pos // CAST(pow(3, lvl) AS BIGINT)), '') AS rt
  FROM p JOIN nodes a ON a.tree = p.tree AND a.n > 1 AND a.pos // 3 = p.pos // CAST(pow(3, lvl + 1) AS BIGINT) GROUP BY rid, lvl
  UNION ALL
  SELECT rid, 1, lvl, coalesce(string_agg(h, '' ORDER BY a.pos) FILTER (WHERE a.pos < p.tree // CAST(pow(3, lvl) AS BIGINT)), ''),
         coalesce(string_agg(h, '' ORDER BY a.pos) FILTER (WHERE a.pos > p.tree // CAST(pow(3, lvl) AS BIGINT)), '')
  FROM p JOIN tops a ON a.n > 1 AND a.pos // 3 = p.tree // CAST(pow(3, lvl + 1) AS BIGINT) GROUP BY rid, lvl),
s AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) AS k FROM steps),
proofs AS (SELECT rid, string_agg(lt || rt, '' ORDER BY k) AS proof, max(k) AS k FROM s GROUP BY rid),
folds AS (SELECT rid, 0 AS k, coalesce(probe, leaf) AS h FROM p
          UNION ALL
          SELECT f.rid, f.k + 1, sha256(s.lt || f.h || s.rt) FROM folds f JOIN s ON s.rid = f.rid AND s.k = f.k + 1)
SELECT p.doc_id, p.leaf, subs.h AS subroot, tops.h AS root, sha256(coalesce(proofs.proof, '')) AS proof_sha256,
       folds.h AS folded_root, folds.h = tops.h AS verified
FROM p JOIN subs USING (tree) JOIN tops ON tops.n = 1 LEFT JOIN proofs ON proofs.rid = p.rid
JOIN folds ON folds.rid = p.rid AND folds.k = coalesce(proofs.k, 0)"""


SQL = _sql()
