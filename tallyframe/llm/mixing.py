"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are counted in words.  Each source's target is its share by weight of
all words, capped at ``max_epochs`` times its size, the excess reshared by
weight until no target is above its cap.  The mix is a list of slots, one
block of ``block_tokens`` words each: slot t takes the golden-ratio point
frac(t * phi), which the cumulative weights of the sources map to a source;
its rank among the slots of that source names the block it takes from the
source's shuffled stream of documents (beyond the last block, the stream
starts again).  The golden-ratio counts miss a source's number of blocks by a
few slots at most; the surplus slots of some sources are handed to those that
fell short, so every source gives its target to the word.

Hot sources: ranks and positions are prefix sums in two levels (within
bounded chunks, then over chunks), so no task ever holds a whole source, and
joins are keyed by (source, block).

Defined cases: a null text has size 0; a null source is a source of its own,
ranked last; documents without words are listed with taken = 0; repeated rows
are separate documents of the same id and may be taken differently; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import global_prefix, pack, stored, table, unpack

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)       # by the source's rank, repeating
MAX_EPOCHS = 3
BLOCK_TOKENS = 1024
CHUNK = 8192              # rows or slots ranked in one task
PERIOD = 1 << 31
GOLDEN = 1327217885       # odd, nearest to PERIOD / phi: t * GOLDEN mod PERIOD visits every point once


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def document_key() -> Column:
    """Identifies a document's content; equal for repeated rows only."""
    return F.xxhash64("doc_id", "source", "text")


def source_targets(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) -> (source, size, sid, weight, target).  The resharing
    loop needs two sums per round from all sources, and one round for each
    set of sources that newly reach their caps."""
    ranked = global_prefix(sources, [F.col("source").asc_nulls_last()], F.lit(1), "sid")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.withColumn("weight", weight).withColumn("cap", (F.col("size") * max_epochs).cast("double")),
                    "sources")
    level, full = 0.0, -1
    while True:
        at_cap = F.col("cap") < F.col("weight") * F.lit(level)
        r = ranked.agg(F.sum("size").alias("total"), F.sum(F.when(at_cap, F.col("cap"))).alias("capped"),
                       F.sum(F.when(~at_cap, F.col("weight"))).alias("weight"),
                       F.count(F.when(at_cap, 1)).alias("full")).first()
        if r["full"] == full or not r["weight"]:
            break
        full, level = r["full"], (float(r["total"]) - float(r["capped"] or 0)) / r["weight"]
    return ranked.withColumn("target", F.least("cap", F.col("weight") * F.lit(level))).drop("cap")


def schedule(targets: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mix in order: t, sid, block, epoch, words (taken from the block's
    beginning: less than the block only at the end of a source's target)."""
    spark = targets.sparkSession
    b = F.lit(block_tokens)
    goal = F.round("target").cast("bigint")
    need = targets.where("size > 0").select("sid", "size", goal.alias("goal"), F.ceil(F.col("size") / b).alias("n_blocks"))
    need = need.withColumn("slots", (F.col("n_blocks") * F.floor(F.col("goal") / F.col("size"))
                                     + F.ceil((F.col("goal") % F.col("size")) / b)).cast("bigint"))
    need = stored(global_prefix(need, [F.col("sid").asc()], F.col("slots"), "before"), "need")
    n_slots, n_sources = need.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    cells = 4 * max(1, n_sources)
    point = lambda c: F.floor(c / F.lit(float(max(1, n_slots))) * PERIOD).cast("bigint")
    cell = lambda c: F.floor(c / F.lit(PERIOD / cells)).cast("bigint")
    ranges = need.select("sid", point(F.col("before")).alias("lo"), point(F.col("before") + F.col("slots")).alias("hi")) \
        .where("hi > lo").withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))))
    points = spark.range(n_slots).select(F.col("id").alias("t"), ((F.col("id") % PERIOD) * GOLDEN % PERIOD).alias("u")) \
        .withColumn("cell", cell(F.col("u")))
    hit = points.join(ranges, (points.cell == ranges.cell) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))) \
        .select("t", "sid", F.floor(F.col("t") / CHUNK).alias("chunk"))
    hit = stored(hit, "slots")
    shift = hit.groupBy("sid", "chunk").count().select("sid", "chunk", F.coalesce(F.sum("count").over(
        Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    ranked = hit.withColumn("rn", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("t")) - 1) \
        .join(shift, ["sid", "chunk"]).select("t", "sid", (F.col("rn") + F.col("shift")).alias("rank"))
    ranked = stored(ranked.join(need.select("sid", "slots"), "sid"), "ranked")
    surplus = global_prefix(ranked.where("rank >= slots").select("t"), [F.col("t").asc()], F.lit(1), "k")
    short = need.join(ranked.groupBy("sid").agg(F.count("*").alias("got")), "sid", "left") \
        .withColumn("got", F.coalesce("got", F.lit(0))).where("got < slots") \
        .select("sid", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("rank"))
    short = global_prefix(short, [F.col("rank").asc(), F.col("sid").asc()], F.lit(1), "k")
    moved = short.join(surplus, "k").select("t", "sid", "rank")
    slots = ranked.where("rank < slots").select("t", "sid", "rank").unionByName(moved) \
        .join(need.select("sid", "size", "goal", "n_blocks"), "sid") \
        .withColumn("block", F.col("rank") % F.col("n_blocks")) \
        .withColumn("epoch", F.floor(F.col("rank") / F.col("n_blocks")))
    words = F.least((F.col("block") + 1) * b, F.col("size"), F.col("goal") - F.col("epoch") * F.col("size")) \
        - F.col("block") * b
    return slots.select("t", "sid", "block", "epoch", words.alias("words"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, source, key (see document_key), size,
    source_size, target, taken (its words in the mix, repeats counted)."""
    sized = stored(docs.select("doc_id", "source", document_key().alias("key"), word_count(F.col("text")).alias("size")),
                   "sized")
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, max_epochs),
                     "targets")
    slots = schedule(targets, block_tokens).groupBy("sid", "block").agg(F.collect_list("words").alias("lens"))
    # repeated rows count once in the shuffled order, as a run of copies
    runs = sized.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("copies"))
    runs = stored(runs.join(targets.select("source", "sid", F.col("size").alias("source_size"), "target"),
                            runs.source.eqNullSafe(targets.source)).drop(targets.source), "runs")
    bits = max(0, (runs.count() // CHUNK).bit_length())
    order = F.xxhash64("key", F.lit("shuffle"))
    runs = runs.withColumn("o", order).withColumn(
        "part", F.shiftrightunsigned(F.col("o"), 64 - bits) if bits else F.lit(0).cast("bigint"))
    local = Window.partitionBy("sid", "part").orderBy("o", "key", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, -1)
    span = F.col("size") * F.col("copies")
    shift = runs.groupBy("sid", "part").agg(F.sum(span).alias("s")).select("sid", "part", F.coalesce(F.sum("s").over(
        Window.partitionBy("sid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    placed = runs.withColumn("at", F.coalesce(F.sum(span).over(local), F.lit(0))).join(shift, ["sid", "part"]) \
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))) \
        .withColumn("at", F.col("at") + F.col("shift") + F.col("copy") * F.col("size"))
    doc = ["doc_id", "source", "key", "size", "source_size", "target"]
    b = F.lit(block_tokens)
    pieces = placed.where("size > 0").select(*doc, "sid", "at", F.explode(F.sequence(
        F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block"))
    overlap = lambda n: F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), F.col("block") * b + n)
                                   - F.greatest("at", F.col("block") * b))
    taken = pieces.join(slots, ["sid", "block"], "left").withColumn("w", F.coalesce(F.aggregate(
        "lens", F.lit(0).cast("bigint"), lambda x, n: x + overlap(n)), F.lit(0)))
    return taken.groupBy(*doc, "sid", "at").agg(F.sum("w").alias("taken")).select(*doc, "taken") \
        .unionByName(placed.where("size = 0").select(*doc, F.lit(0).cast("bigint").alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each document as often as its words are
    taken, to the nearest whole document (a source's cut falls within one
    document); documents that are not taken go."""
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    keys = stored(mix(docs, **options).groupBy("key").agg(F.sum(copies).cast("int").alias("_copies"), F.count("*").alias("_rows"))
                  .where("_copies > 0").withColumnRenamed("key", "_key"), "mix-copies")
    found = pack(docs, document_key().alias("_key"))
    once = found.join(keys.where("_rows = 1"), "_key")
    more = found.join(keys.where("_rows > 1"), "_key").dropDuplicates(["_key"])  # repeated rows share their copies
    return unpack(once.unionByName(more).select("_in", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
