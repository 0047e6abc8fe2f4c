"""Secret scans: format rules plus character Markov models, in Spark
expressions only.

Three format rules give the base spans.  Beyond them, every run of 16 or more
key characters is scored by two first-order character models, one of random
strings and one of ordinary identifiers; a run whose log-likelihood ratio
reaches ``threshold`` and which no base span contains is a ``markov`` span.

The models are trained from labelled samples (text, label): label 1, the
values found by the format rules and digests of the sampled texts written in
hex, base64, base62 and upper-case alphabets; label 0, the words around them,
plain, joined as snake_case, CamelCase, CONSTANT_CASE, by - / and =, and
numbered (word_1234567890).  The samples come from
``SAMPLE_DOCS`` documents in hash order (a bounded, documented sample).  The
model is one table of transition scores of fixed size, a literal in the scan.

Defined cases: a null text counts as empty; empty texts have no spans;
positions are code points, stop exclusive; ties in start are ordered by kind
(assign, access, hex, markov); repeated rows are scanned each; other columns
of the input are kept, those named like an output replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import cut_out, let, running_ends, running_max, stored, table

# fixed values: the format rules
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # 16 characters or more
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE_DOCS = 500
THRESHOLD = 9.2            # log-likelihood ratio: 10^4 to 1
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
SIZE, SMOOTHING = len(ALPHABET) + 1, 0.5


def find(text: Column, pattern: str, group_2_least: int = 0) -> Column:
    """array<struct<start, stop, txt>> of the pattern's matches, from the
    lengths of the pieces between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    second = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if group_2_least else found
    lengths = F.flatten(F.zip_with(F.split(text, pattern, -1), found, lambda p, m: F.array(
        F.length(p).cast("bigint"), F.coalesce(F.length(m), F.lit(0)).cast("bigint"))))
    at = lambda ends, i: F.get(ends, i)
    build = lambda ends: F.transform(F.arrays_zip(found.alias("txt"), second.alias("v")), lambda m, i: F.struct(
        at(ends, 2 * i).alias("start"), at(ends, 2 * i + 1).alias("stop"), m["txt"].alias("txt"), m["v"].alias("v")))
    spans = F.transform(F.array(running_ends(lengths)), build)[0]
    spans = F.filter(spans, lambda s: F.length(s["v"]) >= group_2_least)
    none = F.expr("cast(array() as array<struct<start: bigint, stop: bigint, txt: string, v: string>>)")
    return F.when(text.rlike(pattern), spans).otherwise(none)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with the arrays assign, access and hex."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"assign": find(text, ASSIGN, 8), "access": find(text, ACCESS), "hex": find(text, HEX)})


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(s, label) from a bounded sample of the documents."""
    keyed = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("k"))
    picked = keyed.select("k").distinct().orderBy("k").limit(sample_docs)
    sample = stored(base_spans(keyed.join(F.broadcast(picked), "k", "left_semi").dropDuplicates(["k"])), "secret-sample")
    b64 = F.base64(F.unhex(F.concat(F.sha2("text", 256), F.md5("text"))))
    alnum = F.regexp_replace(b64, "[^A-Za-z0-9]", "")
    values = F.concat(F.transform(F.concat("assign", "access", "hex"), lambda s: s["v"]),
                      F.array(F.sha2("text", 256), b64, alnum, F.upper(alnum)))
    around = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = F.array_distinct(F.regexp_extract_all(around, F.lit("[A-Za-z]{3,}"), F.lit(0)))

    def joined(ws: Column) -> Column:
        pairs = F.zip_with(ws, F.slice(ws, F.lit(2), F.size(ws)), lambda x, y: F.array(
            F.concat(x, F.lit("_"), y), F.concat(F.initcap(x), F.initcap(y)),
            F.concat(x, F.lit("-"), y), F.concat(x, F.lit("/"), y), F.concat(x, F.lit("="), y),
            F.upper(F.concat(x, F.lit("_"), y)), F.concat(x, F.lit("_"), F.crc32(y).cast("string"))))
        return F.concat(ws, F.filter(F.flatten(F.slice(pairs, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0)))),
                                     lambda s: s.isNotNull()))

    ordinary = F.transform(F.array(words), joined)[0]
    return sample.select(F.explode(values).alias("s"), F.lit(1).alias("label")) \
        .unionByName(sample.select(F.explode(ordinary).alias("s"), F.lit(0).alias("label")))


def _codes(s: Column) -> Column:
    """Positions of a string's characters in ALPHABET, from 1 (0: another)."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(samples: DataFrame) -> list[float]:
    """Log ratios of the transition probabilities from code a to code b, at
    a * SIZE + b; code 0 stands before the first character.  A table of fixed
    size (SIZE * SIZE)."""
    steps = samples.select("label", F.concat(F.array(F.lit(0)), _codes(F.col("s"))).alias("c")).select(
        "label", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c")),
                                      lambda a, b: a * SIZE + b)).alias("ab"))
    n = steps.groupBy("ab").pivot("label", [0, 1]).count()
    counts = {r["ab"]: (r["0"] or 0, r["1"] or 0) for r in n.collect()}  # SIZE * SIZE rows at most
    sums = [[sum(counts.get(a * SIZE + b, (0, 0))[k] for b in range(SIZE)) for a in range(SIZE)] for k in (0, 1)]
    log_p = lambda a, b, k: math.log(
        (counts.get(a * SIZE + b, (0, 0))[k] + SMOOTHING) / (sums[k][a] + SMOOTHING * (SIZE - 1)))
    return [round(log_p(a, b, 1) - log_p(a, b, 0), 4) for a in range(SIZE) for b in range(SIZE)]


def log_ratio(s: Column, model: list[float]) -> Column:
    """log P(s | random) - log P(s | ordinary)."""
    llr = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one literal
    init = F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("d"))
    step = lambda acc, b: F.struct(b.alias("a"), (acc["d"] + F.get(llr, acc["a"] * SIZE + b)).alias("d"))
    return F.aggregate(_codes(s), init, step, lambda acc: acc["d"])


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with assign, access, hex, markov (arrays of spans) and spans,
    array<struct<start, kind (index in KINDS), stop>> of all of them."""
    text = F.coalesce("text", F.lit(""))
    found = base_spans(docs).withColumn("_runs", find(text, CANDIDATE))
    # a run lies in a base span if of those that begin no later one ends no earlier:
    # in order of their starts (a base span before a run), by the running maximum of ends
    mark = lambda spans, run: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(run).alias("run"), s["stop"].alias("stop"), (s["txt"] if run else F.lit(None).cast("string")).alias("txt")))
    both = F.array_sort(F.concat(mark(F.concat("assign", "access", "hex"), False), mark(F.col("_runs"), True)))

    def uncovered(zs: Column) -> Column:
        ends = running_max(F.transform(zs, lambda z: F.when(z["run"], F.lit(-1)).otherwise(z["stop"]).cast("bigint")))
        runs = F.filter(F.zip_with(zs, ends, lambda z, e: F.when(z["run"] & (e < z["stop"]), z)), lambda z: z.isNotNull())
        return F.filter(runs, lambda s: log_ratio(s["txt"], model) >= threshold)

    # most texts have no base span, or no run outside one
    found = found.withColumn("markov", F.when(F.size(F.concat("assign", "access", "hex")) == 0, F.transform(
        F.filter("_runs", lambda s: log_ratio(s["txt"], model) >= threshold),
        lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))).otherwise(
        F.transform(let(both, uncovered), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))))

    def tagged(i: int) -> Column:
        return F.transform(KINDS[i], lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"), s["stop"].alias("stop")))

    return found.withColumn("spans", F.array_sort(F.concat(*map(tagged, range(len(KINDS)))))).drop("_runs")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` (scanned) with every span, overlapping ones as one, replaced by
    ``mark``; n_chars, where present, is brought up to date."""
    text = F.col("text")

    def clean(ss: Column) -> Column:
        # spans are sorted by start: where the text up to a span's start is not all covered, a gap ends there
        ends = F.concat(F.array(F.lit(0).cast("bigint")), running_max(F.transform(ss, lambda s: s["stop"].cast("bigint"))))

        def gaps(es: Column) -> Column:
            between = F.transform(ss, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(es, i)), F.struct(
                F.get(es, i).alias("start"), s["start"].cast("bigint").alias("stop"))))
            last = F.array(F.struct(F.get(es, F.size(es) - 1).alias("start"), F.length(text).cast("bigint").alias("stop")))
            return F.array_join(cut_out(text, F.concat(F.filter(between, lambda g: g.isNotNull()), last)), mark)

        return let(ends, gaps)

    out = docs.withColumn("text", F.when(F.size("spans") > 0, let(F.col("spans"), clean)).otherwise(text))
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def span_text(spans: Column, kinds: int) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter(spans, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(labelled_samples(docs)))
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(span_text(F.col("spans"), 3), 256).alias("base_sha256"), span_text(F.col("spans"), 4).alias("spans"))
