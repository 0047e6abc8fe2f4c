"""Chat formatting, in Spark expressions only.

A conversation's rows are collected as structs, sorted, adjacent turns of the
same role merged by one array aggregation, and concatenated under a template.
The template's control strings are

    <s> </s>             open and close a block (merged turns of one role)
    [INST] [/INST]       around a user block's body
    [SYS] [/SYS]         around a system block's body
    [ROLE] [/ROLE]       around the name of any other role
    [PART]               between the merged turns of a block

An assistant block has no tag.  Inside texts and role names a backslash is
doubled and a control string gets a backslash after its first character, so
no text can hold a control string and every text can be read back.

Defined cases: rows of a conversation are ordered by (turn, role, text), null
turns first; a null role or text counts as empty; rows without conv_id form
one conversation with a null id; repeated rows are turns like any other; an
empty table gives an empty result.  A conversation is one record: its
formatted text must fit in one (2 GB) value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import cut_out, let, running_ends, table

CONTROL = r"(<|\[)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|PART\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def merge_turns(turns: Column) -> Column:
    """array<struct<role, text>> -> array<struct<role, parts>>: adjacent turns
    of the same role become the parts of one block.  A block begins where a
    turn's role differs from the one before; its turns are a slice, so each
    turn is handled once, however many there are."""
    def merged(ts: Column) -> Column:
        first = F.filter(F.transform(ts, lambda t, i: F.when((i == 0) | (F.get(ts, i - 1)["role"] != t["role"]), i)),
                         lambda i: i.isNotNull())

        def blocks(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(ts)))
            return F.zip_with(at, ends, lambda a, e: F.struct(
                F.get(ts, a)["role"].alias("role"),
                F.transform(F.slice(ts, a + 1, e - a), lambda t: t["text"]).alias("parts")))

        empty = F.expr("cast(array() as array<struct<role: string, parts: array<string>>>)")
        return F.when(F.size(ts) == 0, empty).otherwise(let(first, blocks))

    return let(turns, merged)


def _segments(b: Column) -> Column:
    """A block as array<struct<txt, loss>>: tags and texts in output order."""
    seg = lambda txt, loss: F.struct(txt.alias("txt"), F.lit(loss).alias("loss"))
    is_assistant = b["role"] == "assistant"
    head = F.when(is_assistant, F.lit("<s>")).when(b["role"] == "user", F.lit("<s>[INST]")) \
        .when(b["role"] == "system", F.lit("<s>[SYS]")) \
        .otherwise(F.concat(F.lit("<s>[ROLE]"), escape(b["role"]), F.lit("[/ROLE]")))
    foot = F.when(b["role"] == "user", F.lit("[/INST]</s>")).when(b["role"] == "system", F.lit("[/SYS]</s>")) \
        .otherwise(F.lit("</s>"))
    parts = F.flatten(F.transform(b["parts"], lambda p, i: F.when(
        i == 0, F.array(F.struct(escape(p).alias("txt"), is_assistant.alias("loss")))).otherwise(
        F.array(seg(F.lit("[PART]"), False), F.struct(escape(p).alias("txt"), is_assistant.alias("loss"))))))
    return F.concat(F.array(seg(head, False)), parts, F.array(seg(foot, False)))


def format_conversations(df: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: array<struct<start, stop>> (code points
    of ``formatted``, stop exclusive; one span per assistant turn)."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = df.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("turns"))
    blocks = merge_turns(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    segments = convs.select("conv_id", F.flatten(F.transform(blocks, _segments)).alias("segments"))
    lengths = F.transform("segments", lambda s: F.length(s["txt"]).cast("bigint"))
    spans = F.filter(F.arrays_zip(F.col("segments").alias("s"), running_ends(lengths).alias("stop")),
                     lambda z: z["s"]["loss"])
    return segments.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["txt"]), "").alias("formatted"),
        F.transform(spans, lambda z: F.struct(
            (z["stop"] - F.length(z["s"]["txt"])).alias("start"), z["stop"].alias("stop"))).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The original turns, array<struct<role, text>>, from a formatted text."""

    def block(b: Column) -> Column:
        rest = F.substring(b, F.lit(4), F.length(b))
        inner = lambda tag: F.substring(
            rest, F.lit(len(tag) + 3), F.length(rest) - 2 * len(tag) - 5)
        cut = F.locate("[/ROLE]", rest)
        role = F.when(rest.startswith("[INST]"), F.lit("user")).when(rest.startswith("[SYS]"), F.lit("system")) \
            .when(rest.startswith("[ROLE]"), unescape(F.substring(rest, F.lit(7), cut - 7))) \
            .otherwise(F.lit("assistant"))
        body = F.when(rest.startswith("[INST]"), inner("INST")).when(rest.startswith("[SYS]"), inner("SYS")) \
            .when(rest.startswith("[ROLE]"), F.substring(rest, cut + 7, F.length(rest))).otherwise(rest)
        return F.transform(F.split(body, r"\[PART\]"),
                           lambda p: F.struct(role.alias("role"), unescape(p).alias("text")))

    blocks = F.split(formatted, "</s>")
    return F.transform(F.array(blocks), lambda bs: F.flatten(
        F.transform(F.slice(bs, F.lit(1), F.size(bs) - 1), block)))[0]


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(cut_out(formatted, spans), unescape), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from the output."""
    hard = spark.range(0, 2, 1, 1).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    read = format_conversations(rows).select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    say = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", say), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT CAST(-7 AS BIGINT), CAST(i AS BIGINT), CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) t(i)
), esc AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'),
             '(<|\[)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|PART\])', '\1\\\2', 'g')) AS n,
         length(regexp_replace(replace(role, '\', '\\'),
             '(<|\[)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|PART\])', '\1\\\2', 'g')) AS nr,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(n + CASE WHEN prev = role THEN 6 WHEN role = 'user' THEN 20 WHEN role = 'system' THEN 18
                         WHEN role = 'assistant' THEN 7 ELSE 20 + nr END) AS BIGINT) AS formatted_chars
FROM esc GROUP BY conv_id
"""
