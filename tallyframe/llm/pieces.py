"""SentencePiece encoding and decoding, with a max-plus parallel scan for giant
documents.

Documents of up to CHUNK characters are encoded by the library.  A longer one
is cut into chunks that are encoded in parallel, with the same ids as if it
had been encoded whole.  The model is a BPE model, whose encoding is not the
segmentation of the greatest total score; it is the only segmentation in which
every two neighbours are what BPE makes of their concatenation.  So the scan
runs in the max-plus semiring with weight 0 for such a pair and minus infinity
for any other:

1. ``transfer``: the states at a chunk's edge are the pieces that may cover or
   end at it.  Each chunk yields its matrix from entry to exit states (stored
   as the list of its finite entries), independently of all others.
2. ``resolve``: matrices are multiplied associatively, first within blocks of
   BLOCK chunks, then over the blocks of a document; walking back over the
   products leaves one state at each edge.
3. ``backtrace``: each chunk, on its own, rebuilds its pieces between its two
   states.

No piece of the model crosses the beginning of a run of spaces, so within a
chunk only the text before its first and after its last such point needs the
dynamic programme; what lies between goes to the library.  A chunk without
such a point (a giant word) is covered by the programme alone.

Defined cases: a null or empty text has no ids; texts may hold any characters
(characters outside the vocabulary become bytes); U+2581 decodes to a space,
so a text that holds it does not round-trip; repeated rows are encoded each;
other columns of the input are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import pack, slices, stored, table, unpack

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK, BLOCK = 32_768, 256
EDGE = 64  # characters that a chunk sees of its neighbours, at least the longest piece
SPACE = "▁"


class Pieces:
    """A SentencePiece BPE model and its pairwise compatibility."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))]
        self.id = {sp.id_to_piece(i): i for i in ids}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.longest = max(map(len, self.id))
        if self.longest > EDGE:
            raise ValueError(f"a piece of the model has {self.longest} characters, more than {EDGE}")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces that cross the beginning of a run of spaces are not supported")
        self.split: dict[str, tuple[str, ...]] = {}

    def bpe(self, s: str) -> tuple[str, ...]:
        """Merges of a short string: best score first, then leftmost."""
        if s not in self.split:
            parts = list(s)
            while len(parts) > 1:
                best, k = max((self.score.get(a + b, -float("inf")), -i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == -float("inf"):
                    break
                parts[-k:-k + 2] = [parts[-k] + parts[-k + 1]]
            if len(self.split) > 100_000:
                self.split.clear()
            self.split[s] = tuple(parts)
        return self.split[s]

    def follows(self, a: str, b: str) -> bool:
        return not a or (b[0] == SPACE and a[-1] != SPACE) or self.bpe(a + b) == (a, b)

    def starting(self, text: str, at: int):
        """The pieces (or the single character) that may begin at ``at``."""
        for n in range(1, min(self.longest, len(text) - at) + 1):
            t = text[at:at + n]
            if n == 1 or (t in self.id and self.bpe(t) == (t,)):
                yield t

    def ids(self, piece: str) -> list[int]:
        if piece in self.id:
            return [self.id[piece]]
        return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def paths(self, text: str, begin: dict[tuple[int, int], str], stop: int) -> dict[tuple[int, int], dict]:
        """All pieces reached up to ``stop``, as (start, end) -> the pieces
        that may come before.  ``begin``: entry pieces by (start, end)."""
        came: dict[tuple[int, int], set] = {s: set() for s in begin}
        at: dict[int, set] = {}
        for s in begin:
            at.setdefault(s[1], set()).add(s)
        for q in range(min(at, default=stop), stop):
            before = at.pop(q, None)
            if not before:
                continue
            for t in self.starting(text, q):
                ok = {s for s in before if self.follows(begin[s] if s in begin else text[s[0]:s[1]], t)}
                if ok:
                    came.setdefault((q, q + len(t)), set()).update(ok)
                    at.setdefault(q + len(t), set()).add((q, q + len(t)))
        return came


def safe_points(text: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last position in [lo, hi] where a run of spaces begins."""
    first = next((q for q in range(max(lo, 1), hi + 1) if q < len(text) and text[q] == SPACE != text[q - 1]), None)
    if first is None:
        return None
    return first, next(q for q in range(hi, first - 1, -1) if q < len(text) and text[q] == SPACE != text[q - 1])


def _chunk(row: dict, p: Pieces):
    """Text with its lead, where the chunk begins and ends in it."""
    text = row["lead"] + row["body"] + row["tail"]
    return text, len(row["lead"]), len(row["lead"]) + len(row["body"])


def _entries(text: str, at: int, p: Pieces) -> dict[tuple[int, int], str]:
    """States at edge ``at``: pieces that begin before it and end at or after
    it; only the empty one at the document's beginning."""
    if at == 0:
        return {(0, 0): ""}
    return {(s, s + len(t)): t for s in range(max(0, at - p.longest), at) for t in p.starting(text, s) if s + len(t) >= at}


def _closure(came: dict, ends) -> dict:
    """For each end state, all states on its ways back."""
    out = {}
    for end in ends:
        seen, todo = {end}, [end]
        while todo:
            for s in came.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        out[end] = seen
    return out


def transfer(row: dict, p: Pieces) -> list[tuple[str, str]]:
    """The finite entries of a chunk's matrix: (entry state, exit state), each
    written "start,end" relative to its edge."""
    text, a, b = _chunk(row, p)
    begin = _entries(text, a, p)
    last = not row["tail"]
    name = lambda s, at: f"{s[0] - at},{s[1] - at}"
    exits = lambda came, at_most: [s for s in came if s[0] < b <= s[1] and (not last or s[1] == b)]
    safe = safe_points(text, max((e for _, e in begin), default=a), b)
    if safe is None:
        came = p.paths(text, begin, b)
        ends = exits(came, b)
        back = _closure(came, ends)
        return [(name(s, a), name(e, b)) for e in ends for s in begin if s in back[e]]
    f, g = safe
    came = p.paths(text, begin, f)
    back = _closure(came, [s for s in came if s[1] == f])
    alive = {s for seen in back.values() for s in seen if s in begin}
    if g == b:  # the edge itself is such a point: any piece that ends there
        ends = [s for s in _entries(text, b, p) if s[1] == b]
        ends = [(s, e) for s, e in ends if text[s:e] == _last_piece(text, f, b, p, came)] if f < g else \
            [s for s in came if s[1] == b]
    else:
        ends = exits(p.paths(text, {(g, g): ""}, b), b)
    if f == g == b:
        return [(name(s, a), name(e, b)) for e in ends for s in begin if s in back.get(e, ())]
    return [(name(s, a), name(e, b)) for e in ends for s in alive]


def _last_piece(text: str, f: int, b: int, p: Pieces, came: dict) -> str:
    """The piece that ends at the safe point ``b``, encoded from the last safe
    point before it."""
    lo = safe_points(text, f, b - 1)[1]
    return p.sp.encode(text[lo + 1:b].replace(SPACE, " "), out_type=str)[-1] if not _has_bytes(text[b - 1], p) else text[b - 1]


def _has_bytes(c: str, p: Pieces) -> bool:
    return c not in p.id


def _walk(p: Pieces, text: str, came: dict, begin: dict, state: tuple[int, int], entry=None) -> list[str]:
    """Pieces from an entry state (not included) to ``state`` (included)."""
    out = []
    while state not in begin or (entry is not None and state != entry):
        out.append(text[state[0]:state[1]])
        before = came[state]
        if entry is not None:
            before = [s for s in before if entry in _closure(came, [s])[s]]
        state = next(iter(before))
    return out[::-1]


def backtrace(row: dict, p: Pieces) -> list[int]:
    """The ids of the pieces that end in a chunk or cross its far edge, given
    its entry and exit states."""
    text, a, b = _chunk(row, p)
    state = lambda s, at: tuple(int(x) + at for x in s.split(","))
    entry, exit_ = state(row["entry"], a), state(row["exit"], b)
    begin = {entry: text[entry[0]:entry[1]]}
    safe = safe_points(text, max((e for _, e in _entries(text, a, p)), default=a), b)
    flat = lambda parts: [i for t in parts for i in p.ids(t)]
    if safe is None:
        return flat(_walk(p, text, p.paths(text, begin, b), begin, exit_))
    f, g = safe
    came = p.paths(text, begin, f)
    head = next(s for s in came if s[1] == f)
    out = flat(_walk(p, text, came, begin, head))
    out += p.sp.encode(text[f + 1:g].replace(SPACE, " ")) if g > f else []
    if g < b:
        out += flat(_walk(p, text, p.paths(text, {(g, g): ""}, b), {(g, g): ""}, exit_))
    return out


def _multiply(rows: list) -> list[tuple[str, str]]:
    """Product of consecutive matrices given as lists of finite entries."""
    out = rows[0]
    for m in rows[1:]:
        to: dict[str, list[str]] = {}
        for x, y in m:
            to.setdefault(x, []).append(y)
        out = list(dict.fromkeys((x, z) for x, y in out for z in to.get(y, ())))
    return out


def _edges(rows: list, entry: str | None = None, exit_: str | None = None) -> list[str]:
    """The state at each edge of consecutive matrices (one more than there are
    matrices) on a way from ``entry`` to ``exit_`` (None: any)."""
    reach = [{x for x, _ in rows[0] if entry is None or x == entry}]
    for m in rows:
        reach.append({y for x, y in m if x in reach[-1]})
    out = [exit_ if exit_ is not None else min(reach[-1])]
    for k in range(len(rows) - 1, -1, -1):
        out.append(min(x for x, y in rows[k] if y == out[-1] and x in reach[k]))
    return out[::-1]


def piece_bytes(proto: bytes) -> list[bytes]:
    """What each id adds to a decoded text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
    out = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else
                   " \u2047 ".encode() if sp.is_unknown(i) else piece.replace(SPACE, " ").encode())
    return out


PAIRS = "array<struct<x: string, y: string>>"


def _pairs(column) -> list:
    return [[(d["x"], d["y"]) for d in m] for m in column]


def _encode_giants(giants: DataFrame, proto: bytes) -> DataFrame:
    """(row, norm) -> (row, ids)."""

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text")):
                norm = SPACE + text.as_py().replace(" ", SPACE)
                starts = list(range(0, max(1, len(norm) - CHUNK // 2), CHUNK))  # the last chunk takes a short rest
                for i, s in enumerate(starts):
                    e = starts[i + 1] if i + 1 < len(starts) else len(norm)
                    yield pa.RecordBatch.from_pylist([{"row": row, "i": i, "lead": norm[max(0, s - EDGE):s], "body": norm[s:e],
                                                       "tail": norm[e:e + EDGE]}], schema=chunk_schema)

    chunk_schema = pa.schema([("row", pa.int64()), ("i", pa.int64()), ("lead", pa.string()), ("body", pa.string()),
                              ("tail", pa.string())])

    def matrices(batches):
        p = Pieces(proto)
        for batch in batches:
            rows = batch.to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("i"),
                pa.array([[{"x": x, "y": y} for x, y in transfer(r, p)] for r in rows],
                         pa.list_(pa.struct([("x", pa.string()), ("y", pa.string())])))], names=["row", "i", "m"])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        m = _multiply(_pairs(pdf["m"]))
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "block": pdf["block"].iloc[:1],
                             "bm": [[{"x": x, "y": y} for x, y in m]]})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        edges = _edges(_pairs(pdf["bm"]))
        return pd.DataFrame({"row": pdf["row"], "block": pdf["block"], "entry": edges[:-1], "exit": edges[1:]})

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        edges = _edges(_pairs(pdf["m"]), pdf["entry"].iloc[0], pdf["exit"].iloc[0])
        return pd.DataFrame({"row": pdf["row"], "i": pdf["i"], "entry": edges[:-1], "exit": edges[1:]})

    def back(batches):
        p = Pieces(proto)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("i"),
                pa.array([backtrace(r, p) for r in batch.to_pylist()], pa.list_(pa.int32()))], names=["row", "i", "ids"])

    chunks = stored(giants.mapInArrow(cut, "row long, i long, lead string, body string, tail string")
                    .repartition("row", "i"), "piece-chunks")
    m = stored(chunks.mapInArrow(matrices, f"row long, i long, m {PAIRS}")
               .withColumn("block", F.floor(F.col("i") / BLOCK)), "piece-matrices")
    blocks = m.groupBy("row", "block").applyInPandas(product, f"row long, block long, bm {PAIRS}")
    settled = blocks.groupBy("row").applyInPandas(settle, "row long, block long, entry string, exit string")
    states = m.join(settled, ["row", "block"]).groupBy("row", "block") \
        .applyInPandas(inner, "row long, i long, entry string, exit string")
    ids = chunks.join(states, ["row", "i"]).mapInArrow(back, "row long, i long, ids array<int>")
    return ids.groupBy("row").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "ids"))), lambda s: s["ids"])).alias("ids"))


def _texts_of(ids: pa.Array, piece) -> list[str]:
    """The texts that arrays of ids decode to."""
    ends = np.cumsum([0, *(n or 0 for n in ids.value_lengths().to_pylist())]).tolist()
    parts = list(map(piece, ids.flatten().to_pylist() if ids.null_count else ids.flatten().to_numpy().tolist()))
    return [b"".join(parts[a:b]).decode(errors="replace").removeprefix(" ") for a, b in zip(ends, ends[1:])]


def _coded(docs: DataFrame, model: str, check: bool) -> DataFrame:
    """Packed documents (_in, text) as (_in, ids, same): with ``check``, whether
    the ids decode to the text, told by the worker that made them, so that a
    text crosses to a worker once and does not come back; else null."""
    with open(model, "rb") as f:
        proto = f.read()
    schema = T.StructType([docs.schema["_in"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("same", T.BooleanType())])

    def run(batches):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        piece = piece_bytes(proto).__getitem__ if check else None
        for whole in batches:
            for batch in slices(whole, most=1 << 20):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = pa.array(sp.encode(texts, num_threads=1), pa.list_(pa.int32()))
                same = [a == b for a, b in zip(texts, _texts_of(ids, piece))] if check else [None] * len(texts)
                yield pa.RecordBatch.from_arrays([batch.column("_in"), ids, pa.array(same, pa.bool_())], names=["_in", "ids", "same"])

    long = F.length("text") > CHUNK
    short = docs.where(~F.coalesce(long, F.lit(False))).mapInArrow(run, schema)
    giants = stored(docs.where(long).withColumn("_row", F.monotonically_increasing_id()), "giants")
    ids = _encode_giants(giants.select(F.col("_row").alias("row"), "text"), proto)
    found = giants.join(ids, F.col("_row") == F.col("row")).drop("_row", "row")
    same = F.lit(None).cast("boolean")
    if check:
        found, same = decode(found, model), F.col("decoded") == F.col("text")
    return short.unionByName(found.select("_in", "ids", same.alias("same")))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` with ids (array<int>; a column of this name is replaced)."""
    columns = [c for c in docs.columns if c != "ids"]
    return unpack(_coded(pack(docs, "text"), model, False), [*columns, "ids"], ids=F.col("ids"))


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``docs`` without text, with ids and same, whether they decode to the
    text (columns of these names are replaced)."""
    columns = [c for c in docs.columns if c not in ("text", "ids", "same")]
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_in"))
    return unpack(_coded(packed, model, True), [*columns, "ids", "same"], ids=F.col("ids"), same=F.col("same"))


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """``rows`` (with ids) with decoded, the text of the ids (a column of this
    name is replaced)."""
    with open(model, "rb") as f:
        proto = f.read()
    rows = rows.drop("decoded")
    keep = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches):
        piece = piece_bytes(proto).__getitem__
        for whole in batches:
            for batch in slices(whole, "ids", 1 << 20):
                out = _texts_of(batch.column("ids"), piece)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())],
                                                 names=[*keep, "decoded"])

    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and whether they decode to its text."""
    coded = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.col("same").alias("round_trip"))
