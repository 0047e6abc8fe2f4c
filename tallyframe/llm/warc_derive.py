"""WARC derivative builder: from response records to linked metadata and
plain-text conversion records.

``derive`` takes response records (record_id, target_uri, warc_date,
http_headers, payload) and returns two records for each: a ``conversion``
(the payload's plain text) and a ``metadata`` record (application/warc-fields)
that names the conversion and keeps the source's status line, headers and
digests.  Both carry WARC-Refers-To with the response's record id.  Ids are
derived from content, so a rerun or a recomputed task makes the same records.

Defined cases: a null payload counts as empty, a null URI or header block as
absent (no WARC-Target-URI line, empty source headers); repeated rows give
repeated records with the same ids; other columns of the responses are kept,
those named like an output replaced; references without a semicolon or of no known name stay as text, numbers that
are no character become U+FFFD; a script, style or comment that is not closed
stays as text; an empty table gives an empty result.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import table

CRLF = "\r\n"
CRAWL_DATE = "2024-01-01T00:00:00Z"  # the pages table has no date; the response records get this one

# character references: the named ones of HTML, the commonest first, and the
# characters that numbers of the C1 range stand for
COMMON = ["amp", "lt", "gt", "quot", "nbsp", "apos", "copy", "mdash", "ndash", "hellip"]
NAMED = {n: html5[f"{n};"] for n in COMMON} | {n[:-1]: c for n, c in html5.items() if n.endswith(";")}
C1 = [bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160)]
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
BETWEEN, AFTER = "\x01", "\x02"
# patterns in the order in which they apply, and what replaces them
STRIP = [(r"(?s)<!--.*?-->", " "), (r"(?is)<script\b.*?</script\s*>", " "), (r"(?is)<style\b.*?</style\s*>", " "),
         (r"(?is)<head\b.*?</head\s*>", " "),
         (r"(?is)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|body|html|title)\b[^>]*>", "\n"),
         (r"(?s)<[!/?a-zA-Z][^>]*>", ""), (r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+|[ \n]+$", "")]


OUT = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", "content_length",
       "block_digest", "source_payload_digest", "source_block_digest", "source_headers", "block", "warc_headers"]


def _character(ref: Column) -> Column:
    """What a character reference stands for; itself if it is not one."""
    digits = F.regexp_replace(ref, "^&#[xX]?0*|;$", "")
    code = F.when(F.length(digits) > 7, F.lit(0x110000)).when(digits == "", F.lit(0)) \
        .when(F.substring(ref, 3, 1).isin("x", "X"), F.conv(digits, 16, 10).cast("int")).otherwise(digits.cast("int"))
    number = F.transform(F.array(code), lambda n: F.when((n >= 128) & (n < 160), F.element_at(
        F.split(F.lit(AFTER.join(C1)), AFTER), n - 127))
        .when((n == 0) | (n > 0x10FFFF) | ((n >= 0xD800) & (n < 0xE000)), F.lit("\ufffd"))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))[0]
    names = F.str_to_map(F.lit(AFTER.join(f"&{n};{BETWEEN}{c}" for n, c in NAMED.items())), F.lit(AFTER), F.lit(BETWEEN))
    return F.when(F.startswith(ref, F.lit("&#")), number).otherwise(F.coalesce(F.element_at(names, ref), ref))


def _decoded(text: Column) -> Column:
    """``text`` with its character references decoded, each once."""
    chars = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _character)
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, REFERENCE), chars, lambda p, c: F.array(p, F.coalesce(c, F.lit(""))))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def plain_text(html: Column) -> Column:
    """Markup to text: blocks become lines, scripts, styles, comments and the
    head go, character references are decoded."""
    out = html
    for pattern, by in STRIP:
        out = F.regexp_replace(out, pattern, by)
    return F.transform(F.array(out), _decoded)[0]


def urn(seed: Column) -> Column:
    h = F.md5(seed)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
                    F.lit(">"))


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def responses_from_pages(pages: DataFrame) -> DataFrame:
    """Response records of crawled pages; page_id is kept as the row's key."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", F.col("url").alias("target_uri"), F.lit(CRAWL_DATE).alias("warc_date"), html.alias("payload"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.octet_length(html).cast("string"), F.lit("\r\n\r\n")).alias("http_headers"),
        urn(F.concat_ws("|", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                        F.coalesce("url", F.lit("")), F.sha2(html, 256))).alias("record_id"))


def derive(responses: DataFrame) -> DataFrame:
    """Two rows per response: record_type, record_id, refers_to, target_uri,
    warc_date, content_type, content_length, block_digest,
    source_payload_digest, source_block_digest, source_headers, block and
    warc_headers (the record's header block as written to a file)."""
    own = {"http_headers", "payload", "text", "conversion_id", "metadata_id", *(c for c in OUT if c != "page_id")}
    keep = [c for c in responses.columns if c not in own]
    payload, headers = F.coalesce("payload", F.lit("")), F.coalesce("http_headers", F.lit(""))
    src = responses.select(
        *keep, F.col("record_id").alias("refers_to"), "target_uri", "warc_date",
        F.regexp_replace(headers, r"(\r\n)+$", "").alias("source_headers"),
        digest(payload).alias("source_payload_digest"), digest(F.concat(headers, payload)).alias("source_block_digest"),
        plain_text(payload).alias("text"),
        urn(F.concat(F.lit("conversion|"), F.col("record_id"))).alias("conversion_id"),
        urn(F.concat(F.lit("metadata|"), F.col("record_id"))).alias("metadata_id"))
    fields = F.concat(
        F.lit("source-status: "), F.replace("source_headers", F.lit(CRLF), F.lit(f"{CRLF}source-header: ")), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.col("source_payload_digest"), F.lit(CRLF),
        F.lit("source-block-digest: "), F.col("source_block_digest"), F.lit(CRLF),
        F.lit("derived-conversion: "), F.col("conversion_id"), F.lit(CRLF),
        F.lit("derived-digest: "), digest(F.col("text")), F.lit(CRLF))
    record = lambda kind, rid, ctype, block: F.struct(
        F.lit(kind).alias("record_type"), F.col(rid).alias("record_id"), F.lit(ctype).alias("content_type"),
        block.alias("block"))
    both = src.select(*[c for c in src.columns if c not in ("text", "conversion_id", "metadata_id")], F.inline(F.array(
        record("conversion", "conversion_id", "text/plain; charset=utf-8", F.col("text")),
        record("metadata", "metadata_id", "application/warc-fields", fields))))
    full = both.withColumn("content_length", F.octet_length("block").cast("bigint")) \
        .withColumn("block_digest", digest(F.col("block")))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit(CRLF))
    return full.withColumn("warc_headers", F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length"))))


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records as WARC files, one file per partition."""
    records.select(F.concat("warc_headers", F.lit(CRLF), "block").alias("value")) \
        .write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversion and metadata records of every page."""
    return derive(responses_from_pages(table(spark, sf_dir, "pages"))).select(*OUT)


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, by in STRIP:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(by)}, 'g')"
    among = lambda items, at: f"string_split({quote(AFTER.join(items))}, {quote(AFTER)})[{at}]"
    digits = "regexp_replace(ref, '^&#[xX]?0*|;$', '', 'g')"
    code = f"""CASE WHEN length({digits}) > 7 THEN 1114112 WHEN {digits} = '' THEN 0
      WHEN lower(ref[3]) = 'x' THEN CAST('0x' || {digits} AS INTEGER) ELSE CAST({digits} AS INTEGER) END"""
    name = f"list_position(string_split({quote(AFTER.join(f'&{n};' for n in NAMED))}, {quote(AFTER)}), ref)"
    character = f"""CASE WHEN starts_with(ref, '&#') THEN list_transform([{code}], lambda n:
      CASE WHEN n BETWEEN 128 AND 159 THEN {among(C1, 'n - 127')}
        WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(n) END)[1]
      ELSE coalesce({among(NAMED.values(), name)}, ref) END"""
    text = f"""list_transform([{text}], lambda x: CASE WHEN NOT contains(x, '&') THEN x ELSE array_to_string(list_transform(
      list_zip(string_split_regex(x, '{REFERENCE}'), list_transform(regexp_extract_all(x, '{REFERENCE}'), lambda ref: {character})),
      lambda z: z[1] || coalesce(z[2], '')), '') END)[1]"""
    uuid = lambda seed: (
        f"'<urn:uuid:' || regexp_replace(md5({seed}), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '\\1-\\2-\\3-\\4-\\5') || '>'")
    nl = "chr(13) || chr(10)"
    return rf"""
WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' ||
             strlen(payload) || {nl} || {nl} AS h,
             {uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(target_uri, '') || '|' || sha256(payload)")} AS rid
      FROM p),
s AS (SELECT page_id, target_uri, rid AS refers_to, '{CRAWL_DATE}' AS warc_date, h[:-5] AS source_headers,
             'sha256:' || sha256(payload) AS source_payload_digest, 'sha256:' || sha256(h || payload) AS source_block_digest,
             {text} AS text, {uuid("'conversion|' || rid")} AS cid, {uuid("'metadata|' || rid")} AS mid FROM r),
b AS (SELECT * EXCLUDE (text, cid, mid), 'conversion' AS record_type, cid AS record_id,
             'text/plain; charset=utf-8' AS content_type, text AS block FROM s
      UNION ALL
      SELECT * EXCLUDE (text, cid, mid), 'metadata', mid, 'application/warc-fields',
             'source-status: ' || replace(source_headers, {nl}, {nl} || 'source-header: ') || {nl} || 'source-payload-digest: ' || source_payload_digest || {nl} ||
             'source-block-digest: ' || source_block_digest || {nl} || 'derived-conversion: ' || cid || {nl} ||
             'derived-digest: sha256:' || sha256(text) || {nl} FROM s),
f AS (SELECT *, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM b)
SELECT {", ".join(OUT[:-1])},
       'WARC/1.1' || {nl} || 'WARC-Type: ' || record_type || {nl} || 'WARC-Record-ID: ' || record_id || {nl} ||
       'WARC-Refers-To: ' || refers_to || {nl} || coalesce('WARC-Target-URI: ' || target_uri || {nl}, '') ||
       'WARC-Date: ' || warc_date || {nl} || 'WARC-Block-Digest: ' || block_digest || {nl} ||
       'Content-Type: ' || content_type || {nl} || 'Content-Length: ' || content_length || {nl} AS warc_headers
FROM f"""


SQL = _sql()
