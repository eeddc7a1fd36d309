"""WARC derivatives: metadata and plain-text conversion records from responses, linked to their sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm.spans import duck_quoted

DATE = "2024-01-31T00:00:00Z"
#: In this order; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: What is taken out of a page, and what stands in its place.
MARKUP = (
    (r"(?s)<!--.*?(-->|\z)", " "),
    (r"(?is)<script\b.*?(</script>|\z)", " "),
    (r"(?is)<style\b.*?(</style>|\z)", " "),
    (r"(?is)<title\b.*?(</title>|\z)", " "),
    (r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|header|footer|nav|body|head|html|blockquote|pre)\b[^>]*(>|\z)", "\n"),
    (r"<[A-Za-z/!?][^>]*(>|\z)", ""),
)
SPACES = ((r"[\x20\t\r\f\x0B]+", " "), (r"\x20?\n\x20?", "\n"), (r"\n{2,}", "\n"), (r"^[\x20\n]+|[\x20\n]+\z", ""))
TITLE = r"(?is)<title\b[^>]*>(.*?)(</title>|\z)"
LINK = r"""(?i)<a\b[^>]*?\bhref="([^"]*)\""""
_NUMBER = "&#([0-9]{1,7});"


def _uuid(digest: Column) -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def decoded(text: Column) -> Column:
    """Character references as characters: decimal numbers of valid code points, and the named ones of ``ENTITIES``."""
    # bound once, as what ``text`` is made by would else run for each of its uses
    return F.transform(F.array(text), _decoded)[0]


def _decoded(text: Column) -> Column:
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)))
    usable = F.filter(numbers, lambda n: n.cast("int").between(1, 55295) | n.cast("int").between(57344, 1114111))

    def one(sofar: Column, number: Column) -> Column:
        return F.replace(sofar, F.concat(F.lit("&#"), number, F.lit(";")), F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32"))

    # few texts hold numbers
    out = F.when(F.contains(text, F.lit("&#")), F.aggregate(usable, text, one)).otherwise(text)
    for name, character in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(character))
    return out


def plain_text(html: Column) -> Column:
    for pattern, instead in MARKUP:
        html = F.regexp_replace(html, pattern, instead)
    text = decoded(html)
    for pattern, instead in SPACES:
        text = F.regexp_replace(text, pattern, instead)
    return text


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\x00-\x20]+", " "))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A response record per page: page_id, record_id, target_uri, date, http (the header block), payload, payload_digest.

    Null html is an empty payload, a null url an empty target. Ids derive from the content, so that reruns agree.
    """
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    identity = F.md5(F.concat_ws("\n", F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url, html))
    return pages.select(
        "page_id", _uuid(identity).alias("record_id"), one_line(url).alias("target_uri"), F.lit(date).alias("date"), http.alias("http"),
        html.alias("payload"), _digest(html).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """Two records for each response: a metadata record and a plain-text conversion record.

    page_id, warc_type, record_id, refers_to, target_uri, n_links, n_chars (of the text), block_digest, record (the whole record as text, without
    the two line ends that close it). Both refer to the response by its id, and keep its target, date, HTTP status and headers
    and payload digest. Every response gives both, also where its text is empty; repeated rows give repeated records.
    """
    fields = records.select(
        "*", plain_text(F.col("payload")).alias("text"), one_line(decoded(F.regexp_extract("payload", TITLE, 1))).alias("title"),
        F.regexp_extract_all("payload", F.lit(LINK), F.lit(1)).alias("links"),
        F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]+)", 1).alias("status"),
        F.regexp_replace(F.regexp_replace("http", r"^[^\r\n]*\r\n", ""), r"(?m)^([^\r\n:]+): ", "http-$1: ").alias("headers"),
    )
    links = F.concat_ws("", F.transform("links", lambda x: F.concat(F.lit("outlink: "), one_line(decoded(x)), F.lit("\r\n"))))
    body = F.concat(
        F.lit("http-status: "), F.col("status"), F.lit("\r\n"), F.regexp_replace("headers", r"\r\n\r\n\z", "\r\n"),
        F.lit("source-payload-digest: "), F.col("payload_digest"), F.lit("\r\ntitle: "), F.col("title"), F.lit("\r\n"), links,
    )
    blocks = fields.select("*", F.explode(F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("content"), body.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("content"), F.col("text").alias("block")),
    )).alias("b"))
    kind, block = F.col("b.kind"), F.col("b.block")
    made = blocks.select(
        "page_id", kind.alias("warc_type"), _uuid(F.md5(F.concat_ws("\n", kind, "record_id", block))).alias("own_id"), "record_id", "target_uri", "date",
        "payload_digest", F.size("links").cast("long").alias("n_links"), F.length("text").cast("long").alias("n_chars"), F.col("b.content").alias("content"),
        block.alias("block"), _digest(block).alias("block_digest"),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("warc_type"), F.lit("\r\nWARC-Record-ID: "), F.col("own_id"), F.lit("\r\nWARC-Date: "), F.col("date"),
        F.lit("\r\nWARC-Target-URI: "), F.col("target_uri"), F.lit("\r\nWARC-Refers-To: "), F.col("record_id"),
        F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("target_uri"), F.lit("\r\nWARC-Refers-To-Date: "), F.col("date"),
        F.lit("\r\nWARC-Source-Payload-Digest: "), F.col("payload_digest"), F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"),
        F.lit("\r\nContent-Type: "), F.col("content"), F.lit("\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), F.col("block"),
    )
    return made.select(
        "page_id", "warc_type", F.col("own_id").alias("record_id"), F.col("record_id").alias("refers_to"), "target_uri", "n_links", "n_chars", "block_digest",
        record.alias("record"),
    )


def write_records(derived: DataFrame, path: str) -> None:
    """WARC files: each record and the two line ends that close it."""
    derived.select("record").write.option("lineSep", "\r\n\r\n").text(path)


def derivative_table(pages: DataFrame) -> DataFrame:
    """:func:`derivatives` of all pages, each record given by its SHA-256."""
    out = derivatives(responses(pages))
    return out.withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def duck_sql(date: str = DATE) -> str:
    """The same table in DuckDB."""
    q = duck_quoted

    def uuid(digest: str) -> str:
        parts = " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"('<urn:uuid:' || {parts} || '>')"

    def dec(text: str) -> str:
        usable = (
            f"list_filter(list_distinct(regexp_extract_all({text}, {q(_NUMBER)}, 1)), "
            "lambda n: CAST(n AS INT) BETWEEN 1 AND 55295 OR CAST(n AS INT) BETWEEN 57344 AND 1114111)"
        )
        out = f"list_reduce(list_concat([{text}], {usable}), lambda a, n: replace(a, '&#' || n || ';', chr(CAST(n AS INT))))"
        for name, character in ENTITIES:
            out = f"replace({out}, {q(name)}, {q(character)})"
        return out

    def sub(text: str, rules) -> str:
        for pattern, instead in rules:
            text = f"regexp_replace({text}, {q(pattern)}, {q(instead)}, 'g')"
        return text

    def line(text: str) -> str:
        return f"trim(regexp_replace({text}, '[\\x00-\\x20]+', ' ', 'g'), ' ')"

    end = "chr(13) || chr(10)"
    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, {uuid("md5('response' || chr(10) || coalesce(CAST(page_id AS VARCHAR), '') || chr(10) || url || chr(10) || html)")} AS response_id,
  {line('url')} AS target_uri, html, 'sha256:' || sha256(html) AS payload_digest,
  {sub(dec(sub('html', MARKUP)), SPACES)} AS text, {line(dec(f"regexp_extract(html, {q(TITLE)}, 1)"))} AS title,
  regexp_extract_all(html, {q(LINK)}, 1) AS links FROM p),
b AS (SELECT *, unnest([
  {{'kind': 'metadata', 'content': 'application/warc-fields', 'block': 'http-status: 200' || {end} || 'http-Content-Type: text/html; charset=utf-8' || {end}
    || 'http-Content-Length: ' || strlen(html) || {end} || 'source-payload-digest: ' || payload_digest || {end} || 'title: ' || title || {end}
    || array_to_string(list_transform(links, lambda x: 'outlink: ' || {line(dec('x'))} || {end}), '')}},
  {{'kind': 'conversion', 'content': 'text/plain; charset=utf-8', 'block': text}}]) AS u FROM r),
m AS (SELECT page_id, u.kind AS warc_type, {uuid("md5(u.kind || chr(10) || response_id || chr(10) || u.block)")} AS record_id, response_id AS refers_to,
  target_uri, CAST(len(links) AS BIGINT) AS n_links, CAST(length(text) AS BIGINT) AS n_chars, 'sha256:' || sha256(u.block) AS block_digest, payload_digest, u.content AS content,
  u.block AS block FROM b)
SELECT page_id, warc_type, record_id, refers_to, target_uri, n_links, n_chars, block_digest, sha256('WARC/1.1' || {end} || 'WARC-Type: ' || warc_type || {end}
  || 'WARC-Record-ID: ' || record_id || {end} || 'WARC-Date: {date}' || {end} || 'WARC-Target-URI: ' || target_uri || {end} || 'WARC-Refers-To: ' || refers_to
  || {end} || 'WARC-Refers-To-Target-URI: ' || target_uri || {end} || 'WARC-Refers-To-Date: {date}' || {end} || 'WARC-Source-Payload-Digest: ' || payload_digest
  || {end} || 'WARC-Block-Digest: ' || block_digest || {end} || 'Content-Type: ' || content || {end} || 'Content-Length: ' || strlen(block) || {end} || {end}
  || block) AS record_sha256 FROM m
"""
