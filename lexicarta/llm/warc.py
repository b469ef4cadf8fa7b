"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response row holds (record_id, target_uri, date, http_headers, body); its two derivatives name it in
WARC-Refers-To and keep its target, its date, its media type and its payload digest. All of it is built-in
functions on rows: no shuffle.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Elements whose content isn't text, and references decoded in text (fixed values of HTML).
HIDDEN = [r"(?s)<!--.*?-->", *(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>" for name in ("script", "style", "noscript", "head"))]
BREAKS = r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>"
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def uuid_of(*parts):
    """A record identifier that follows from what it names, so that a task run again gives the same one."""
    d = F.md5(F.concat_ws("\n", *parts))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(d, a, n) for a, n in cut)), F.lit(">"))


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Stored pages (page_id, url, html) as responses; a null html is an empty body, a null url an empty target.

    The table holds neither headers nor a date, so the status line, media type and length are made from the body, and
    the date is a parameter. derivatives() takes any headers.
    """
    url, body = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF))
    return pages.select(
        "page_id",
        uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
        url.alias("target_uri"),
        F.lit(date).alias("date"),
        headers.alias("http_headers"),
        body.alias("body"),
    )


def visible_text(html):
    """Text of an HTML string: hidden elements go, block ends break lines, tags go, references are decoded, blanks are squeezed."""
    text = html
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in REFERENCES:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\x0b\f]+", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def sha1_digest(data):
    return F.concat(F.lit("sha1:"), F.sha1(data))


def header_lines(*pairs):
    """Named WARC header lines in order; a null value leaves its line out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in pairs]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF + CRLF))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response: (page_id, record_type, record_id, refers_to, target_uri, payload_digest, block_digest, content_length, block, record).

    The metadata block is of warc-fields: the source's status line, each of its header lines, its body's length and
    digest. The conversion block is the visible text. record is the whole record, headers and block, as written in
    a WARC file. A null or empty body is an empty one: its conversion block is empty, its length 0. Null or empty headers give
    no status, header and media lines. Repeated rows give repeated records, and an empty table none. WARC-Source-Payload-Digest is no field of
    the standard: it names the digest of the payload that a record was made from.
    """
    blank = F.lit("")
    responses = responses.withColumns({"body": F.coalesce("body", blank), "http_headers": F.coalesce("http_headers", blank)})
    lines = F.split("http_headers", CRLF)
    status = F.nullif(F.element_at(lines, 1), blank)
    fields = F.array_join(F.transform(F.filter(lines, lambda h, i: (i > 0) & (h != "")), lambda h: F.concat(F.lit("sourceHeader: "), h)), CRLF)
    media = F.nullif(F.regexp_extract("http_headers", r"(?i)\r\nContent-Type:\s*([^\r\n]*)", 1), F.lit(""))
    base = responses.select(
        "*",
        sha1_digest(F.col("body")).alias("payload_digest"),
        status.alias("status"),
        F.nullif(fields, blank).alias("fields"),
        media.alias("media"),
        visible_text(F.col("body")).alias("text"),
    )
    meta = F.concat(
        F.concat_ws(
            CRLF,
            F.concat(F.lit("sourceStatus: "), F.col("status")),
            F.col("fields"),
            F.concat(F.lit("sourceMediaType: "), F.col("media")),
            F.concat(F.lit("sourceLength: "), F.octet_length("body").cast("string")),
            F.concat(F.lit("sourceDigest: "), F.col("payload_digest")),
        ),
        F.lit(CRLF),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("type"), meta.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("type"), F.col("text").alias("block")),
    )
    rows = base.select("page_id", "record_id", "target_uri", "date", "payload_digest", F.explode(kinds).alias("k"))
    rows = rows.select(
        "page_id",
        "k.record_type",
        uuid_of(F.col("k.record_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "payload_digest",
        "k.type",
        "k.block",
        sha1_digest(F.col("k.block")).alias("block_digest"),
        F.octet_length("k.block").cast("long").alias("content_length"),
    )
    head = header_lines(
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.col("record_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")),
        ("WARC-Source-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("type")),
        ("Content-Length", F.col("content_length").cast("string")),
    )
    return rows.withColumn("record", F.concat(head, F.col("block"), F.lit(CRLF + CRLF))).drop("date", "type")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """The records as WARC files in Spark's own layout; each record ends as the format asks.

    With compression="gzip" each file is one stream, not one for each record: readers go through it, but can't jump.
    """
    records.select(F.expr(f"substr(record, 1, length(record) - {len(CRLF)})").alias("value")).write.option("lineSep", CRLF).option("compression", compression).text(path)
