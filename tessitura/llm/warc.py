"""WARC derivative builder: metadata and plain-text conversion records of responses.

A response (target URI, date, HTTP header block, payload) gives two derived records that
refer to it: ``conversion``, whose block is the payload's plain text, and ``metadata``,
whose fields keep the response's identifier, status line, all its header lines in turn and
its digests, and name the conversion record. Only built-in functions run, so nothing is shuffled.

Defined cases: a null payload counts as empty and gives a conversion with empty block; a
null URI leaves out the header WARC-Target-URI; repeated responses give repeated
records; an empty table gives an empty result; clashing columns cannot occur, as only
the key is kept of other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of the text extraction and what stands for a match, in turn.
TEXT_RULES = [
    (r"(?s)<!--.*?(?:-->|\z)", ""),  # what is not closed goes on to the end, so no scan is in vain
    (r"(?is)<(?:script|style)(?:[\s/][^>]*)?>.*?(?:</(?:script|style)\s*>|\z)", " "),
    (r"(?i)</?(?:p|div|br|h[1-6]|li|ul|ol|tr|table|article|nav|title|head|body|section|footer|header)(?:[\s/][^>]*)?>", "\n"),
    (r"(?s)<[^>]*>", ""),
    (r"&nbsp;", " "),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#39;", "'"),
    (r"&amp;", "&"),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+|[ \n]+$", ""),
]
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def plain_text(html: Column) -> Column:
    for pattern, to in TEXT_RULES:
        html = F.regexp_replace(html, pattern, to)
    return html


def record_id(*parts: Column | str) -> Column:
    """A urn:uuid from the md5 of the parts."""
    h = F.md5(F.concat_ws("\n", *parts))
    return F.concat(F.lit("<urn:uuid:"), *[x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(h, a, n)]], F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _joined(*lines: tuple[str, Column]) -> Column:
    """Header lines, without those whose value is null."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in lines])


def derive(responses: DataFrame, key: str) -> DataFrame:
    """Two records per response (key, record_id, target_uri, date, http_headers, payload).

    record is the whole record as it stands in a WARC file, less its last line end.
    """
    r = responses.select(F.col(key), "record_id", "target_uri", "date", "http_headers", F.coalesce("payload", F.lit("")).alias("payload"))
    r = r.withColumns({"text": plain_text(F.col("payload")), "payload_digest": digest(F.col("payload")), "conversion_id": record_id(F.lit("conversion"), "record_id")})
    r = r.withColumn("source_block_digest", digest(F.concat("http_headers", "payload")))
    fields = _joined(
        ("source-record-id", F.col("record_id")), ("source-block-digest", F.col("source_block_digest")), ("source-payload-digest", F.col("payload_digest")),
        ("source-http-status", F.regexp_extract("http_headers", r"^(HTTP/[^\r\n]*)", 1)), ("conversion-record-id", F.col("conversion_id")),
    )
    lines = F.filter(F.split("http_headers", r"\r?\n"), lambda x: (x != "") & ~x.startswith("HTTP/"))
    fields = F.concat(fields, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("source-http-header: "), x, F.lit("\r\n"))), ""))
    made = [
        ("conversion", F.col("conversion_id"), "text/plain; charset=utf-8", F.col("text")),
        ("metadata", record_id(F.lit("metadata"), "record_id"), "application/warc-fields", fields),
    ]
    records = F.array(*[F.struct(F.lit(kind).alias("warc_type"), i.alias("id"), F.lit(content).alias("content_type"), block.alias("block")) for kind, i, content, block in made])
    r = r.select(key, "target_uri", "date", "payload_digest", F.col("record_id").alias("refers_to"), F.explode(records).alias("r")).select("*", "r.*").drop("r")
    r = r.withColumns({"content_length": F.octet_length("block").cast("long"), "block_digest": digest(F.col("block"))})
    head = _joined(
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("id")), ("WARC-Date", F.col("date")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    )
    r = r.withColumn("record", F.concat(F.lit("WARC/1.1\r\n"), head, F.lit("\r\n"), "block", F.lit("\r\n")))
    return r.select(key, "warc_type", F.col("id").alias("record_id"), "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "block", "record")


def write(records: DataFrame, path: str) -> None:
    """Writes the records of derive() as gzipped WARC files."""
    records.select("record").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def page_responses(pages: DataFrame) -> DataFrame:
    """Raw pages (page_id, url, html) as responses."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select("page_id", record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))).alias("record_id"), F.col("url").alias("target_uri"), F.lit(DATE).alias("date"), F.concat(F.lit(HTTP), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).alias("http_headers"), F.col("html").alias("payload"))


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")), "page_id")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = "payload"
    for pattern, to in TEXT_RULES:
        text = f"regexp_replace({text}, {quote(pattern)}, {quote(to)}, 'g')"
    uuid = lambda x: f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'"
    rn = "chr(13) || chr(10)"
    http = " || ".join(f"'{x}'" if x else "''" for x in HTTP.split("\r\n")[:1]) + "".join(f" || {rn} || '{x}'" for x in HTTP.split("\r\n")[1:])
    line = lambda name, value: f"coalesce('{name}: ' || {value} || {rn}, '')"
    fields = " || ".join(line(*x) for x in (("source-record-id", "rid"), ("source-block-digest", "'sha256:' || sha256(headers || payload)"), ("source-payload-digest", "payload_digest"), ("source-http-status", "'HTTP/1.1 200 OK'"), ("conversion-record-id", "cid"), ("source-http-header", "'Content-Type: text/html; charset=utf-8'"), ("source-http-header", "'Content-Length: ' || strlen(payload)::VARCHAR")))
    head = " || ".join(line(*x) for x in (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", f"'{DATE}'"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length::VARCHAR")))
    response = "md5('response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, ''))"
    return f"""
WITH a AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, {uuid(response)} AS rid FROM pages),
b AS (SELECT *, {http} || strlen(payload)::VARCHAR || {rn} || {rn} AS headers, 'sha256:' || sha256(payload) AS payload_digest, md5('conversion' || chr(10) || rid) AS ch, md5('metadata' || chr(10) || rid) AS mh, {text} AS plain FROM a),
c AS (SELECT *, {uuid("ch")} AS cid, {uuid("mh")} AS mid FROM b),
d AS (SELECT page_id, 'conversion' AS warc_type, cid AS record_id, rid AS refers_to, target_uri, 'text/plain; charset=utf-8' AS content_type, payload_digest, plain AS block FROM c
  UNION ALL SELECT page_id, 'metadata', mid, rid, target_uri, 'application/warc-fields', payload_digest, {fields} FROM c),
e AS (SELECT *, strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest FROM d)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, payload_digest, block, 'WARC/1.1' || {rn} || {head} || {rn} || block || {rn} AS record FROM e
"""


SQL = _sql()
