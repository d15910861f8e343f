"""WARC derivatives: responses become linked metadata and conversion records.

Each response yields a ``metadata`` record (application/warc-fields: title,
language, source headers, digests, outlinks) and a ``conversion`` record (plain
text), both naming the response they refer to. Column functions only, but for
the reader of WARC files, which parses bytes.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOFTWARE = "sieveloom"
EPOCH = "1970-01-01T00:00:00Z"
_S = r"[ \t\n\f\r/]"
#: Left out with all they hold.
HIDDEN = "(?is)<(?:" + "|".join([r"!--.*?-->"] + [rf"{t}(?:{_S}[^>]*)?>.*?</{t}[ \t\n\f\r]*>" for t in ("script", "style", "head", "noscript", "template")]) + ")"
#: Tags that begin or end a line.
BREAKS = rf"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|aside|header|footer|main|nav|blockquote|pre|form|body|html)(?:{_S}[^>]*)?>"
TAGS = r"</?[a-zA-Z!?][^>]*>"
#: White space that is not one plain space already (most of it is, and is passed over).
SPACES = r"[ \t\x0B\f\r\x{A0}]{2,}|[\t\x0B\f\r\x{A0}]"
NUMBERED = r"^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6})$"
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™", "mdash": "—", "ndash": "–", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "bull": "•", "middot": "·", "euro": "€", "pound": "£", "sect": "§", "deg": "°",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "szlig": "ß", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "ntilde": "ñ",
}


def unescape(text: Column) -> Column:
    """Character references decoded, once each; unknown ones stay as they are."""
    named = F.create_map(*[F.lit(x) for kv in ENTITIES.items() for x in kv])

    def one(part: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        rest = F.substring(part, F.length(name) + 2, F.length(part))
        code = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10).cast("long")).otherwise(F.substring(name, 2, 7).cast("long"))
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        good = name.rlike(NUMBERED) & (code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF))
        plain = F.concat(F.lit("&"), part)
        # the commonest first; each branch is computed only where it is taken
        return (
            F.when(part.startswith("amp;"), F.concat(F.lit("&"), F.substring(part, F.lit(5), F.length(part))))
            .when(~part.contains(";"), plain)
            .when(part.startswith("#"), F.when(good, F.concat(char, rest)).otherwise(plain))
            .otherwise(F.coalesce(F.concat(named[name], rest), plain))
        )

    def whole(parts: Column) -> Column:
        return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))

    # a lambda's variable is computed once; an expression named thrice, three times
    return F.transform(F.array(F.split(text, "&")), whole)[0]


def plain_text(html: Column) -> Column:
    """Visible text: a line for each block, single spaces, no empty lines."""
    out = F.regexp_replace(html, HIDDEN, " ")
    out = F.regexp_replace(out, r"[\n\r]+", " ")
    out = F.regexp_replace(out, BREAKS, "\n")
    out = unescape(F.regexp_replace(out, TAGS, ""))
    out = F.regexp_replace(out, SPACES, " ")
    out = F.regexp_replace(out, r" ?\n[ \n]*", "\n")
    return F.btrim(out, F.lit(" \n"))


def sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid that follows from its parts, the same on every run."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def responses_of_pages(pages: DataFrame, date: str = EPOCH) -> DataFrame:
    """Response records of a table of pages ``page_id, url, html``."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        record_id(F.col("page_id"), F.col("url"), F.lit("response")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string")).alias("http_headers"),
        F.col("html").alias("payload"),
    )


def derive(responses: DataFrame, extra: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two records for each response, ``metadata`` and ``conversion``.

    ``responses``: ``record_id, target_uri, date, http_headers, payload`` and, if
    there, ``payload_digest``, the source's own digest of the payload's bytes, and
    ``warc_headers``, the source record's header lines; both are kept. Returns
    the ``extra`` columns and ``warc_type, record_id, refers_to, target_uri, date,
    content_type, source_digest, digest, length, headers, block``. Defined
    results: a null payload counts as empty, its source digest is that of no
    bytes; null headers give no header lines; a null URI is left out of the
    header; a null record id refers to ``<urn:uuid:>``'s own derived id of no
    parts; repeated responses give repeated records; no rows give no rows.
    """
    html = F.coalesce("payload", F.lit(""))
    there = responses.columns
    own_digest = F.coalesce("payload_digest", sha256(html)) if "payload_digest" in there else sha256(html)
    warc_lines = F.coalesce("warc_headers", F.lit("")) if "warc_headers" in there else F.lit("")
    base = responses.select(
        *extra, F.coalesce("record_id", record_id(F.lit(None))).alias("refers_to"), "target_uri", F.coalesce("date", F.lit(EPOCH)).alias("date"),
        F.coalesce("http_headers", F.lit("")).alias("http_headers"), html.alias("html"), own_digest.alias("source_digest"), warc_lines.alias("warc_headers"),
    )
    title = plain_text(F.regexp_extract("html", rf"(?is)<title(?:{_S}[^>]*)?>(.*?)</title", 1))
    lang = F.regexp_extract("html", r"(?i)<html[^>]*[ \t\n\f\r]lang[ ]*=[ ]*[\"']?([A-Za-z0-9-]+)", 1)
    # values are one line each: a header or field cannot be split by what a page holds
    links = F.regexp_extract_all("html", F.lit(r"(?i)<a[ \t\n\f\r][^>]*href[ ]*=[ ]*[\"']([^\"'<>\n\r]*)[\"']"), 1)
    status = F.regexp_extract("http_headers", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    source = F.regexp_extract_all("http_headers", F.lit(r"([^\r\n]+)"), 1)
    fields = F.array_join(
        F.concat(
            F.array(F.concat(F.lit("title: "), F.regexp_replace(title, r"[\r\n]+", " ")), F.concat(F.lit("language: "), lang), F.concat(F.lit("http-status: "), status), F.concat(F.lit("source-digest: "), F.col("source_digest"))),
            F.transform(source, lambda x: F.concat(F.lit("source-header: "), x)),
            *([F.transform(F.regexp_extract_all("warc_headers", F.lit(r"([^\r\n]+)"), 1), lambda x: F.concat(F.lit("source-warc-header: "), x))] if "warc_headers" in there else []),
            F.transform(links, lambda x: F.concat(F.lit("outlink: "), x)),
        ),
        "\r\n",
    )
    both = base.select(
        *extra, "refers_to", "target_uri", "date", "source_digest",
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(fields, F.lit("\r\n")).alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("html")).alias("block")),
        )).alias("r"),
    ).select(*extra, "refers_to", "target_uri", "date", "source_digest", "r.*")
    both = both.withColumn("record_id", record_id(F.col("refers_to"), F.col("warc_type"))).withColumn("digest", sha256(F.col("block"))).withColumn("length", F.octet_length("block").cast("long"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    headers = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Date", F.col("date")),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("target_uri", r"[\r\n]", "")), F.lit("")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Source-Payload-Digest", F.col("source_digest")), line("WARC-Block-Digest", F.col("digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("length").cast("string")),
    )
    return both.select(*extra, "warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_digest", "digest", "length", headers.alias("headers"), "block")


def write_warc(records: DataFrame, path: str, compression: str | None = None) -> None:
    """Write derived records as WARC files: each line of the text writer is a
    record, each line end the two line ends that close one."""
    options = {"lineSep": "\r\n\r\n"} | ({"compression": compression} if compression else {})
    records.select(F.concat("headers", F.lit("\r\n"), "block")).write.options(**options).text(path)


def parse_warc(data: bytes):
    """Yield ``(headers as a dict of lower-case names, block)`` of a WARC file's records."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            size = int(headers.get("content-length", "0"))
        except ValueError:
            size = 0
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def decoded(body: bytes, head: bytes) -> str:
    """A payload as text, by the charset that its HTTP header names, else UTF-8."""
    named = re.search(rb"(?i)charset=[\"']?([a-z0-9_-]+)", head)
    try:
        return body.decode(named[1].decode() if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str, types: tuple[str, ...] = ("response",)) -> DataFrame:
    """Records of WARC files (plain or gzip): ``record_id, warc_type, target_uri,
    date, refers_to, http_headers, payload, payload_digest, block_digest,
    warc_headers``. Digests are the source's own, or else those of the bytes as they
    are, before any decoding. A file is read whole by one task and may hold 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = ("record_id", "warc_type", "target_uri", "date", "refers_to", "http_headers", "payload", "payload_digest", "block_digest", "warc_headers")
    digest = lambda data: "sha256:" + hashlib.sha256(data).hexdigest()

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(content.as_py()):
                    if h.get("warc-type") not in types:
                        continue
                    head, _, body = block.partition(b"\r\n\r\n") if h.get("content-type", "").startswith("application/http") else (b"", b"", block)
                    rows.append((
                        h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), head.decode("utf-8", "replace"), decoded(body, head),
                        h.get("warc-payload-digest") or digest(body), h.get("warc-block-digest") or digest(block), "\r\n".join(f"{k}: {v}" for k, v in h.items()),
                    ))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names=list(names))

    return files.mapInArrow(run, ", ".join(f"{n} string" for n in names))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
