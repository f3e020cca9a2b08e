"""WARC derivatives: metadata and plain-text conversion records of stored responses, and record files."""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, block string, block_digest string, payload_digest string, content_length long"
COLUMNS = [part.split()[0] for part in RECORD.split(", ")]

HIDES = re.compile(r"<!--|<(script|style|template|noscript)\b", re.I)
CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "template", "noscript", "title")}
BREAKS = re.compile(r"</?(?:address|article|aside|blockquote|br|div|dd|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|title|tr|ul)\b[^>]*>", re.I)
TAGS = re.compile(r"<[a-zA-Z/!?][^>]*>")
ANCHOR, HREF, BARE = re.compile(r"<a\b", re.I), re.compile(r"\bhref\s*=\s*", re.I), re.compile(r"[^\s>]+")
BLANKS = re.compile(r"[ \t\r\f\v]+")


def digest_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name_of(*parts: str) -> str:
    """A record id that depends on its parts alone."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode()).digest(), version=4)}>"


def shown(page: str) -> str:
    """The page without comments, scripts, styles, templates and noscript parts; one that is not closed hides the rest."""
    out, at = [], 0
    while found := HIDES.search(page, at):
        out += [page[at:found.start()], " "]
        if found[1]:
            close = CLOSES[found[1].lower()].search(page, found.end())
            end = close.end() if close else -1
        else:
            close = page.find("-->", found.end())
            end = close + 3 if close >= 0 else -1
        if end < 0:
            return "".join(out)
        at = end
    return "".join(out) + page[at:]


def plain_text(page: str) -> str:
    """Visible text: no comments, scripts or styles, a line for each block, entities resolved, blanks collapsed.

    Every search goes on where the last one ended. Tags end at a `>`, so what stands behind the last one is text.
    """
    page = shown(page).replace("\n", " ")
    last = page.rfind(">") + 1
    text = TAGS.sub("", BREAKS.sub("\n", page[:last])) + page[last:]
    lines = (BLANKS.sub(" ", line).strip() for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def title_of(page: str) -> str | None:
    """Inside of the first title; where it does not end, none does."""
    found = re.search("<title", page, re.I)
    start = page.find(">", found.end()) if found else -1
    close = CLOSES["title"].search(page, start + 1) if start >= 0 else None
    return page[start + 1:close.start()] if close else None


def links_of(page: str) -> list[str]:
    """Values of the first href with a value in each anchor, quoted or bare, as they stand."""
    out, at, open_quotes = [], 0, set()
    while anchor := ANCHOR.search(page, at):
        end = page.find(">", anchor.end())
        at = stop = end if end >= 0 else len(page)
        here = anchor.end()
        while name := HREF.search(page, here, stop):
            here = name.end()
            quote = page[here:here + 1]
            close = page.find(quote, here + 1) if quote in ('"', "'") and quote not in open_quotes else -1
            if close >= 0:
                out.append(page[here + 1:close])
                at = close + 1
                break
            if quote in ('"', "'"):
                open_quotes.add(quote)  # none of them closes from here on
            if bare := BARE.match(page, here):
                out.append(bare[0])
                at = bare.end()
                break
    return out


def one_line(text: str) -> str:
    return " ".join(text.split())


def header_fields(block: str) -> tuple[str, str]:
    """HTTP header and payload of a response block."""
    head, mark, payload = block.partition("\r\n\r\n")
    return (head, payload) if mark else ("", block)


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """One response record for each page: the key and the record columns.

    Null html is an empty payload, a null url a record without a target; the record id depends on key, url and html, so
    repeated rows give the same record again. Other columns of pages are dropped.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, u, h in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload = (h or "").encode("utf-8", "replace")
                block = HTTP.encode() + payload
                own = digest_of(payload)
                rows.append((k, name_of("response", str(k), u or "", own), "response", None, u, date, "application/http; msgtype=response", block.decode(), digest_of(block), own, len(block)))
            yield as_batch(rows, batch.schema.field(0).type)

    return pages.select(key, url, html).mapInArrow(made, f"key {pages.schema[key].dataType.simpleString()}, {RECORD}").withColumnRenamed("key", key)


def derived(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for each response: `metadata` (source headers, digests, title, links) and `conversion` (plain text).

    Both name the response in refers_to and keep its target and date. A response without an HTTP header has no header
    lines; an empty payload gives an empty text; records of other types give nothing. A null key stays null, repeated
    rows give the same two records again, other columns are dropped. Rows are handled one Arrow batch at a time, each
    text whole and in one forward pass.
    """
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, record, target, date, block, block_digest, payload_digest in zip(*(c.to_pylist() for c in batch.columns)):
                head, page = header_fields(block or "")
                title = title_of(page)
                links = [one_line(entities.unescape(x)) for x in links_of(page)]
                lines = [f"source-block-digest: {block_digest}", f"source-payload-digest: {payload_digest}", f"source-payload-length: {len(page.encode())}"]
                lines += [f"source-header: {one_line(x)}" for x in head.split("\r\n") if x]
                lines += [f"title: {one_line(entities.unescape(TAGS.sub('', title)))}"] if title is not None else []
                lines += [f"outlink: {x}" for x in links if x]
                for kind, media, body in (("metadata", "application/warc-fields", "".join(f"{x}\r\n" for x in lines)), ("conversion", "text/plain; charset=utf-8", plain_text(page))):
                    data = body.encode("utf-8", "replace")
                    own = digest_of(data)
                    rows.append((k, name_of(kind, record or "", own), kind, record, target, date, media, data.decode(), own, own, len(data)))
            yield as_batch(rows, batch.schema.field(0).type)

    kind = records.schema[key].dataType.simpleString()
    source = records.where("warc_type = 'response'").select(key, "record_id", "target_uri", "warc_date", "block", "block_digest", "payload_digest")
    return source.mapInArrow(made, f"key {kind}, {RECORD}").withColumnRenamed("key", key)


def as_batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    types = [key_type] + [pa.string()] * 9 + [pa.int64()]
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["key", *COLUMNS])


def record_text() -> Column:
    """A record as it stands in a file, but for the line end behind it."""
    line = lambda name, column: F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))).otherwise("")
    named = (("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))
    return F.concat(F.lit("WARC/1.1\r\n"), *[line(n, c) for n, c in named], F.lit("\r\n"), "block", F.lit("\r\n"))


def write_records(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """WARC files under `folder`, one for each partition of records."""
    records.select(record_text()).write.option("lineSep", "\r\n").option("compression", compression).text(folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files under `folder`, with `whole`: the block has the length that its header states.

    Files are cut where the next record begins. A block that holds such a cut itself comes back with whole = false; no
    such record passes as whole. Header names are matched in any case.
    """
    raw = spark.read.option("lineSep", "\r\n\r\nWARC/1.1\r\n").text(folder).where("length(value) > 0")
    parts = raw.select(F.regexp_replace("value", r"^WARC/1\.1\r\n", "").alias("t")).withColumn("cut", F.instr("t", "\r\n\r\n"))
    parts = parts.withColumn("head", F.when(F.col("cut") > 0, F.substr("t", F.lit(1), F.col("cut") - 1)).otherwise(F.col("t")))
    value = lambda name: F.nullif(F.regexp_extract("head", rf"(?im)^{name}: *(.*?)\r?$", 1), F.lit(""))
    length, rest = value("Content-Length").cast("long"), F.when(F.col("cut") > 0, F.substr("t", F.col("cut") + 4)).otherwise("")
    # The last record of a file still has the line ends behind it.
    ended = (F.octet_length(rest) == length + 4) & F.endswith(rest, F.lit("\r\n\r\n"))
    out = parts.select(
        value("WARC-Record-ID").alias("record_id"), value("WARC-Type").alias("warc_type"), value("WARC-Refers-To").alias("refers_to"),
        value("WARC-Target-URI").alias("target_uri"), value("WARC-Date").alias("warc_date"), value("Content-Type").alias("content_type"),
        F.when(ended, F.substr(rest, F.lit(1), F.length(rest) - 4)).otherwise(rest).alias("block"), value("WARC-Block-Digest").alias("block_digest"),
        value("WARC-Payload-Digest").alias("payload_digest"), length.alias("content_length"),
    )
    return out.withColumn("whole", F.coalesce(F.octet_length("block") == F.col("content_length"), F.lit(False)))
