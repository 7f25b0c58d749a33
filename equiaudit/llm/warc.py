"""WARC archives: writing, reading and transaction assembly (operator 1).

``write_warc`` emits a request, a response (or revisit) and a metadata record
per page.  Records are built as columns and stored by Spark's text writer with
the blank lines that end a WARC record as its line separator, so the files are
committed by Spark's commit protocol and a lost executor leaves no half-written
archive.  Of pages with equal payloads the one with the smallest id is the
response and the others are revisits; only digests are shuffled for that.

``read_warc`` takes each archive as one binary row (``records_per_file`` bounds
what ``write_warc`` puts into one), streams through its gzip members and
returns a row per record.

``assemble`` joins request and metadata records to their capture (response,
revisit or resource) through WARC-Concurrent-To, in either direction and over
one record between, and emits one nested row per capture.

Defined cases: a null payload is empty; a null url writes no target URI; a
null page id is written without a page_id field and reads back as null.
Control characters and spaces of a url are percent-encoded.  Repeated rows are
captures of their own; rows that share the smallest id of a payload are all
responses.  A record that ends early gets ``error`` and no payload.  Other
columns of the pages are ignored.  No pages give no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit.llm.common import scratch_path, written

RECORDS_PER_FILE = 3_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit", "resource")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_SCHEMA = """record_id string, type string, date string, target_uri string, concurrent_to array<string>,
 refers_to_uri string, payload_bytes long, payload_digest string, digest_ok boolean, fields map<string,string>,
 error string, payload binary"""


def base32_sha1(col: Column) -> Column:
    """Bare upper-case base32 SHA-1: every five hex digits make four characters."""
    hexes = F.sha1(col)
    five = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv(
        F.substring(hexes, k * 5 + 1, F.lit(5)), 16, 10).cast("int"))

    def four(v: Column) -> Column:
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1))
                          for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(five, lambda v: four(v)), "")


def _record(kind: str, record_id: Column, date: str, block: Column, content_type: str, *headers: Column) -> Column:
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id,
        F.lit(f"\r\nWARC-Date: {date}\r\n"), *headers,
        F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z",
               records_per_file: int = RECORDS_PER_FILE) -> None:
    body = F.coalesce(F.col(payload_col), F.lit(""))
    uri = F.regexp_replace(F.col(url_col), r"[\x00-\x20\x7F]", "%20")
    base = pages.select(F.col(id_col).alias("id"), uri.alias("uri"), body.alias("body"))
    keys = written(base.select("id", "uri", base32_sha1(F.col("body")).alias("digest"),
                               F.octet_length("body").alias("n")), "payloads")
    first = keys.where(F.col("n") >= min_revisit_bytes).groupBy("digest").agg(
        F.min("id").alias("of"), F.expr("min_by(uri, id)").alias("of_uri"), F.count(F.lit(1)).alias("copies"))
    revisits = written(
        keys.join(first.where("copies > 1"), "digest").where(~F.col("id").eqNullSafe(F.col("of")))
        .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "of_uri", F.lit(True).alias("again"))
        .distinct(), "revisits")

    rows = base.withColumn("digest", base32_sha1(F.col("body")))
    rows = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    rows = rows.withColumn("row", F.monotonically_increasing_id())

    def rid(kind: str) -> Column:
        h = F.md5(F.concat_ws("|", F.lit(kind), F.col("id").cast("string"), "digest", F.col("row").cast("string")))
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
            h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    rows = rows.withColumns({"rid": rid("capture"), "req": rid("request"), "meta": rid("metadata")})
    target = _header("WARC-Target-URI", F.col("uri"))
    to = _header("WARC-Concurrent-To", F.col("rid"))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("body").cast("string"), F.lit("\r\n\r\n"))
    host = F.coalesce(F.call_function("try_parse_url", F.col("uri"), F.lit("HOST")), F.lit(""))
    file = F.coalesce(F.call_function("try_parse_url", F.col("uri"), F.lit("FILE")), F.lit("/"))
    ask = F.concat(F.lit("GET "), file, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    http = "application/http;msgtype="
    response = _record("response", F.col("rid"), date, F.concat(head, F.col("body")), http + "response", target, digest)
    revisit = _record("revisit", F.col("rid"), date, head, http + "response", target, digest,
                      F.lit(f"WARC-Profile: {PROFILE}\r\n"), _header("WARC-Refers-To-Target-URI", F.col("of_uri")))
    request = _record("request", F.col("req"), date, ask, http + "request", target, to)
    note = _record("metadata", F.col("meta"), date, _header("page_id", F.col("id").cast("string")),
                   "application/warc-fields", target, to)
    records = rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), note))
                          .alias("value"))
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


class _Lines:
    """The lines and blocks of an archive, inflated member by member as they are asked for.  Where a compressed one is
    cut or damaged, ``broken`` tells how, and what came before is its end."""

    def __init__(self, content: bytes):
        self.broken: str | None = None
        parts = (content[i:i + (1 << 20)] for i in range(0, len(content), 1 << 20))
        self.parts = self._inflated(content) if content[:2] == b"\x1f\x8b" else parts
        self.held, self.at = b"", 0

    def _inflated(self, content: bytes) -> Iterator[bytes]:
        rest = memoryview(content)
        try:
            while len(rest) and bytes(rest[:1 << 16]).strip(b"\0"):
                member = zlib.decompressobj(31)
                while not member.eof:
                    if not len(rest):
                        self.broken = "archive ends early"
                        return
                    part, rest = rest[:1 << 16], rest[1 << 16:]
                    while not member.eof and len(part):
                        yield member.decompress(part, 1 << 20)
                        part = member.unconsumed_tail
                    if member.unused_data:
                        rest = memoryview(content)[len(content) - len(rest) - len(member.unused_data):]
        except zlib.error as e:
            self.broken = f"archive cannot be read on: {e}"

    def _more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held, self.at = self.held[self.at:] + part, 0
        return True

    def line(self) -> bytes:
        seen = self.at
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held) - self.at
            if not self._more():
                end = len(self.held) - 1
                break
        out, self.at = self.held[self.at:end + 1], end + 1
        return out

    def block(self, size: int) -> bytes:
        parts = []
        while size > 0 and (self.at < len(self.held) or self._more()):
            part = self.held[self.at:self.at + size]
            self.at += len(part)
            size -= len(part)
            parts.append(part)
        return b"".join(parts)


def _parse(content: bytes, payloads: bool) -> Iterator[dict]:
    """A row for each record.  Lines that belong to no record give one row with an error, and reading goes on at the next
    version line; a record or an archive that ends early gives one too."""
    raw = _Lines(content)
    lost = False
    while line := raw.line():
        if not line.strip():
            continue
        row: dict = {"concurrent_to": [], "fields": []}
        if not line.startswith(b"WARC/"):
            if not lost:
                yield row | {"error": "no version line"}
            lost = True
            continue
        lost = False
        head: dict[str, str] = {}
        while (line := raw.line()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            name, value = name.strip().lower(), value.strip()
            if name == "warc-concurrent-to":
                row["concurrent_to"].append(value)
            head[name] = value
        size = int(n) if (n := head.get("content-length", "")).isdigit() else 0
        block = raw.block(size)
        row |= {"record_id": head.get("warc-record-id"), "type": head.get("warc-type"), "date": head.get("warc-date"),
                "target_uri": head.get("warc-target-uri"), "refers_to_uri": head.get("warc-refers-to-target-uri")}
        told = head.get("warc-payload-digest", "").rpartition(":")[2] or None
        if len(block) < size:
            yield row | {"error": raw.broken or "ends early"}
            return
        kind = head.get("content-type", "")
        if kind.startswith("application/warc-fields"):
            fields = (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)
            row["fields"] = [(a.strip(), b.strip()) for a, _, b in fields]
        if row["type"] == "revisit":
            row["payload_digest"] = told
        else:
            payload = block.partition(b"\r\n\r\n")[2] if kind.startswith("application/http") else block
            found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            row |= {"payload_bytes": len(payload), "payload_digest": found, "digest_ok": told in (None, found),
                    "payload": payload if payloads else None}
        yield row
    if raw.broken:
        yield {"concurrent_to": [], "fields": [], "error": raw.broken}


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; without ``payloads`` only their lengths and digests."""
    files = spark.read.format("binaryFile").load(path).select("content")
    arrow = pa.schema([
        ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()),
        ("concurrent_to", pa.list_(pa.string())), ("refers_to_uri", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())),
        ("error", pa.string()), ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[dict] = []
                held = 0
                for row in _parse(content.as_py(), payloads):
                    rows.append(row)
                    held += len(row.get("payload") or b"")
                    if len(rows) >= 1000 or held > 16 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(records, _SCHEMA)


def capture_links(records: DataFrame) -> DataFrame:
    """Distinct (part_id, capture_id): WARC-Concurrent-To in either direction, or by way of one other part."""
    is_capture = F.col("type").isin(*CAPTURES)
    said = records.select("record_id", is_capture.alias("is_capture"), F.explode("concurrent_to").alias("to"))
    captures = records.where(is_capture).select(F.col("record_id").alias("capture_id"))
    named = said.where(~F.col("is_capture")).select(F.col("record_id").alias("part_id"), "to")
    direct = named.join(captures, named["to"] == captures["capture_id"]).select("part_id", "capture_id")
    back = said.where("is_capture").select(F.col("to").alias("part_id"), F.col("record_id").alias("capture_id"))
    near = direct.unionByName(back)
    hop = near.withColumnRenamed("part_id", "via")
    far = named.join(hop, named["to"] == hop["via"]).select("part_id", "capture_id")
    return near.unionByName(far).distinct()


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its columns, ``requests`` and ``metadata`` (arrays of structs)."""
    cols = [c for c in records.columns]
    is_capture = F.col("type").isin(*CAPTURES)
    parts = records.where(~is_capture).select(F.col("record_id").alias("part_id"), F.struct(*cols).alias("part"))
    nested = capture_links(records).join(parts, "part_id").groupBy("capture_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("part.type") == "request", F.struct(
            *[F.col(f"part.{c}").alias(c) for c in cols if c != "fields"])))).alias("requests"),
        F.collect_list(F.when(F.col("part.type") == "metadata", F.col("part"))).alias("metadata"))
    captures = records.where(is_capture)
    return captures.join(nested, captures["record_id"] == nested["capture_id"], "left").drop("capture_id")


def orphans(records: DataFrame) -> DataFrame:
    """Records other than captures that lead to none."""
    linked = capture_links(records).select(F.col("part_id").alias("record_id"))
    return records.where(~F.col("type").isin(*CAPTURES)).join(linked, "record_id", "left_anti")


def pages_through_archives(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to archives, read them back and return (page_id, payload_bytes, payload_digest, record_type,
    refers_to, url) per capture.  A revisit takes its payload's length from the response with its digest."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path, **options)
    records = written(read_warc(spark, path, payloads=False), "records")
    kind = dict(pages.dtypes)[options.get("id_col", "page_id")]
    captures = written(assemble(records).select(
        F.col("metadata")[0]["fields"]["page_id"].cast(kind).alias("page_id"), "type", "target_uri",
        "payload_digest", "payload_bytes"), "captures")
    first = captures.where("type = 'response'").groupBy("payload_digest").agg(
        F.min("page_id").alias("of"), F.max("payload_bytes").alias("of_bytes"))
    again = captures.where("type = 'revisit'").join(first, "payload_digest", "left")
    plain = captures.where("type != 'revisit'").withColumns(
        {"of": F.lit(None).cast(kind), "of_bytes": F.col("payload_bytes")})
    return plain.unionByName(again).select(
        "page_id", F.col("of_bytes").alias("payload_bytes"), "payload_digest", F.col("type").alias("record_type"),
        F.col("of").alias("refers_to"), F.col("target_uri").alias("url"))
