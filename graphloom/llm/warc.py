"""WARC archives: write request, response or revisit, and metadata records for each page, read them back, assemble transactions.

Writing stays in Spark's text writer: a record ends with CRLF CRLF, which is
the writer's line separator, and files are committed by Spark's own protocol, so
a lost executor leaves no half archive. Reading parses by Content-Length, so a
payload may hold anything, a record's first line included. The records of a
capture are joined through WARC-Concurrent-To into one nested row.

Defined results: a null payload is empty; a null url becomes an empty target; a
page given twice is captured twice, and of equal payloads every row that has the
smallest id is a response; ids may be of any type and hold anything, and a null
id comes back null; an empty table gives an empty archive; other columns are
ignored. A payload that does not have the digest its record says stops the read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, new_path

_CRLF = "\r\n"
#: The two base32 alphabets.
_HEX32, _RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
#: Date of the records; the pages carry none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures an archive file holds at most; readers take a file as a whole.
CAPTURES = 1000
#: What an id must not hold inside a header, and how it is written there.
_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (">", "%3E"), (" ", "%20"))


def _escaped(value: Column) -> Column:
    text = value.cast("string")
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return F.when(text == "", "%00").otherwise(text)


def _unescaped(text: Column) -> Column:
    out = text
    for plain, written in reversed(_ESCAPES):
        out = F.replace(out, F.lit(written), F.lit(plain))
    return F.when(text == "%00", "").otherwise(out)


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 20 bits at a time give 4 digits."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)])
    return F.translate(digits, _HEX32, _RFC32)


def _record(kind: str, fields: list[tuple[str, Column]], block: Column, length: Column) -> Column:
    head = [F.lit(f"{VERSION}{_CRLF}WARC-Type: {kind}")]
    for name, value in [*fields, ("Content-Length", length.cast("string"))]:
        head.append(F.concat(F.lit(f"{_CRLF}{name}: "), value))  # a null value drops the line
    return F.concat(*[F.coalesce(x, F.lit("")) for x in head], F.lit(_CRLF * 2), block)


def plan_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``pages`` with ``payload, payload_bytes, payload_digest, first``: ``first`` is the smallest id with an equal payload, if that is another.

    Only digests and ids are shuffled, pre-aggregated; only payloads that
    several rows share are joined back.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    whole = pages.withColumn("payload", payload).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    whole = whole.withColumn("payload_digest", base32(F.col("sha1"))).drop("sha1")
    counted = whole.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min(id_col).alias("first"), F.count("*").alias("rows"))
    # written first, so that its true size decides whether payloads have to be shuffled for the join
    shared = materialize(counted.where("rows > 1").select(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "first"), "revisits")
    joined = whole.join(shared, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left").drop("d", "b")
    return joined.withColumn("first", F.when(F.col("first") != F.col(id_col), F.col("first")))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Archives under ``path``: gzip files of at most ``CAPTURES`` pages, three records a page."""
    only = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    p = plan_revisits(only, "id", "html", least_bytes)
    # the row number tells rows of equal id apart
    uid = F.concat(F.coalesce(_escaped(F.col("id")), F.lit("null")), F.lit("/"), F.monotonically_increasing_id().cast("string"))
    urn = lambda part: F.concat(F.lit("<urn:graphloom:"), part, F.lit(">"))
    p = p.withColumn("capture", urn(F.concat(F.lit("capture/"), uid)))
    side = lambda kind: F.concat(F.regexp_replace("capture", ">$", ""), F.lit(f"/{kind}>"))
    uri = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "[\\r\\n]", " ")
    common = lambda record_id: [("WARC-Record-ID", record_id), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri)]

    get = F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{_CRLF}User-Agent: graphloom{_CRLF * 2}"))
    request = _record("request", [*common(side("request")), ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/http; msgtype=request"))], get, F.octet_length(get))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(_CRLF * 2))
    seen = F.col("first").isNotNull()
    block = F.when(seen, head).otherwise(F.concat(head, F.col("payload")))
    length = F.octet_length(head) + F.when(seen, F.lit(0)).otherwise(F.col("payload_bytes"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    answer = [*common(F.col("capture")), ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest)]
    refers = [("WARC-Profile", F.when(seen, F.lit(PROFILE))), ("WARC-Refers-To", F.when(seen, urn(F.concat(F.lit("page/"), _escaped(F.col("first"))))))]
    response = F.when(seen, _record("revisit", [*answer, *refers], block, length)).otherwise(_record("response", answer, block, length))
    facts = F.concat(F.lit("pageId: "), F.coalesce(_escaped(F.col("id")), F.lit("")), F.lit(_CRLF))
    metadata = _record("metadata", [*common(side("metadata")), ("WARC-Concurrent-To", F.col("capture")), ("Content-Type", F.lit("application/warc-fields"))], facts, F.octet_length(facts))
    records = p.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * CAPTURES).text(path)


def _stream(content: bytes) -> io.BufferedIOBase:
    """Plain bytes of an archive of one or many gzip members, decompressed as it is read."""
    if content[:2] != b"\x1f\x8b":
        return io.BytesIO(content)

    class Unzip(io.RawIOBase):
        def __init__(self) -> None:
            self.z, self.at, self.rest = zlib.decompressobj(31), 0, b""

        def readable(self) -> bool:
            return True

        def readinto(self, out) -> int:
            while not self.rest:
                if self.z.eof:
                    tail = self.z.unused_data
                    if not tail and self.at >= len(content):
                        return 0
                    self.z, self.rest = zlib.decompressobj(31), b""
                    self.rest = self.z.decompress(tail + content[self.at : self.at + (1 << 18)])
                    self.at += 1 << 18
                elif self.at >= len(content):
                    raise EOFError("an archive is cut off")
                else:
                    self.rest = self.z.decompress(content[self.at : self.at + (1 << 18)])
                    self.at += 1 << 18
            n = min(len(out), len(self.rest))
            out[:n], self.rest = self.rest[:n], self.rest[n:]
            return n

    return io.BufferedReader(Unzip(), 1 << 20)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record, by Content-Length."""
    f = _stream(content)
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := f.readline()).strip():
            name, _, value = line.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(headers["content-length"])
        block = f.read(size)
        if len(block) < size:
            raise EOFError("a record is cut off")
        yield headers, block


_FIELDS = "type string, record_id string, concurrent_to string, target_uri string, refers_to string, digest string, payload_bytes long, digest_ok boolean, page_id string"


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row a record. Digests of response payloads are recomputed; payloads are kept only on demand."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    schema = _FIELDS + (", payload binary" if payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 6 + [pa.int64(), pa.bool_(), pa.string()] + [pa.binary()] * payload
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for b in batches:
            for content in b.column(0):
                for h, block in parse(content.as_py()):
                    kind, size, ok, page, body = h["warc-type"], None, None, None, None
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        said = next((x.split(b":", 1)[1] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"0")
                        size = int(said) if kind == "revisit" else len(body)
                        ok = None if kind == "revisit" else base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                    elif kind == "metadata":
                        page = next((x[8:] for x in block.decode().split("\r\n") if x.startswith("pageId: ")), None) or None
                    row = (kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest, size, ok, page)
                    out.append((*row, body) if payload else row)
                    held += len(body or b"") if payload else 0
                    if len(out) >= 2048 or held > 8 << 20:
                        yield batch()
                        out, held = [], 0
        if out:
            yield batch()

    return map_batches(files, rows, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: ``capture_id, response, request, metadata``.

    Each capture has its own key, so the rows of one key are few. A capture
    without a response is left out; a missing side is null.
    """
    key = F.coalesce(F.col("concurrent_to"), F.col("record_id"))
    whole = F.struct(*[F.col(c) for c in records.columns])
    side = lambda *kinds: F.max(F.when(F.col("type").isin(*kinds), whole))
    return records.groupBy(key.alias("capture_id")).agg(side("response", "revisit").alias("response"), side("request").alias("request"), side("metadata").alias("metadata")).where("response is not null")


def roundtrip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """``id_col, payload_bytes, payload_digest, record_type, refers_to, target_uri, digest_ok`` from archives written to ``path`` (in the shared folder by default)."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(pages, path, id_col, url_col, payload_col, least_bytes)
    t = assemble(read_warc(spark, path))
    kind = pages.schema[id_col].dataType
    digest = F.when(F.coalesce(F.col("response.digest_ok"), F.lit(True)), F.col("response.digest")).otherwise(F.raise_error(F.concat(F.lit("a payload is damaged: "), F.col("capture_id"))))
    refers = F.regexp_extract("response.refers_to", "page/([^>]*)>", 1)
    return t.select(
        _unescaped(F.col("metadata.page_id")).cast(kind).alias(id_col), F.col("response.payload_bytes").alias("payload_bytes"), digest.alias("payload_digest"), F.col("response.type").alias("record_type"),
        _unescaped(F.nullif(refers, F.lit(""))).cast(kind).alias("refers_to"), F.col("response.target_uri").alias("target_uri"), F.col("response.digest_ok").alias("digest_ok"),
    )
