"""WARC derivatives: responses to linked metadata and plain-text conversion records.

``responses`` gives the response records of a table of pages, as a crawler would have written them;
``read_warcs`` those of WARC files; ``derive`` makes two records from each response, a metadata
record (application/warc-fields) and a conversion record (text/plain). Both name the response in
WARC-Refers-To and carry its target, date and payload digest on, and the metadata its WARC and HTTP headers;
record ids follow from the response's id, so a rerun or a lost executor gives the same ones. ``write`` stores
the records as .warc files.

A body is read by its headers: transfer and content encodings are undone (chunked; gzip, deflate, zstd), and
its characters are those of the charset in Content-Type, of a byte order mark, or of a meta element, in this
order; else they are UTF-8, or windows-1252 where that doesn't fit.

Defined results: a null url gives no WARC-Target-URI; null html is an empty payload, with an empty
conversion, as are bodies that are no text by their type and those whose encoding isn't known; repeated rows
give records with the same ids; texts of any length come whole; a null page_id counts as no id in the record
id's name; responses without a date give records without one, and ``write`` puts a date to them; an empty
table gives an empty one; of WARC bytes, what isn't a whole record with a length is passed over. Other columns
are ignored.
"""

from __future__ import annotations

import base64
import codecs
import datetime
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .html_text import visible_text

CRLF = "\r\n"
#: Bytes of records that are handed to Spark at once, about.
BATCH_BYTES = 1 << 24
#: Bytes that are inflated at once.
STEP = 1 << 20
#: A record whose header lines take more than this is broken.
MOST_HEADER = 1 << 20
#: Content types of marked-up and plain text; what has none is told by the tags in it.
MARKUP = ("text/html", "application/xhtml+xml")
DERIVED = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, block_digest string, payload_digest string, content_length long, headers string, block string"
NAMES = [part.split(" ")[0] for part in DERIVED.split(", ")]


def digest(data: bytes) -> str:
    """A labelled SHA-1 in base 32, as WARC writers give it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join('' if p is None else str(p) for p in parts))}>"


def field_lines(fields: list[tuple[str, object]]) -> str:
    """A line for each field that has a value; control characters in it are percent-encoded, or they would begin lines of their own."""
    value = lambda v: re.sub(r"[\x00-\x08\x0A-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", str(v))
    return "".join(f"{k}: {value(v)}{CRLF}" for k, v in fields if v is not None)


def header_block(fields: list[tuple[str, object]]) -> str:
    return "WARC/1.1" + CRLF + field_lines(fields)


def http_block(html: str | None, content_type: str = "text/html; charset=utf-8") -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    return f"HTTP/1.1 200 OK{CRLF}Content-Type: {content_type}{CRLF}Content-Length: {len(body)}{CRLF}{CRLF}".encode() + body


class Inflated(io.RawIOBase):
    """The bytes of gzip members one after the other, as far as they are whole, a step at a time."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.unpack = memoryview(data), 0, b"", zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.held:
            part = self.unpack.unconsumed_tail
            if not part:
                part = self.data[self.at : self.at + STEP]
                self.at += len(part)
            if not part:
                self.held, self.unpack = self.unpack.flush(), zlib.decompressobj(31)
                break
            try:
                self.held = self.unpack.decompress(part, STEP)
            except zlib.error:  # no more of it can be read
                self.at, self.unpack = len(self.data), zlib.decompressobj(31)
                break
            if self.unpack.eof:
                self.at -= len(self.unpack.unused_data)
                self.unpack = zlib.decompressobj(31)
        n = min(len(into), len(self.held))
        into[:n], self.held = self.held[:n], self.held[n:]
        return n


def header_lines(lines: list[str]) -> Iterator[tuple[str, str]]:
    """(name, value) of header lines; folded lines are joined."""
    name, value = "", ""
    for line in [*lines, "end:"]:
        if line[:1] in (" ", "\t") and name:
            value += " " + line.strip()
            continue
        if name:
            yield name, value
        name, colon, value = line.partition(":")
        name, value = name.strip() if colon else "", value.strip()


def taken(stream: BinaryIO, length: int) -> bytes:
    """So many bytes, or as many as there are."""
    parts = []
    while length and (part := stream.read(min(length, STEP))):
        parts.append(part)
        length -= len(part)
    return b"".join(parts)


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, one in memory at a time; header names in lower case.

    A record whose length isn't a number, or overruns the file, is passed over, up to the next line that begins one.
    """
    while line := stream.readline(MOST_HEADER):
        if not line.startswith(b"WARC/"):
            continue
        lines, size = [], 0
        while (line := stream.readline(MOST_HEADER)) not in (b"\r\n", b"\n", b"") and size < MOST_HEADER:
            lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
            size += len(line)
        if size >= MOST_HEADER:
            continue  # no header has that much
        headers = {name.lower(): value for name, value in header_lines(lines)}
        length = headers.get("content-length", "")
        if not re.fullmatch(r"[0-9]{1,18}", length):
            continue
        if isinstance(stream, io.BytesIO) and int(length) > stream.getbuffer().nbytes - stream.tell():
            continue
        block = taken(stream, int(length))
        if len(block) == int(length):
            yield headers, block
        else:
            stream = io.BytesIO(block)  # records may stand in what it took for its block


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of WARC bytes, which may be gzip members."""
    return records(io.BufferedReader(Inflated(data), STEP) if data[:2] == b"\x1f\x8b" else io.BytesIO(data))


def payload(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """The HTTP headers and body of a response's block."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return [], block
    return list(header_lines(head.decode("utf-8", "replace").split(CRLF)[1:])), body


def unchunked(body: bytes) -> bytes:
    """The chunks of a body put together, as far as they go; a body without any as it is."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0 and (size := re.fullmatch(rb"\s*([0-9A-Fa-f]{1,15})\s*(?:;.*)?", body[at:end])):
        n = int(size[1], 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return b"".join(out) if out else body


def inflated(body: bytes, encoding: str) -> bytes | None:
    """A body without one content encoding; as it is where that was undone before, None where it can't be."""
    if encoding in ("", "identity"):
        return body
    if encoding in ("gzip", "x-gzip"):
        return io.BufferedReader(Inflated(body), STEP).read() if body[:2] == b"\x1f\x8b" else body
    if encoding == "deflate":
        for bits in (15, -15):
            try:
                return zlib.decompress(body, bits)
            except zlib.error:
                continue
    if encoding == "zstd":
        import zstandard

        try:
            return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True).read()
        except zstandard.ZstdError:
            return None
    return None


def charset_of(content_type: str, body: bytes) -> str | None:
    """The codec that a body names, where Python has it."""
    end = re.search(rb"</head\s*>|<body[\s>]", body, re.I)
    meta = re.search(rb"<meta\s[^>]*?charset\s*=\s*[\"']?\s*([\w.:-]+)", body[: end.start()] if end else body, re.I)
    marks = [name for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")) if body.startswith(mark)]
    named = re.search(r"charset\s*=\s*[\"']?\s*([\w.:-]+)", content_type, re.I)
    for name in ([named[1]] if named else []) + marks + ([meta[1].decode("ascii", "replace")] if meta else []):
        try:
            codec = codecs.lookup(name).name
        except LookupError:
            continue
        # As browsers do: Latin-1 and ASCII are read as their superset, and a page that could be read so far isn't in UTF-16.
        return "cp1252" if codec in ("iso8859-1", "ascii") else "utf-8" if codec.startswith("utf-16") and not marks else codec
    return None


def text_of(headers: list[tuple[str, str]], body: bytes) -> str:
    """The plain text of a response's body; none where it isn't text."""
    first = {name.lower(): value for name, value in reversed(headers)}
    if "chunked" in first.get("transfer-encoding", "").lower():
        body = unchunked(body)
    for encoding in reversed(first.get("content-encoding", "").lower().split(",")):
        body = inflated(body, encoding.strip())
        if body is None:
            return ""
    content_type = first.get("content-type", "")
    kind = content_type.partition(";")[0].strip().lower()
    if kind and kind not in MARKUP and not kind.startswith("text/") or not kind and b"\0" in body and not body.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return ""
    codec = charset_of(content_type, body)
    try:
        text = body.decode(codec or "utf-8", "replace" if codec else "strict")
    except (UnicodeDecodeError, LookupError, TypeError):  # no charset told, or a codec that isn't one of text
        text = body.decode("cp1252", "replace")
    if kind in MARKUP or not kind and re.search(r"\A\s*<[a-zA-Z!?]|<(?:html|head|body|div|p|br)[\s/>]", text, re.I):
        return visible_text(text)
    return text


def derive_one(headers: dict[str, str], block: bytes) -> list[tuple]:
    """The metadata and the conversion of one response, as rows without page_id."""
    refers, target, date = headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-date")
    http, body = payload(block)
    source = headers.get("warc-payload-digest") or digest(body)
    text = text_of(http, body).encode("utf-8", "replace")
    kept = [*(("sourceWarcHeader-" + k, v) for k, v in headers.items()), *(("sourceHeader-" + k, v) for k, v in http)]
    fields = [("sourcePayloadDigest", source), ("sourceBlockDigest", headers.get("warc-block-digest") or digest(block)), ("sourceContentLength", len(body)), *kept]
    meta = field_lines(fields).encode("utf-8", "replace")
    out = []
    for kind, mime, data in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(kind, refers, target)
        of_payload = digest(data) if kind == "conversion" else None
        head = [
            ("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", refers), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date),
            ("WARC-Block-Digest", digest(data)), ("WARC-Payload-Digest", of_payload), ("WARC-Source-Payload-Digest", source), ("Content-Type", mime), ("Content-Length", len(data)),
        ]
        out.append((kind, own, refers, target, date, mime, digest(data), source, len(data), header_block(head), data.decode("utf-8")))
    return out


def response_headers(page_id: object, url: str | None, date: str | None, block: bytes, body_digest: str) -> dict[str, str]:
    fields = {"warc-type": "response", "warc-record-id": record_id("response", page_id, url), "warc-block-digest": digest(block), "warc-payload-digest": body_digest}
    return fields | {k: v for k, v in (("warc-target-uri", url), ("warc-date", date)) if v is not None}


RESPONSE = "page_id long, headers map<string, string>, block binary"


def responses(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """(page_id, headers, block) of a response record for each page; ``date`` is a column of crawl dates, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads, blocks = batch.column(0).to_pylist(), [], []
            for page_id, url, html, when in zip(ids, batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                block = http_block(html.as_py())
                heads.append(list(response_headers(page_id, url, when, block, digest(payload(block)[1])).items()))
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(heads, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.binary())], names=["page_id", "headers", "block"])

    when = (F.lit(None) if date is None else date).cast("string").alias("when")
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), when).mapInArrow(run, RESPONSE)


def read_warcs(files: DataFrame) -> DataFrame:
    """(page_id null, headers, block) of the response records in files as ``spark.read.format("binaryFile")`` gives them; gzip members too.

    A task holds a file as it is stored and about BATCH_BYTES of its records; members are inflated a step at a time.
    """

    def rows(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        heads = pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string()))
        return pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), heads, pa.array([b for _, b in found], pa.binary())], names=["page_id", "headers", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                held, size = [], 0
                for headers, block in parse(data.as_py() or b""):
                    if headers.get("warc-type", "").lower() == "response":
                        held.append((headers, block))
                        size += len(block)
                    if size > BATCH_BYTES:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    return files.select("content").mapInArrow(run, RESPONSE)


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: its metadata and its conversion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            out = []
            for page_id, heads, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                out += [(page_id, *row) for row in derive_one(dict(heads or []), block.as_py() or b"")]
            columns = list(zip(*out, strict=True)) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)

    return records.select("page_id", "headers", "block").mapInArrow(run, DERIVED)


def write(derived: DataFrame, path: str, created: str | None = None) -> None:
    """The records as .warc files, one for each partition. Records without a date get ``created``, or the time of this call."""
    now = created or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    version = "WARC/1.1" + CRLF
    dated = F.concat(F.lit(f"{version}WARC-Date: {now}{CRLF}"), F.col("headers").substr(F.lit(len(version) + 1), F.length("headers")))
    record = F.concat(F.when(F.col("date").isNull(), dated).otherwise(F.col("headers")), F.lit(CRLF), "block")
    derived.select(record.alias("value")).write.mode("overwrite").option("lineSep", CRLF + CRLF).text(path)
    # Spark's writer of text names its files .txt.
    spark = derived.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, "part-*.txt")):
        name = file.getPath().getName()
        store.rename(file.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt") + ".warc"))
