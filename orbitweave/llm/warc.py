"""WARC files: reading, derivative records, writing.

A response becomes two linked records: `metadata` (application/warc-fields: what the response said
about itself, its outlinks and digests) and `conversion` (text/plain: its visible text). Both keep
the response's target URI and date, name it in WARC-Refers-To, WARC-Refers-To-Target-URI and
WARC-Refers-To-Date, repeat its payload digest, and carry SHA-1 block digests of their own. Record
ids are version-5 UUIDs of the response's id and the record's type, so a task that is run again
gives the same records.

Defined results: a null payload is an empty one (empty text); a null or unknown character set is
UTF-8 with replacement; a null URI leaves the URI fields out; a null id is derived from URI and
payload; repeated responses give repeated records; an empty table gives none. In a WARC file, a
record that is cut off is dropped, and so is what is not gzip after a good member.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm.common import arrow_map, free_of
from orbitweave.llm.html_text import blocks

RESPONSES = "record_id string, target_uri string, date string, http_status int, http_headers array<struct<name: string, value: string>>, payload binary, payload_digest string"
RECORDS = "record_type string, record_id string, refers_to string, refers_to_uri string, refers_to_date string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length bigint, block binary"
_header_type = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))

#: Bytes of a file that are inflated at once.
PIECE = 1 << 18

_charset = re.compile(rb"""charset\s*=\s*["']?\s*([A-Za-z0-9_.:-]+)""", re.I)
_link = re.compile(r"""<a\b(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)


def sha1(block: bytes) -> str:
    """The digest form that WARC files use: sha1 in base 32."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source} {kind}')}>"


def decoded(payload: bytes, content_type: str) -> str:
    """The payload as text, by the header's character set, then the document's, then UTF-8."""
    for place in (content_type.encode(), payload[:2048]):
        if m := _charset.search(place):
            try:
                return payload.decode(m[1].decode(), "replace")
            except (LookupError, ValueError):
                pass
    return payload.decode("utf-8", "replace")


def joined(base: str | None, link: str) -> str:
    """link as an absolute URI; one that can't be read stays as it stands."""
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def derivatives(response: dict) -> list[dict]:
    """The metadata and the conversion record of a response."""
    payload, uri, date = response["payload"] or b"", response["target_uri"], response["date"]
    digest = response["payload_digest"] or sha1(payload)
    source = response["record_id"] or record_id(f"{uri} {digest}", "response")
    headers = [(h["name"], h["value"]) for h in response["http_headers"] or []]
    content_type = next((v for n, v in headers if n.lower() == "content-type"), "")
    text = decoded(payload, content_type)
    plain = "\n".join(b.text for b in blocks(text)) if "html" in content_type.lower() or not content_type else text
    links = dict.fromkeys(joined(uri, m[1] or m[2] or m[3] or "") for m in _link.finditer(text)) if "html" in content_type.lower() or not content_type else {}
    fields = [("http-status", str(response["http_status"] or "")), *((f"http-header-{n.lower()}", v) for n, v in headers), ("payload-digest", digest), ("payload-length", str(len(payload))), ("plain-text-digest", sha1(plain.encode())), *(("outlink", x) for x in links)]
    # a field is one line, so line breaks in values become spaces
    metadata = "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in fields).encode()
    common = {"refers_to": source, "refers_to_uri": uri, "refers_to_date": date, "target_uri": uri, "date": date, "payload_digest": digest}
    return [
        common | {"record_type": kind, "record_id": record_id(source, kind), "content_type": mime, "block": block, "block_digest": sha1(block), "content_length": len(block)}
        for kind, mime, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", plain.encode()))
    ]


_NAMES = [x.split()[0] for x in RECORDS.split(", ")]
_TYPES = [pa.int64() if n == "content_length" else pa.binary() if n == "block" else pa.string() for n in _NAMES]


def derive(responses: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """responses: the columns of RESPONSES, with more or without. Two records of RECORDS for each,
    after the columns keep, of which those that have the name of a record's field are left out."""
    keep = free_of(keep or [], _NAMES)
    names = responses.columns
    own = ["record_id", "target_uri", "date", "http_status", "http_headers", "payload", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(names.index(c)).to_pylist() for c in own), strict=True)
            out = [d for r in rows for d in derivatives(dict(zip(own, r, strict=True)))]
            twice = pa.array([i for i in range(batch.num_rows) for _ in range(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)).take(twice) for c in keep), *(pa.array([d[n] for d in out], t) for n, t in zip(_NAMES, _TYPES, strict=True))], names=[*keep, *_NAMES])

    return arrow_map(responses, run, "".join(f"`{c}` {dict(responses.dtypes)[c]}, " for c in keep) + RECORDS)


def responses_of_pages(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of stored pages: status 200, HTML in UTF-8; the key stays."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    h = F.md5(F.concat_ws(" ", F.col(key).cast("string"), F.col(url), F.md5(body)).cast("binary"))
    as_uuid = F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")
    header = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    return pages.select(
        key, as_uuid.alias("record_id"), F.col(url).alias("target_uri"), F.lit(date).alias("date"), F.lit(200).alias("http_status"),
        F.array(header("Content-Type", F.lit("text/html; charset=utf-8")), header("Content-Length", F.length(body).cast("string"))).alias("http_headers"), body.alias("payload"), F.lit(None).cast("string").alias("payload_digest"))


def _inflated(raw: bytes) -> Iterator[tuple[bytes, bool]]:
    """The content of a gzip file in pieces, and whether a member ends with a piece; a file that is not
    gzip is one member. What follows a broken member is left."""
    view, at = memoryview(raw), 0
    if view[:2] != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at : at + PIECE]), at + PIECE >= len(view)
        return
    while view[at : at + 2] == b"\x1f\x8b":
        z = zlib.decompressobj(31)
        while not z.eof and at < len(view):
            part = view[at : at + PIECE]
            try:
                out = z.decompress(part, 16 * PIECE)
                while z.unconsumed_tail:
                    yield out, False
                    out = z.decompress(z.unconsumed_tail, 16 * PIECE)
            except zlib.error:
                return
            at += len(part) - len(z.unused_data)
            yield out, z.eof
        while at < len(view) and view[at] == 0:
            at += 1


def _fields(lines: list[bytes]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in b" \t" and line and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}"
        elif b":" in line:
            n, _, v = line.partition(b":")
            out.append((n.strip().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")))
    return out


def _record(held: bytearray) -> tuple[tuple[dict[str, str], bytes] | None, int]:
    """The first whole record, and how many bytes are done with."""
    start = held.find(b"WARC/")
    if start < 0:
        return None, max(0, len(held) - 4)
    end = held.find(b"\r\n\r\n", start)
    if end < 0:
        return None, start
    head = {n.lower(): v for n, v in _fields(bytes(held[start:end]).split(b"\r\n")[1:])}
    said = head.get("content-length", "")
    stop = end + 4 + (int(said) if said.isdecimal() else 0)
    return ((head, bytes(held[end + 4 : stop])), stop) if stop <= len(held) else (None, start)


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file: header fields by lower-cased name, and block. One pass in pieces of
    PIECE bytes; besides the file, a record or two are in memory. A record counts once the next one
    begins or its member has ended well."""
    held, whole = bytearray(), None
    for piece, ended in _inflated(raw):
        held += piece
        while True:
            found, used = _record(held)
            del held[:used]
            if found is None:
                break
            if whole:
                yield whole
            whole = found
        if ended:
            if whole:
                yield whole
            whole = None
            held.clear()


def http_parts(block: bytes) -> tuple[int | None, list[tuple[str, str]], bytes]:
    """Status, headers and payload, with transfer and content encodings undone where they hold."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/"):
        return None, [], block
    lines = head.split(b"\r\n")
    status = lines[0].split(b" ")[1:2]
    headers = _fields(lines[1:])
    said = {n.lower(): v.lower() for n, v in headers}
    if "chunked" in said.get("transfer-encoding", ""):
        parts, at = [], 0
        while (eol := body.find(b"\r\n", at)) >= 0:
            try:
                n = int(body[at:eol].split(b";")[0], 16)
            except ValueError:
                break
            parts.append(body[eol + 2 : eol + 2 + n])
            at = eol + 2 + n + 2
            if not n:
                break
        body = b"".join(parts) if parts else body
    if said.get("content-encoding", "") in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompress(body, 47 if "gzip" in said["content-encoding"] else 15)
        except zlib.error:
            pass
    return int(status[0]) if status and status[0].isdigit() else None, headers, body


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of all WARC files (plain or gzip) of a path, any that Spark reads."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "target_uri", "date", "http_status", "http_headers", "payload", "payload_digest"]
        types = [pa.string(), pa.string(), pa.string(), pa.int32(), _header_type, pa.binary(), pa.string()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

        for batch in batches:
            rows, size = [], 0
            for raw in batch.column(0):
                for head, block in parse(raw.as_py()):
                    if head.get("warc-type") != "response":
                        continue
                    status, headers, payload = http_parts(block)
                    rows.append((head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), status, [{"name": n, "value": v} for n, v in headers], payload, head.get("warc-payload-digest")))
                    size += len(payload)
                    if size > 8_000_000:
                        yield out(rows)
                        rows, size = [], 0
            yield out(rows)

    return arrow_map(files, run, RESPONSES)


def serialised(record: dict) -> bytes:
    """A record as a gzip member, without a time stamp, so that it is always the same."""
    named = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = "WARC/1.1\r\n" + "".join(f"{n}: {record[k]}\r\n" for n, k in named if record.get(k) is not None) + "\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z:
        z.write(head.encode() + bytes(record["block"]) + b"\r\n\r\n")
    return out.getvalue()


def write_records(records: DataFrame, folder: str) -> None:
    """A .warc.gz file for each partition, in a folder that all executors mount. A file gets its
    name when it is whole, so a task that is run again replaces its own."""
    if "://" in folder:
        raise ValueError("write_records needs a folder that executors mount")
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        path = f"{folder}/part-{task.partitionId():05d}.warc.gz"
        part = f"{path}.{task.taskAttemptId()}"
        n = 0
        with open(part, "wb") as f:
            for batch in batches:
                for r in batch.to_pylist():
                    f.write(serialised(r))
                    n += 1
        os.replace(part, path)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    arrow_map(records, run, "n bigint").agg(F.sum("n")).collect()
