"""WARC derivatives: metadata and plain-text conversion records built from
response records.

A response record is a row (record_id, target_uri, date, block), the block
being the HTTP message; it may have the source's own digests and WARC fields
beside them (``source_block_digest``, ``source_payload_digest``,
``source_fields``). Each gives one ``metadata`` and one ``conversion`` record
that refer to it by its identifier, carry the source's URI, date, HTTP headers,
WARC fields and digests along, name each other, and have a digest of their own
block. Digests that the source lacks are computed: of its block, and of its
payload, which is the body without its transfer encoding.

The text comes from the decoded body: chunks joined, then ``gzip`` and
``deflate`` undone. A body that was stored decoded, whatever its headers say, is
taken as it is, and a broken one as far as it can be decoded. Other content
encodings give an empty text and an ``undecoded`` line in the metadata.

Defined results: a null or empty page gives a response with an empty payload
and a conversion with an empty block; a null url leaves the target URI out; a
null id becomes part of the identifier as the empty string; repeated rows give
repeated records with equal identifiers; an empty table gives no records; only
named columns are read. A very long page is handled whole, in memory of some
times its decoded size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.common import lean
from tillsight.llm.html_blocks import scan

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
RECORD = ("record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, date string, "
          "content_type string, content_length long, block_digest string, payload_digest string, "
          "source_block_digest string, source_fields map<string,string>, source_headers map<string,string>, content string")
SOURCE = (("source_block_digest", "string"), ("source_payload_digest", "string"), ("source_fields", "map<string,string>"))
_ARROW = pa.schema([(n, pa.string()) for n in ("record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "date", "content_type")]
                   + [("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()),
                      ("source_block_digest", pa.string()), ("source_fields", pa.map_(pa.string(), pa.string())), ("source_headers", pa.map_(pa.string(), pa.string())), ("content", pa.string())])


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(parts))}>"


def http_message(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header fields (names as sent, the status line under ``:status``) and payload."""
    cut = block.find(b"\r\n\r\n")
    head, payload = (block, b"") if cut < 0 else (block[:cut], block[cut + 4:])
    lines = head.decode("latin-1").split("\r\n")
    fields = [(":status", lines[0])] if lines[0] else []
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if colon:
            fields.append((name.strip(), value.strip()))
    return fields, payload


def _tokens(fields, name: str) -> list[str]:
    return [x.strip().lower() for k, v in fields if k.lower() == name for x in v.split(",") if x.strip()]


def join_chunks(body: bytes) -> bytes:
    """A chunked body without its chunk sizes and trailer."""
    out, at = [], 0
    while (end := body.find(b"\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            return b"".join(out) if at else body
        if size <= 0:
            break
        out.append(body[end + 1:end + 1 + size])
        at = end + 1 + size
        at += 2 if body[at:at + 2] == b"\r\n" else body[at:at + 1] == b"\n"
    return b"".join(out) if out or body[:1] == b"0" else body


def inflate(body: bytes, raw: bool = False) -> bytes:
    """Undo gzip (any number of members) or zlib, or a stream without header."""
    out, rest = [], body
    while rest:
        stream = zlib.decompressobj(-15 if raw else 47)
        try:
            # by pieces, so that a broken stream gives what comes before the fault
            for lo in range(0, len(rest), 1 << 16):
                out.append(stream.decompress(rest[lo:lo + (1 << 16)]))
                if stream.eof:
                    rest = stream.unused_data + rest[lo + (1 << 16):]
                    break
            else:
                break
        except zlib.error:
            break
    return b"".join(out)


def decode_body(fields, payload: bytes) -> tuple[bytes, bytes, str]:
    """The body without its transfer encoding, that without its content
    encodings too, and the name of one that can't be undone."""
    entity = join_chunks(payload) if "chunked" in _tokens(fields, "transfer-encoding") else payload
    body = entity
    for coding in reversed(_tokens(fields, "content-encoding")):
        if coding in ("gzip", "x-gzip", "deflate"):
            body = inflate(body) or (inflate(body, raw=True) if coding == "deflate" else b"") or body
        elif coding != "identity":
            return entity, b"", coding
    return entity, body, ""


def _charset(fields) -> str:
    kind = next((v for k, v in fields if k.lower() == "content-type"), "").lower()
    name = kind.partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
    try:
        "".encode(name)
    except LookupError:
        return "utf-8"
    return name


def derivatives(record_id: str, uri: str | None, date: str | None, block: bytes, block_digest: str | None = None,
                payload_digest: str | None = None, warc_fields=None) -> list[tuple]:
    """The metadata and the conversion record of one response record."""
    fields, payload = http_message(block)
    payload, body, undecoded = decode_body(fields, payload)
    links, head = [], {}
    source = body.decode(_charset(fields), errors="replace")
    text = "\n".join(b.text for b in scan(source, links, head) if not b.holder.in_head)
    ids = {k: identifier(record_id, k) for k in ("metadata", "conversion")}
    about = [("payload-length", str(len(payload))), ("text-length", str(len(text)))]
    about += [("undecoded", undecoded)] if undecoded else []
    about += [(k, head[k]) for k in ("title", "lang") if head.get(k)]
    about += [("outlink", f"{x} L a/@href") for x in links]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about)
    headers, out = {}, []
    sums = payload_digest or digest(payload), block_digest or digest(block)
    for k, v in fields:  # fields sent twice are joined, as HTTP has it
        headers[k] = f"{headers[k]}, {v}" if k in headers else v
    for kind, other, form, made in (("metadata", "conversion", "application/warc-fields", meta), ("conversion", "metadata", "text/plain; charset=utf-8", text)):
        data = made.encode("utf-8", errors="replace")
        out.append((kind, ids[kind], record_id, ids[other], uri, date, form, len(data), digest(data), *sums,
                    list(warc_fields or ()), list(headers.items()), data.decode()))
    return out


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lean(batches):
        for lo in range(0, b.num_rows, 256):
            rows, own = [], []
            for key, rid, uri, date, block, *source in zip(*(b.column(i).slice(lo, 256).to_pylist() for i in range(8)), strict=True):
                made = derivatives(rid, uri, date, block or b"", *source)
                rows += made
                own += [key] * len(made)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            arrays = [pa.array(own, b.schema.field(0).type)] + [pa.array(list(c), f.type) for c, f in zip(cols, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["source_key", *_ARROW.names])


def derive(responses: DataFrame, key_col: str = "record_id") -> DataFrame:
    """Two linked records for each response row (record_id, target_uri, date,
    block, and the source's digests and fields where they are columns);
    ``source_key`` is the row's ``key_col``."""
    source = [F.col(n) if n in responses.columns else F.lit(None).cast(t).alias(n) for n, t in SOURCE]
    src = responses.select(F.col(key_col).alias("source_key"), "record_id", "target_uri", "date", "block", *source)
    return src.mapInArrow(_derive, f"source_key {src.schema['source_key'].dataType.simpleString()}, {RECORD}")


def responses_from_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id",
                         url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Stored pages as response records. The pages carry no crawl time, so
    ``date`` is a parameter."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length(payload).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    name = F.sha2(F.concat_ws("\n", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(url_col).cast("string"), F.lit(""))), 256)
    uid = F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                          for x in ([F.lit("-")] if i else []) + [F.substring(name, a, n)]], F.lit(">"))
    return pages.select(F.col(id_col).alias("source_key"), uid.alias("record_id"), F.col(url_col).cast("string").alias("target_uri"),
                        F.lit(date).alias("date"), F.concat(head, payload).alias("block"))


def serialize(row) -> bytes:
    """A derived row as the bytes of a WARC/1.1 record."""
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]),
              ("WARC-Target-URI", row["target_uri"]), ("WARC-Refers-To", row["refers_to"]), ("WARC-Concurrent-To", row["concurrent_to"]),
              ("WARC-Block-Digest", row["block_digest"]), ("WARC-Source-Payload-Digest", row["payload_digest"]),
              ("WARC-Source-Block-Digest", row["source_block_digest"]),
              ("Content-Type", row["content_type"]), ("Content-Length", str(row["content_length"]))]
    fields += [(f"WARC-Source-Header-{k.lstrip(':')}", v) for k, v in (row["source_headers"] or {}).items()]
    fields += [(f"WARC-Source-Field-{k}", v) for k, v in (row["source_fields"] or {}).items()]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return head.encode("utf-8") + b"\r\n" + row["content"].encode("utf-8") + b"\r\n\r\n"


def _serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in lean(batches):
        for lo in range(0, b.num_rows, 256):
            made = [serialize(dict(r, source_fields=dict(r["source_fields"] or ()), source_headers=dict(r["source_headers"] or ()))).decode().removesuffix(END)
                    for r in b.slice(lo, 256).to_pylist()]
            yield pa.RecordBatch.from_pydict({"record": pa.array(made, pa.string())})


#: What ends a record.
END = "\r\n\r\n"


def write_warc(derived: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write derived records as WARC files, one a task, to any file system that
    Spark writes. A record is a line whose separator is what ends a record."""
    derived.mapInArrow(_serialize, "record string").write.option("lineSep", END).option("compression", compression).text(path)


def records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields with lower-case names, block) of each record of a WARC
    file, plain or gzipped as a whole or record by record; one record at a time
    is unpacked. A field sent twice is joined by a comma, a folded one by a
    space. A file that breaks off loses its last record only."""
    file: BinaryIO = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        file = gzip.GzipFile(fileobj=file)
    try:
        while line := file.readline():
            if not line.startswith(b"WARC/"):
                continue
            head, name = {}, ""
            while (line := file.readline()).strip():
                text = line.decode("utf-8", errors="replace")
                if text[0] in " \t" and name:
                    head[name] += " " + text.strip()
                    continue
                name, _, value = text.partition(":")
                name = name.strip().lower()
                head[name] = f"{head[name]}, {value.strip()}" if name in head else value.strip()
            size = int(head.get("content-length") or 0)
            block = file.read(size)
            if len(block) < size:
                return
            yield head, block
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def _responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    text = pa.string()
    kinds = pa.schema([("record_id", text), ("target_uri", text), ("date", text), ("block", pa.binary()),
                       ("source_block_digest", text), ("source_payload_digest", text), ("source_fields", pa.map_(text, text))])
    for b in lean(batches):
        for data in b.column(0):
            for head, block in records(data.as_py()):
                if head.get("warc-type") == "response":
                    row = [head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), block,
                           head.get("warc-block-digest"), head.get("warc-payload-digest"), list(head.items())]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kinds, strict=True)], schema=kinds)


def read_responses(spark, path: str) -> DataFrame:
    """Response records of WARC files, with their own digests and all their WARC
    fields, read by Spark's binary file source (one row a file, so files should
    be of the usual 1 GB at most)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_responses, "record_id string, target_uri string, date string, block binary, "
                                        "source_block_digest string, source_payload_digest string, source_fields map<string,string>")


def op3_warc_derivatives(spark, sf_dir):
    """Metadata and conversion records of every page."""
    made = derive(responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")), "source_key")
    return made.withColumnRenamed("source_key", "page_id")
