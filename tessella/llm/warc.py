"""WARC archives: writing captures, reading records, assembling transactions.

Each page becomes a transaction of three records: request, response or revisit, and metadata, tied by WARC-Concurrent-To.
Every record is a gzip member of its own. Archives are written through Spark's text sink, whose line separator is set to
an empty gzip member, so they land wherever Spark can write; they are read through the binaryFile source. Assembly reads
concurrent-to links as undirected and follows them, over any number of hops, to the nearest record that holds the response.

Payload rule: of payloads that are equal and have at least REVISIT_BYTES bytes, the one with the largest page_id is the
response and the others revisit it.

Defined results: null html is an empty payload; a null url is written as urn:page:<page_id>; null page_ids come before
all others; rows equal in page_id and payload are ordered by position, so one is the response; records without a
response in reach form a capture without one; an empty table gives no archives and an empty result; other columns are
not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import clash_free, materialize, scratch, slices

#: Least bytes of a payload that others may revisit; compressed bytes of a chunk; chunks of an archive file.
REVISIT_BYTES, CHUNK_BYTES, CHUNKS = 1000, 1 << 20, 8
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A gzip member without content; stands between chunks, where the text sink wants a separator.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300" + "00" * 8)
DATE = "2024-01-01T00:00:00Z"
UNSAFE = re.compile(r"[\x00-\x20\x7f<>]")


def record_id(archive: str, row: int, kind: str) -> str:
    h = hashlib.blake2b(f"{archive}/{row}/{kind}".encode(), digest_size=16).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def transaction(archive: str, row: int, page, url: str | None, payload: bytes, digest: str, revisits: tuple | None) -> bytes:
    """Records of one page; revisits: (row, page_id) of the response with the same payload."""
    uri = UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url) if url else f"urn:page:{page}"
    host, _, path = uri.partition("://")[2].partition("/")
    ids = {k: record_id(archive, row, k) for k in ("request", "response", "metadata")}

    def head(kind: str, which: str, content: str, *more: tuple[str, str]) -> list[tuple[str, str]]:
        return [("WARC-Type", kind), ("WARC-Record-ID", ids[which]), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("Content-Type", content), *more]

    tied = ("WARC-Concurrent-To", ids["response"])
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    told = ("WARC-Payload-Digest", f"sha1:{digest}")
    fields = [] if page is None else [f"page-id: {page}"]
    if revisits:
        answer = record(head("revisit", "response", "application/http; msgtype=response", told, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(archive, revisits[0], "response"))), http)
    else:
        answer = record(head("response", "response", "application/http; msgtype=response", told), http + payload)
    ask = record(head("request", "request", "application/http; msgtype=request", tied), f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    return ask + answer + record(head("metadata", "metadata", "application/warc-fields", tied), "".join(f"{x}\r\n" for x in fields).encode())


def write_archives(pages: DataFrame, path: str) -> None:
    """Write pages(page_id, url, html) as archives under path.

    Which payload is whose response is settled by a partially aggregated maximum and a join that can be split when one
    payload has very many pages."""
    archive = path.rsplit("/", 1)[-1]
    rows = clash_free(pages, "page_id", "url", "html").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumn("digest", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))).withColumn("size", F.coalesce(F.octet_length("html"), F.lit(0)))
    lasts = rows.filter(F.col("size") >= REVISIT_BYTES).groupBy("digest", "size").agg(F.max(F.struct("page_id", "row")).alias("last"), F.count(F.lit(1)).alias("n"))
    joined = rows.join(lasts.filter("n > 1").drop("n"), ["digest", "size"], "left")
    ready = joined.select("page_id", "url", "html", "row", "digest", F.when(F.col("last.row") != F.col("row"), F.col("last.row")).alias("of"), F.col("last.page_id").alias("of_page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(archive, 0, "info")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
        opening = record(info, b"format: WARC File Format 1.1\r\n")
        parts, size = [opening], 0
        for piece in slices(batches, "html"):
            for page, url, html, row, digest, of, of_page in zip(*(c.to_pylist() for c in piece.columns)):
                parts.append(transaction(archive, row, page, url, (html or "").encode(), digest, None if of is None else (of, of_page)))
                size += len(parts[-1])
                if size >= CHUNK_BYTES:
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([b"".join(parts)], pa.binary())})
                    parts, size = [opening], 0
        if size:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([b"".join(parts)], pa.binary())})

    chunks = ready.mapInArrow(run, "chunk binary").select(F.expr("string(chunk)").alias("value"))
    chunks.write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", CHUNKS).text(path)


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members one after the other; data that is not gzip as it is."""
    if data[:2] != b"\x1f\x8b":
        yield bytes(data)
        return
    view, at = memoryview(data), 0
    while at < len(view):
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("archive ends inside a gzip member")
            part = view[at : at + (1 << 14)]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        yield b"".join(out)


def records(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and block of each record."""
    held = b""
    for member in members(data):
        held = held + member if held else member
        at = 0
        while (end := held.find(b"\r\n\r\n", at)) >= 0:
            first, *lines = held[at:end].decode("utf-8", "replace").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {first[:40]!r}")
            headers: dict[str, list[str]] = {}
            for line in lines:
                name, _, value = line.partition(":")
                headers.setdefault(name.strip().lower(), []).append(value.strip())
            size = int(headers["content-length"][0])
            if len(held) < end + 4 + size + 4:
                break
            yield headers, held[end + 4 : end + 4 + size]
            at = end + 4 + size + 4
        held = held[at:]
    if held.strip():
        raise ValueError("archive ends inside a record")


RECORDS = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, target_uri string, date string, status int, "
    "payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)


def parsed(headers: dict[str, list[str]], block: bytes, payload: bool) -> tuple:
    """RECORDS of one record; the block digest is verified if it is SHA-1."""
    one = lambda name: headers.get(name, [None])[0]
    told = one("warc-block-digest")
    if told and told.startswith("sha1:") and told[5:] not in (base64.b32encode(hashlib.sha1(block).digest()).decode(), hashlib.sha1(block).hexdigest()):
        raise ValueError(f"block digest of {one('warc-record-id')} differs")
    kind, status, size, digest, body, fields = one("warc-type"), None, None, None, None, None
    content = (one("content-type") or "").replace(" ", "")
    if content == "application/http;msgtype=response":
        top, _, body = block.partition(b"\r\n\r\n")
        lines = top.decode("latin-1").split("\r\n")
        status = int(lines[0].split()[1]) if len(lines[0].split()) > 1 and lines[0].split()[1].isdigit() else None
        sent = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        if kind == "revisit":
            size, body = int(sent["content-length"]) if sent.get("content-length", "").isdigit() else None, None
            digest = (one("warc-payload-digest") or "").removeprefix("sha1:") or None
        else:
            size, digest = len(body), hashlib.sha1(body).hexdigest()
            if (one("warc-payload-digest") or "").removeprefix("sha1:") not in ("", digest, base64.b32encode(bytes.fromhex(digest)).decode()):
                raise ValueError(f"payload digest of {one('warc-record-id')} differs")
    elif content == "application/warc-fields":
        fields = [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")) if k.strip()]
        fields = list(dict(fields).items())
    return one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"), status, size, digest, fields, body if payload else None


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """RECORDS of the archives under path, but for warcinfo; payloads only on demand."""
    types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary())
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in records(batch.column("content")[i].as_py()):
                    if headers.get("warc-type") != ["warcinfo"]:
                        rows.append(parsed(headers, block, payload))
                        size += len(block) if payload else 200
                    if size > CHUNK_BYTES << 2:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata (array), others (array).

    Every shuffle is by record identifiers, which are unique, so no group is large unless a capture is."""
    roots = F.col("type").isin("response", "revisit", "resource")
    links = found.select(F.col("record_id").alias("u"), F.explode("concurrent_to").alias("v"))
    links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    tops = found.filter(roots).select(F.col("record_id").alias("v"))
    near = materialize(links.join(tops, "v").groupBy("u").agg(F.min("v").alias("root")), "near")
    reached, newest = near, near
    left = materialize(links.join(tops.unionByName(near.select(F.col("u").alias("v"))).toDF("u"), "u", "left_anti"), "left")
    while not left.isEmpty():  # one hop a round, over the links of what is not reached yet
        newest = left.join(newest.select(F.col("u").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("root"))
        newest = materialize(newest, "hop")
        if newest.isEmpty():
            break
        reached = reached.unionByName(newest)
        left = materialize(left.join(newest, "u", "left_anti"), "left")
    placed = found.join(reached, F.col("record_id") == reached["u"], "left").drop("u")
    own = F.when(roots, F.col("record_id")).otherwise(F.coalesce("root", "record_id"))
    whole = F.struct(*(c for c in found.columns))
    pick = lambda cond: F.max_by(F.when(cond, whole), F.when(cond, F.col("record_id")))
    grouped = placed.withColumn("capture_id", own).groupBy("capture_id")
    return grouped.agg(
        pick(F.col("type") == "request").alias("request"), pick(roots).alias("response"),
        F.collect_list(F.when(F.col("type") == "metadata", whole)).alias("metadata"),
        F.collect_list(F.when(~F.col("type").isin("request", "metadata") & ~roots, whole)).alias("others"),
    )


def op1_transactions(spark, sf_dir: str) -> DataFrame:
    """Archives of all pages written, read back and assembled: one row per page."""
    path = scratch(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    captures = assemble(materialize(read_records(spark, path), "records"))  # parsed once for the joins that follow
    page = F.element_at(F.col("metadata")[0]["fields"], "page-id").cast("long")
    told = captures.select(page.alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), "response.record_id", F.col("response.refers_to").alias("of"))
    told = materialize(told, "captures")  # read anew, the join's skewed side can be split
    asked = told.filter("of is not null").select(F.col("of").alias("record_id")).distinct()
    named = materialize(told.join(asked, "record_id", "left_semi").select(F.col("record_id").alias("of"), F.col("page_id").alias("refers_to")), "referred")
    return told.join(named, "of", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
