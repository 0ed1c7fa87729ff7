"""Web archives: written, normalised to a gzip member a record with an offset index, and read by that index.

`written` makes archives as some crawlers leave them: each file one gzip stream, which can only be read from its start. `normalised` inflates every
such file once, in a stream, writes each record as a gzip member of its own, and beside each archive a sidecar index (a JSON line a record: offset, length, type,
URIs, digest), which it also returns as a table. `read` seeks members by the index, so that one archive spreads over tasks. Records of any length
pass through in pieces of STEP bytes, both ways.

Tasks write files of names of their own and report them in a table; only files in that table count, so a task that is lost, or runs twice, leaves
nothing but a file that nobody reads. Folders are URIs; files are opened through pyarrow's file systems.

Identity: of records with equal payloads (by SHA-256) of at least LEAST bytes, that of the largest page_id is response and the others revisit it; rows that
repeat that page_id are responses too. Equal payloads are counted by partial aggregates, and only digests that occur twice are joined back.

Nulls: a null html is empty, a null url has no target URI, a null page_id is smaller than any and stays null. Empty payloads are records. Very long ones are
written and read in pieces. Repeated rows are records of their own, with one record ID. An empty table gives no rows and no archives. Extra columns don't
matter. A file that is torn, or holds what is no record, gives the index rows of the records before the fault and one with an error; `read` skips it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, shared_dir, small, table

#: Payloads from which on equal ones are stored once; bytes held at a time; payload bytes of an archive from which on the task begins another; of a reading task.
LEAST, STEP, LARGEST, TASK = 1000, 1 << 20, 1 << 30, 64 << 20
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "path string, records long, bytes long"
FIELDS = ["type", "record_id", "refers_to", "target_uri", "digest"]
INDEX = "path string, offset long, length long, type string, record_id string, refers_to string, target_uri string, digest string, error string"
#: Names of header fields, and the profile of records that repeat a payload.
HEADERS = {"type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "target_uri": "WARC-Target-URI", "digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", uri) else f"file://{uri}")


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share."""
    out = re.sub(r"^file:(?=/[^/])", "file://", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    system, path = at(out)
    system.create_dir(path, recursive=True)
    return out


# ---- which record holds a payload


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (binary), digest (SHA-1) and refers_to: the page that holds the payload, null for that page and for small payloads."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    same = F.sha2("payload", 256)
    large = rows.filter(F.octet_length("payload") >= least).groupBy(same.alias("same")).agg(F.max("page_id").alias("holder"), F.count("*").alias("n"))
    repeated = saved(large.filter("n > 1 and holder is not null").select("same", "holder"))
    key = F.when(F.octet_length("payload") >= least, same)
    joined = rows.withColumn("key", key).join(small(repeated), F.col("key") == F.col("same"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    return joined.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), refers.alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[0-9a-f]*>", urn or "")
    return int(found[1]) if found else None


def head(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """Header of a record and the HTTP header that begins its block. A revisit's block is that HTTP header alone, which tells the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    lines = ["WARC/1.1", f"{HEADERS['type']}: {'revisit' if revisit else 'response'}", f"{HEADERS['record_id']}: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"{HEADERS['target_uri']}: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines.append(f"{HEADERS['digest']}: sha1:{digest}")
    if revisit:
        lines += [f"{HEADERS['refers_to']}: {record_id(refers_to, digest)}", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else size)}", "", ""]
    return "\r\n".join(lines).encode() + http


def written(records: DataFrame, to: str, largest: int = LARGEST) -> DataFrame:
    """path, records, bytes of the archives written to folder `to` from rows of typed(); each one gzip stream."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = at(to)
        name, out, press, records, size = "", None, None, 0, 0

        def done() -> pa.RecordBatch:
            out.write(press.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": pa.array([f"{to}/{name}"]), "records": pa.array([records]), "bytes": pa.array([size])})

        for b in batches:
            for page_id, url, payload, digest, refers_to in zip(*(b[c] for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, press = system.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(wbits=31)
                body = payload.as_buffer()
                out.write(press.compress(head(page_id.as_py(), url.as_py(), len(body), digest.as_py(), refers_to.as_py())))
                for i in range(0, len(body) if refers_to.as_py() is None else 0, STEP):
                    out.write(press.compress(memoryview(body)[i : i + STEP]))
                out.write(press.compress(b"\r\n\r\n"))
                records, size = records + 1, size + len(body)
                if size >= largest:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return saved(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, MANIFEST))


# ---- streams of records


class Inflated:
    """The bytes of a gzip file, of one member or many, inflated as they are asked for."""

    def __init__(self, raw: BinaryIO) -> None:
        self.raw, self.inflate, self.begun, self.input = raw, zlib.decompressobj(31), False, b""
        self.held, self.pos = b"", 0

    def more(self) -> bool:
        """Adds up to STEP bytes to what is held; False at the end of the file."""
        while True:
            read = self.input or self.raw.read(STEP)
            if not read and not self.begun:
                return False
            piece = self.inflate.decompress(read, STEP)
            self.begun, self.input = True, self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.input, self.inflate, self.begun = self.inflate.unused_data, zlib.decompressobj(31), False
            if piece:
                self.held, self.pos = self.held[self.pos :] + piece, 0
                return True
            if not read and self.begun:
                raise ValueError("the gzip stream is torn")

    def until(self, mark: bytes, most: int = STEP) -> bytes:
        """Up to and with the mark; empty at the end of the file."""
        looked = 0
        while (found := self.held.find(mark, self.pos + max(0, looked - len(mark)))) < 0:
            looked = len(self.held) - self.pos
            if looked > most:
                raise ValueError("a header has no end")
            if not self.more():
                if looked:
                    raise ValueError("the file ends within a record")
                return b""
        out, self.pos = self.held[self.pos : found + len(mark)], found + len(mark)
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if self.pos == len(self.held) and not self.more():
                raise ValueError("the file ends within a record")
            out = self.held[self.pos : self.pos + n]
            self.pos, n = self.pos + len(out), n - len(out)
            yield out


def fields(header: bytes) -> dict[str, str]:
    """Names in lower case and values; a line that begins with a blank goes on with the one before."""
    first, *lines = re.sub(r"\r?\n[ \t]+", " ", header.decode("utf-8", "replace")).strip().splitlines()
    if not first.startswith("WARC/"):
        raise ValueError("what follows is no record")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def records(raw: BinaryIO) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """Header, its fields and the pieces of the block of each record, which are to be used up before the next."""
    stream = Inflated(raw)
    while header := stream.until(b"\r\n\r\n"):
        if not header.strip():
            continue
        known = fields(header.lstrip(b"\r\n"))
        if not known.get("content-length", "").isdigit():
            raise ValueError("a record has no length")
        yield header.lstrip(b"\r\n"), known, stream.pieces(int(known["content-length"]))


# ---- normaliser


def normalised(archives: DataFrame, to: str) -> DataFrame:
    """The index (INDEX) of the archives of column path, rewritten to folder `to` with a gzip member a record; beside each an index file, .cdxj."""

    def rewrite(path: str) -> Iterator[dict]:
        (source, name), (system, base) = at(path), at(to)
        stem, offset, error = f"{name.rpartition('/')[2].partition('.')[0]}-{uuid.uuid4().hex[:8]}", 0, None
        with system.open_output_stream(f"{base}/{stem}.warc.gz", compression=None) as out, system.open_output_stream(f"{base}/{stem}.cdxj", compression=None) as index:
            try:
                with source.open_input_stream(name, compression=None) as raw:
                    for header, known, block in records(raw):
                        press, length = zlib.compressobj(wbits=31), 0
                        kept: list[bytes] = [press.compress(header)]
                        for piece in block:
                            kept.append(press.compress(piece))
                            if sum(map(len, kept)) >= STEP:
                                length += sum(out.write(k) for k in kept)
                                kept = []
                        kept += [press.compress(b"\r\n\r\n"), press.flush()]
                        length += sum(out.write(k) for k in kept)
                        row = {"offset": offset, "length": length} | {k: known.get(HEADERS[k].lower()) for k in FIELDS}
                        index.write((json.dumps(row) + "\n").encode())
                        offset += length
                        yield row | {"path": f"{to}/{stem}.warc.gz", "error": None}
            except (ValueError, zlib.error, OSError) as e:
                error = str(e) or type(e).__name__
        if error:
            yield dict.fromkeys(FIELDS) | {"path": path, "offset": None, "length": None, "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b["path"].to_pylist():
                yield from batched(rewrite(path), [c.split()[0] for c in INDEX.split(", ")], 1000)

    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = {c.split()[0]: kinds[c.split()[1]] for c in INDEX.split(", ")}

    def batched(rows: Iterator[dict], names: list[str], most: int) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in rows:
            held.append(r)
            if len(held) == most:
                yield pa.RecordBatch.from_pydict({c: pa.array([x[c] for x in held], columns[c]) for c in names})
                held = []
        if held:
            yield pa.RecordBatch.from_pydict({c: pa.array([x[c] for x in held], columns[c]) for c in names})

    n = max(1, archives.count())
    return saved(archives.select("path").repartition(n).mapInArrow(run, INDEX))


# ---- reader


def read(index: DataFrame, use: Callable[[dict[str, str], Iterator[bytes]], dict], schema: pa.Schema, ddl: str, task: int = TASK) -> DataFrame:
    """use(fields, pieces of the block) of each indexed record, by seeks: rows of the index are dealt by path and offset into tasks of about `task` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, raw, held, weight = "", None, [], 0
        for b in batches:
            for path, offset, length in zip(*(b[c].to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != opened:
                    if raw:
                        raw.close()
                    system, name = at(path)
                    opened, raw = path, system.open_input_file(name)
                raw.seek(offset)
                for _, known, block in records(Member(raw, length)):
                    held.append(use(known, block))
                    for _ in block:
                        pass
                weight += length
                if len(held) == 1000 or weight > STEP:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)
        if raw:
            raw.close()

    sound = index.filter("error is null").select("path", "offset", "length")
    size = sound.agg(F.sum("length")).first()[0] or 0
    return sound.repartitionByRange(1 + size // task, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(run, ddl)


class Member:
    """The next `left` bytes of a file."""

    def __init__(self, raw: BinaryIO, left: int) -> None:
        self.raw, self.left = raw, left

    def read(self, n: int) -> bytes:
        out = self.raw.read(min(n, self.left))
        self.left -= len(out)
        return out


PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
PAGE_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def page(known: dict[str, str], block: Iterator[bytes]) -> dict:
    """What a record says of a page; bytes and digest of a response are taken from its payload, those of a revisit from its headers."""
    http = b""
    for piece in block:
        http += piece
        if b"\r\n\r\n" in http:
            break
    http, _, payload = http.partition(b"\r\n\r\n")
    out = {"page_id": page_of(known.get("warc-record-id")), "record_type": known["warc-type"], "refers_to": page_of(known.get("warc-refers-to"))}
    if out["record_type"] == "revisit":
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        return out | {"payload_bytes": int(length[1]), "payload_digest": known["warc-payload-digest"].removeprefix("sha1:")}
    sha, n = hashlib.sha1(payload), len(payload)
    for piece in block:
        sha.update(piece)
        n += len(piece)
    if known.get("warc-payload-digest") not in (None, f"sha1:{sha.hexdigest()}"):
        raise ValueError(f"payload of {known.get('warc-record-id')} doesn't have its digest")
    return out | {"payload_bytes": n, "payload_digest": sha.hexdigest()}


def archived(pages: DataFrame, least: int = LEAST, largest: int = LARGEST) -> tuple[DataFrame, DataFrame]:
    """The manifest of the archives of pages as written, and the index of the normalised ones."""
    spark = pages.sparkSession
    manifest = written(typed(pages, least), folder(spark, "archives"), largest)
    return manifest, normalised(manifest, folder(spark, "records"))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    """Size, digest, record type and reference of every page, read back from its normalised archive; the streams it came from are deleted."""
    manifest, index = archived(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    for r in manifest.select(F.regexp_extract("path", "^(.*)/", 1).alias("of")).distinct().collect():
        system, path = at(r["of"])
        system.delete_dir(path)
    return read(index, page, PAGE, PAGE_DDL)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
h AS (SELECT page_id, n, sha1(html) AS d, CASE WHEN n >= {LEAST} THEN max(page_id) OVER (PARTITION BY html) END AS holder FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN holder IS NULL OR page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to FROM h
"""
