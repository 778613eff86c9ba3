"""Legacy ARC archives converted to WARC.

An ARC file begins with a version block that names the fields of its record lines: version 1 has five
(URL, IP address, date, content type, length), version 2 ten (with result code, checksum, location, offset
and file name before the length). The converter reads a record's line by its file's version and its block
by the declared length, which alone finds the next record, so plain files and gzip members of one or many
records are read. It synthesises what WARC asks for and ARC lacks: record identifiers (name-based UUIDs), ISO
timestamps, record types and SHA-1 digests. HTTP answers become responses, and of those with equal payloads
(by size, SHA-1 and BLAKE2) one is a response and the others revisit it; other records (dns:, ftp:) become
resources; a version block becomes a warcinfo record. Files written here hold a gzip member a record, so a
record is read again by its place without its neighbours, and no payload is ever shuffled: only digests and
places are.

Edge cases: a null html counts as empty; a null url is written as ``urn:absent`` and white space in a url
is percent-encoded; a null page_id can't be referred to and is a response unless an equal payload has an
id; rows that repeat the chosen page_id are all responses; an empty table gives no files and no rows;
other columns of the input are ignored. A declared length that the file doesn't hold raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.storage import AtomicFile, a_file_a_task, open_store, scratch, stored

#: The record-line definitions of the two ARC versions and the WARC revisit profile.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the RFC 4122 name space of URLs
PLACES = "path string, at long, size long, inside long"
GZIP = b"\x1f\x8b"
#: Rows that a task gives on at once.
ROWS = 4096


def member(data: bytes, level: int = 1) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(path: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed size, content) of each gzip member of a file."""
    store, name = open_store(path)
    with store.open_input_stream(name, compression=None) as stream:
        at, rest = 0, b""
        while True:
            rest = rest or stream.read(1 << 20)
            if not rest:
                return
            z, size, out = zlib.decompressobj(31), 0, []
            while not z.eof:
                if not rest and not (rest := stream.read(1 << 20)):
                    raise ValueError(f"{path} ends inside a record")
                out.append(z.decompress(rest))
                size += len(rest) - len(z.unused_data)
                rest = z.unused_data
            yield at, size, b"".join(out)
            at += size


def unpacked(data: bytes) -> bytes:
    return zlib.decompress(data, 31) if data[:2] == GZIP else data


def arc_records(path: str) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, size, place inside, record line and block) of the records of an ARC file, each found by the length before it.

    A plain file is read record by record; of a compressed one a member is held at a time.
    """
    store, name = open_store(path)
    with store.open_input_stream(name, compression=None) as stream:
        packed = stream.read(2) == GZIP
    if packed:
        for at, size, data in members(path):
            inside = 0
            while inside < len(data):
                line = data.index(b"\n", inside) + 1
                if (line - inside) > 1:
                    end = line + _declared(data[inside:line])
                    yield at, size, inside, data[inside:end]
                    line = end
                inside = line
        return
    with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
        at, rest = 0, b""
        while True:
            while (cut := rest.find(b"\n")) < 0 and (more := stream.read(1 << 16)):
                rest += more
            if cut < 0:
                return
            line, size = rest[: cut + 1], cut + 1
            if cut:
                size += _declared(line)
                if size > len(rest):
                    rest += stream.read(size - len(rest))
                yield at, size, 0, rest[:size]
            at, rest = at + size, rest[size:]


def _declared(line: bytes) -> int:
    return int(line.rsplit(b" ", 1)[1])


def _url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else "urn:absent"


def arc_header(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 panelwright\n{ARC_FIELDS[version]}\n\n".encode()
    tail = "text/plain" if version == 1 else f"text/plain 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, date: str, block: bytes, name: str, at: int) -> bytes:
    extra = "" if version == 1 else f"200 - - {at} {name} "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes, fields: list[str]) -> tuple[dict[str, str], bytes]:
    """Fields of the record line and the block of the declared length."""
    line, _, rest = data.partition(b"\n")
    found = dict(zip(fields, line.decode("utf-8", "replace").rsplit(" ", len(fields) - 1), strict=True))
    size = int(found["Archive-length"])
    if len(rest) < size:
        raise ValueError(f"a record declares {size} bytes and has {len(rest)}")
    return found, rest[:size]


def arc_fields(data: bytes) -> list[str]:
    """Field names that a version block defines; its own line has them too."""
    version = int(data.split(b"\n", 2)[1].split(b" ")[0])
    if version not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version}")
    parse_arc(data, ARC_FIELDS[version].split(" "))
    return data.split(b"\n")[2].decode().split(" ")


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}, body


def write_arc(pages: DataFrame, folder: str, date: str = "20240101000000") -> DataFrame:
    """ARC files of ``pages`` (page_id, url, html), one a partition, versions 1 and 2 in turn. Returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, empty = TaskContext.get().partitionId(), True
        name, version = f"part-{part:06d}.arc.gz", 1 + part % 2
        with AtomicFile(f"{folder}/arc", name) as out:
            for batch in batches:
                for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                    if empty:
                        out.write(member(arc_header(version, name, date)))
                        empty = False
                    body = html or b""
                    mark = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
                    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(body)}\r\n\r\n".encode() + body
                    out.write(member(arc_record(version, _url(url), date, block, name, out.tell())))
        if not empty:
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/arc/{name}"])})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string").cast("binary"))
    return stored(rows.mapInArrow(run, "path string"), "arc-files")


RECORDS = PLACES + ", page_id long, digest binary, strong binary, n_bytes long, kind string, fields string"


def scan_arc(files: DataFrame) -> DataFrame:
    """A row a record: place, page_id, digests and size of the payload, kind (info, response or resource), and the field names of its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fields, rows = None, []
                for at, size, inside, data in arc_records(path):
                    first = fields is None
                    fields = fields or arc_fields(data)
                    _, block = parse_arc(data, fields)
                    http, body = http_parts(block) if block.startswith(b"HTTP/") else (None, block)
                    page_id = int(http["x-page-id"]) if http and "x-page-id" in http else None
                    kind = "info" if first else "resource" if http is None else "response"
                    rows.append((path, at, size, inside, page_id, hashlib.sha1(body).digest(), hashlib.blake2b(body, digest_size=16).digest(), len(body), kind, " ".join(fields)))
                    if len(rows) == ROWS:
                        yield _table(rows, RECORDS)
                        rows = []
                yield _table(rows, RECORDS)

    return a_file_a_task(files).mapInArrow(run, RECORDS)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_pydict({n: pa.array(c, _KINDS[k]) for (n, k), c in zip(names, columns, strict=True)})


def record_id(page_id: int | None, place: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, place if page_id is None else f'page:{page_id}')}>"


def digest32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_info(found: dict[str, str], block: bytes, name: str) -> bytes:
    """The version block of an ARC file as a warcinfo record."""
    version, _, origin = block.split(b"\n", 1)[0].decode("utf-8", "replace").partition(" ")
    body = f"arc-version: {version}\r\narc-origin: {origin.partition(' ')[2]}\r\narc-file: {found['URL'].removeprefix('filedesc://')}\r\n".encode()
    lines = ["WARC/1.0", "WARC-Type: warcinfo", f"WARC-Record-ID: {name}", f"WARC-Date: {warc_date(found['Archive-date'])}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def warc_record(found: dict[str, str], block: bytes, digest: bytes, name: str, refers: str | None, kind: str = "response") -> bytes:
    """A response or resource, or with ``refers`` a revisit, which keeps the HTTP headers without the payload."""
    if refers:
        block = block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    content = "application/http; msgtype=response" if kind == "response" else "text/dns" if found["URL"].startswith("dns:") else found["Content-type"]
    lines = [
        "WARC/1.0", f"WARC-Type: {'revisit' if refers else kind}", f"WARC-Record-ID: {name}",
        f"WARC-Date: {warc_date(found['Archive-date'])}", f"WARC-Target-URI: {found['URL']}", f"WARC-IP-Address: {found['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest32(digest)}", f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {refers}"] if refers else []),
        f"Content-Type: {content}", f"Content-Length: {len(block)}",
    ]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def convert(files: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """WARC files of the ARC ``files``; payloads of at least ``least_bytes`` that repeat become revisits. Returns their paths."""
    records = stored(scan_arc(files), "arc-records")
    same = ["digest", "strong", "n_bytes"]
    last = records.where((F.col("n_bytes") >= least_bytes) & (F.col("kind") == "response")).groupBy(*same).agg(F.max("page_id").alias("target"))
    match = F.expr(" AND ".join(f"r.{c} = l.{c}" for c in same) + " AND r.kind = 'response'")
    judged = records.alias("r").join(last.alias("l"), match, "left").select("r.*", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")).alias("refers"))
    parts = max(1, files.distinct().count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened, source = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, None
        with AtomicFile(f"{folder}/warc", name) as out:
            for batch in batches:
                for path, at, size, inside, page_id, digest, kind, fields, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path != opened:
                        store, inner = open_store(path)
                        opened, source = path, store.open_input_file(inner)
                    source.seek(at)
                    found, block = parse_arc(unpacked(source.read(size))[inside:], fields.split(" "))
                    own = record_id(page_id, f"{path}:{at}:{inside}")
                    out.write(member(warc_info(found, block, own) if kind == "info" else warc_record(found, block, digest, own, None if refers is None else record_id(refers, ""), kind)))
            empty = out.tell() == 0
        if not empty:
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/warc/{name}"])})

    columns = ["path", "at", "size", "inside", "page_id", "digest", "kind", "fields", "refers"]
    ordered = judged.select(*columns).repartitionByRange(parts, "path", "at").sortWithinPartitions("path", "at", "inside")
    return stored(ordered.mapInArrow(run, "path string"), "warc-files")


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}
    size = int(found["content-length"])
    if len(rest) < size:
        raise ValueError(f"a record declares {size} bytes and has {len(rest)}")
    return found, rest[:size]


WARC = "record_id string, refers_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long"


def read_warc(files: DataFrame) -> DataFrame:
    """A row a response, revisit or resource record of the files; block digests and payload digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for _, _, data in members(path):
                    found, block = parse_warc(data)
                    if (kind := found["warc-type"]) not in ("response", "revisit", "resource"):
                        continue
                    http, body = http_parts(block) if kind != "resource" else ({}, block)
                    digest = found["warc-payload-digest"].removeprefix("sha1:")
                    if found["warc-block-digest"] != f"sha1:{digest32(hashlib.sha1(block).digest())}" or kind != "revisit" and digest32(hashlib.sha1(body).digest()) != digest:
                        raise ValueError(f"a digest in {path} doesn't hold")
                    page_id = int(http["x-page-id"]) if "x-page-id" in http else None
                    size = int(http["content-length"]) if "content-length" in http else None if kind == "revisit" else len(body)
                    rows.append((found["warc-record-id"], found.get("warc-refers-to"), page_id, found["warc-target-uri"], kind, digest, size))
                    if len(rows) == ROWS:
                        yield _table(rows, WARC)
                        rows = []
                yield _table(rows, WARC)

    return a_file_a_task(files).mapInArrow(run, WARC)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    arcs = write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = stored(read_warc(convert(arcs, folder)), "warc-records")
    ids = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("named")).agg(F.max("page_id").alias("refers_to"))
    return records.join(ids, records.refers_id == ids.named, "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages
), m AS (
  SELECT h, max(page_id) AS target FROM p GROUP BY h
)
SELECT p.page_id, octet_length(encode(p.h)) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(p.d, 5 * k + 1, 5))::BIGINT >> (15 - 5 * j)) & 31) + 1)::INTEGER, 1)), '')), '') AS payload_digest,
  CASE WHEN p.page_id = m.target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> m.target THEN m.target END AS refers_to
FROM p JOIN m ON p.h = m.h
"""
