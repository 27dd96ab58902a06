"""WARC files and a two-level capture index.

Records are written as gzip members, one a record, so that each can be read alone.
Of records with equal payloads that of the smallest page_id is a response, the
others are revisits (profile identical-payload-digest) that name it and keep its
HTTP header with the length, but no payload.

The index follows the capture index of web archives. Its lines, (reversed-host URL
key, page_id, file, offset, length), are sorted over all tasks by key and page_id and
stored in blocks of BLOCK_LINES lines, each a gzip member. Beside each file of blocks
stands its sparse directory: the first key of every block with its place. The driver
holds one row a file. CaptureIndex.find() binary-searches the files, then one file's
directory, reads the block that can hold the key, searches that, and then reads single
records by range. read_pages() does so in tasks for any table of pages: sorted by key,
so that a block is read about once, and record by record in the order of the archives.

Files are written under new names in the shared folder and count only through the
rows that their tasks return, so a repeated task leaves at most an unused file.
Digests, ids and index lines move, and payloads only where more than REPEATED of them
are stored more than once.

Defined cases: a null html is an empty payload, a null URL an empty one; URLs that
cannot be parsed sort under their own text; a null page_id comes after all others
and is written without a number; rows that share a page_id are records of their
own, and responses if their page_id is the smallest; a very long payload is held whole
by the task that writes or reads it; other columns are not read; an empty table gives
no files and an empty index.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections import OrderedDict
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm._shared import keep, maybe_broadcast, shared_dir, table
from factloom.llm._text import slices

BLOCK_LINES = 2000
#: Repeated payloads whose digests are broadcast (about 100 bytes each); beyond it pages are shuffled by digest.
REPEATED = 200_000
#: Pages that one task reads back, about.
READ_PAGES = 4000
#: Blocks and directories that a worker holds.
_HELD_BLOCKS = 64
_DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
_VERSION = b"WARC/1.1\r\n"


def url_key(url: str | None) -> str:
    """The host reversed, comma-joined, then ')' and the path with the query: pages of a domain sort together; without tabs and line ends, which part the lines of the index."""
    url = re.sub(r"[\t\r\n]", " ", url or "")
    try:
        x = urlsplit(url)
        host, port = (x.hostname or "").rstrip("."), x.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    host = ",".join(reversed(host.removeprefix("www.").split(".")))
    usual = {"http": 80, "https": 443}.get(x.scheme)
    query = "&".join(sorted(x.query.split("&"))) if x.query else ""
    path = x.path.rstrip("/") or "/"
    return (host + (f":{port}" if port and port != usual else "") + ")" + path + (f"?{query}" if query else "")).lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(x: str | None) -> str:
    """A value without line breaks, for headers."""
    return re.sub(r"[\x00-\x1f\x7f]+", "%20", x or "")


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, ' '.join(map(str, parts)))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, kind: str, place: str = "") -> bytes:
    """One record as a gzip member. A response is named by its page and payload, a revisit also by its place."""
    own = _record_id(page_id, digest(payload)) if kind == "response" else _record_id(page_id, digest(payload), place)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest(payload))}", f"X-Refers-To-Page-ID: {refers_to}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(_VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(plain: bytes) -> dict:
    """The headers of one record, with `payload` and `payload_bytes`, the length in its HTTP header."""
    if not plain.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = re.search(rb"Content-Length: ([0-9]+)", http)
    return fields | {"payload": payload, "payload_bytes": int(length[1]) if length else len(payload)}


def _open(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


def _create(folder: str, name: str):
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return fs.open_output_stream(f"{base}/{name}", compression=None)


_INDEX_SCHEMA = "url_key string, page_id bigint, file string, offset bigint, length bigint, record_type string"


def write_records(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files; returns the index lines, kept."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    last = F.lit(2**63 - 1)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("sha1"))
    first = rows.groupBy("sha1").agg(F.min(F.coalesce("page_id", last)).alias("first"), F.count("*").alias("copies"))
    # only digests of repeated payloads are joined to the pages, and only their revisits keep an entry
    repeated = first.where("copies > 1").drop("copies")
    joined = rows.join(maybe_broadcast(keep(repeated), REPEATED), "sha1", "left").drop("sha1")

    def write(batches):
        from pyspark import TaskContext

        sink, name, at = None, f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.warc.gz", 0
        for batch in batches:
            for part in slices(batch, "html"):
                out = []
                sink = sink or _create(folder, name)
                for page_id, url, html, first_id in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                    kind = "response" if first_id is None or first_id == (2**63 - 1 if page_id is None else page_id) else "revisit"
                    packed = record(page_id, url, html.encode(), first_id, kind, f"{name} {at}")
                    sink.write(packed)
                    out.append((url_key(url), page_id, f"{folder}/{name}", at, len(packed), kind))
                    at += len(packed)
                yield _lines(out)
        if sink is not None:
            sink.close()

    return keep(joined.select("page_id", "url", "html", "first").mapInArrow(write, _INDEX_SCHEMA))


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["url_key", "page_id", "file", "offset", "length", "record_type"])


_LAST = 2**63  # a null page_id sorts behind all others


def write_index(lines: DataFrame, folder: str) -> CaptureIndex:
    """Sort the lines over all tasks and write them as compressed blocks, with a directory beside each file."""
    order = [F.col("url_key").asc(), F.col("page_id").asc_nulls_last()]
    parts = min(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // BLOCK_LINES))
    ordered = lines.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order, "file", "offset")

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sink, name, at, held, directory, total = None, f"{part:08d}-{uuid.uuid4().hex}", 0, [], [], 0

        def block():
            nonlocal at, total
            packed = gzip.compress("".join(held).encode(), 6, mtime=0)
            sink.write(packed)
            key, page = held[0].split("\t", 2)[:2]
            directory.append(f"{key}\t{page}\t{at}\t{len(packed)}\n")
            at, total = at + len(packed), total + len(held)
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                sink = sink or _create(folder, f"{name}.cdx.gz")
                held.append("\t".join("" if x is None else str(x) for x in row) + "\n")
                if len(held) == BLOCK_LINES:
                    block()
        if held:
            block()
        if sink is not None:
            sink.close()
            with _create(folder, f"{name}.dir.gz") as beside:
                beside.write(gzip.compress("".join(directory).encode(), 6, mtime=0))
            key, page = directory[0].split("\t", 2)[:2]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            row = (part, key, int(page) if page else None, f"{folder}/{name}", len(directory), total)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds)], ["part", "url_key", "page_id", "path", "blocks", "lines"])

    files = ordered.mapInArrow(write, "part bigint, url_key string, page_id bigint, path string, blocks bigint, lines bigint").collect()
    files = sorted(files, key=lambda r: r["part"])
    return CaptureIndex([_place(r["url_key"], r["page_id"]) for r in files], [r["path"] for r in files], sum(r["lines"] for r in files))


def _place(key: str, page_id: int | None) -> tuple[str, int]:
    return key, _LAST if page_id is None else page_id


def _rows(packed: bytes) -> list[list[str]]:
    return [x.split("\t") for x in gzip.decompress(packed).decode().split("\n")[:-1]]


_HELD: OrderedDict[tuple, tuple[list, list]] = OrderedDict()


def _read_rows(path: str, offset: int = 0, length: int | None = None) -> tuple[list[tuple[str, int]], list[list[str]]]:
    """The sorted keys and the rows of a directory or a block, from this worker's memory if they are held."""
    name = (path, offset)
    if name not in _HELD:
        with _open(path) as source:
            source.seek(offset)
            rows = _rows(source.read(length) if length is not None else source.read())
        _HELD[name] = [_place(x[0], int(x[1]) if x[1] else None) for x in rows], rows
        if len(_HELD) > _HELD_BLOCKS:
            _HELD.popitem(last=False)
    _HELD.move_to_end(name)
    return _HELD[name]


@dataclass(frozen=True)
class CaptureIndex:
    """The first key and the name of each index file, in order (one row a task that wrote), and lookups through them."""

    first: list[tuple[str, int]]
    paths: list[str]
    lines: int

    def find(self, url: str | None, page_id: int | None = None, every: bool = True) -> list[dict]:
        """The captures of a URL, or, without `every`, that of one page: file, block and line by binary search."""
        return self.captures(url_key(url), page_id, every)

    def captures(self, key: str, page_id: int | None, every: bool = False) -> list[dict]:
        low, high = ((key, -_LAST), (key, _LAST)) if every else (_place(key, page_id),) * 2
        out = []
        # keys equal to `low` may begin in the block before the first one that begins with them
        for k in range(max(0, bisect.bisect_left(self.first, low) - 1), bisect.bisect_right(self.first, high)):
            starts, blocks = _read_rows(f"{self.paths[k]}.dir.gz")
            for b in range(max(0, bisect.bisect_left(starts, low) - 1), bisect.bisect_right(starts, high)):
                keys, rows = _read_rows(f"{self.paths[k]}.cdx.gz", int(blocks[b][2]), int(blocks[b][3]))
                for x in rows[bisect.bisect_left(keys, low) : bisect.bisect_right(keys, high)]:
                    out.append({"url_key": x[0], "page_id": int(x[1]) if x[1] else None, "file": x[2], "offset": int(x[3]), "length": int(x[4]), "record_type": x[5]})
        return out

    @staticmethod
    def read(capture: dict) -> dict:
        """The record of a capture, read by range."""
        with _open(capture["file"]) as source:
            return _read_record(source, capture)


def _read_record(source, capture: dict) -> dict:
    source.seek(capture["offset"])
    return parse(gzip.decompress(source.read(capture["length"])))


_READ_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_pages(pages: DataFrame, index: CaptureIndex) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of pages (page_id, url), found through the index and read by range."""

    def ask(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], ["url_key", "page_id"])

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                keys, ids = (batch.column(c).slice(at, 1000).to_pylist() for c in ("url_key", "page_id"))
                found = []
                for key, page_id in zip(keys, ids):
                    captures = index.captures(key, page_id)
                    if not captures:
                        raise ValueError(f"no capture of page {page_id}")
                    found += captures
                out, source, path = [], None, None
                for x in sorted(found, key=lambda x: (x["file"], x["offset"])):
                    if x["file"] != path:
                        if source is not None:
                            source.close()
                        source, path = _open(x["file"]), x["file"]
                    out.append(_checked(_read_record(source, x), x))
                if source is not None:
                    source.close()
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    asked = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url").mapInArrow(ask, "url_key string, page_id bigint").distinct()
    order = [F.col("url_key").asc(), F.col("page_id").asc_nulls_last()]
    return asked.repartitionByRange(max(1, -(-index.lines // READ_PAGES)), *order).sortWithinPartitions(*order).mapInArrow(read, _READ_SCHEMA)


def _checked(x: dict, capture: dict) -> tuple:
    """The row of a record, which must be the one that the index names, and whole."""
    said = x["WARC-Payload-Digest"].removeprefix("sha1:")
    page, to = x.get("X-Page-ID"), x.get("X-Refers-To-Page-ID")
    page = int(page) if page else None
    whole = x["WARC-Type"] != "response" or (digest(x["payload"]) == said and len(x["payload"]) == x["payload_bytes"])
    if not whole or page != capture["page_id"] or x["WARC-Type"] != capture["record_type"]:
        raise ValueError(f"a damaged record in {capture['file']} at {capture['offset']}")
    return page, x["payload_bytes"], said, x["WARC-Type"], int(to) if to else None


def write_archive(pages: DataFrame, folder: str) -> CaptureIndex:
    """Write records and index."""
    return write_index(write_records(pages, f"{folder}/warc"), f"{folder}/index")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return read_pages(pages, write_archive(pages, shared_dir(spark)))
