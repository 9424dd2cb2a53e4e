"""WARC archives with a two-level capture index.

Writing: every page becomes a WARC record, gzip member by member. Of pages with equal payloads of at least a minimum
size, the one with the smallest id is a response; the others are revisits that refer to it and carry no payload. Each
task writes archives of its own below the shared folder and returns where each record lies.

Index: captures are sorted by reversed-host URL key and page id over all tasks. Each task writes its run as compressed
blocks of ``BLOCK_ROWS`` captures, and a sparse directory with the first key of each block. Only one row per run, its
first key and its files, is known to all. A lookup finds the run, then the block by binary search in the directory,
then the capture by binary search in the block, and reads the record's range from its archive.

Files are named anew by each attempt of a task and only named rows are used, so lost executors leave at most files that
nobody reads. Null html is an empty payload, a null url an empty target, with a key of its own before all others.
Repeated rows write a record each; equal pages with the same, smallest id are all responses. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, work_folder

#: Payloads below this size are never revisits.
MIN_REVISIT_BYTES = 0
BLOCK_ROWS = 300
#: An archive is closed when it has this size.
ARCHIVE_BYTES = 256 << 20
#: Bytes of records that a reading task fetches, about.
READ_BYTES = 4 << 20
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PLACED = "surt string, page_id long, file string, start long, length long"
RUNS = "first_surt string, first_page long, blocks string, directory string, captures long, bytes long"
READ = "page_id long, target string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def url_key(url: str | None) -> str:
    """Reversed host and lower-cased rest: captures of one host, and of its subdomains, sort together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return ")" + url.lower()
    place = f":{port}" if port not in (None, 80, 443) else ""
    query = f"?{'&'.join(sorted(parts.query.lower().split('&')))}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{place}){parts.path.lower() or '/'}{query}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A WARC record: a response with the payload, or a revisit that refers to another page's."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda c: f"%{ord(c[0]):02X}", url))
    if refers_to is None:
        body += payload
    else:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(body)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Head fields of a record, and its payload. Size and digest of a payload are those of the bytes read.

    A payload that is not what its record's head says is an error. A revisit has no payload: its head speaks for it.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    target = fields.get("WARC-Target-URI")
    refers = fields.get("WARC-Refers-To")
    size, sha1 = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if refers is None:
        payload = body.partition(b"\r\n\r\n")[2]
        read = len(payload), digest(payload)
        if read != (size, sha1):
            raise ValueError(f"{fields['WARC-Record-ID']}: read {read}, written {(size, sha1)}")
        size, sha1 = read
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "target": None if target is None else re.sub(r"%([0-9A-F]{2})", lambda c: chr(int(c[1], 16)), target),
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": sha1,
        "record_type": fields["WARC-Type"],
        "refers_to": None if refers is None else page_of(refers),
    }


def page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


class Folder:
    """Files of the shared folder, whatever store it is in."""

    def __init__(self, uri: str):
        self.store, self.path = FileSystem.from_uri(uri)
        self.store.create_dir(self.path, recursive=True)
        self.readers: dict[str, pa.NativeFile] = {}

    def new(self, kind: str) -> tuple[str, pa.NativeFile]:
        name = f"{kind}-{uuid.uuid4().hex}"
        return name, self.store.open_output_stream(f"{self.path}/{name}")

    def read(self, name: str, start: int, length: int) -> bytes:
        if name not in self.readers:
            if len(self.readers) >= 64:
                self.readers.pop(next(iter(self.readers))).close()
            self.readers[name] = self.store.open_input_file(f"{self.path}/{name}")
        return self.readers[name].read_at(length, start)

    def whole(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.path}/{name}") as found:
            return found.read()


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, html) to (page_id, digest, size)."""
    for batch in batches:
        payloads = batch.column("html").cast(pa.large_binary()).fill_null(b"").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), pa.array([digest(x) for x in payloads]), pa.array([len(x) for x in payloads])],
            ["page_id", "digest", "size"],
        )


def archiver(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper that writes (page_id, url, html, decided) as records and returns where they lie.

    ``decided`` has, by payload digest, the page that a revisit refers to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, name, out, at = Folder(folder), "", None, 0
        for batch in batches:
            rows = []
            columns = (batch.column(x).to_pylist() for x in ("page_id", "url", "html", "decided"))
            for page, url, html, decided in zip(*columns, strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    (name, out), at = place.new("archive"), 0
                payload = (html or "").encode("utf-8", "surrogatepass")
                sha1 = digest(payload)
                refers = next((x["refers_to"] for x in decided or () if x["digest"] == sha1), None)
                packer = zlib.compressobj(4, wbits=31)
                member = packer.compress(record(page, url, payload, sha1, refers)) + packer.flush()
                out.write(member)
                rows.append((url_key(url), page, name, at, len(member)))
                at += len(member)
            yield columns_of(rows, PLACED)
        if out is not None:
            out.close()

    return run


def columns_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def order_of(surt: str, page: int | None) -> tuple[bytes, int]:
    """The order of the index, the same as Spark's: bytes of the key, then page id, nulls first."""
    return surt.encode("utf-8", "surrogatepass"), -(1 << 63) - 1 if page is None else page


def indexer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper that writes one sorted run of captures as blocks with a directory, and returns the run's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out, name, at, total, size = Folder(folder), None, "", 0, 0, 0
        directory: list[str] = []
        waiting: list[list[str]] = []
        first = None

        def close_block() -> None:
            nonlocal at
            data = zlib.compress("\n".join("\t".join(x) for x in waiting).encode("utf-8", "surrogatepass"), 6)
            out.write(data)
            directory.append("\t".join([*waiting[0][:2], str(at), str(len(data))]))
            at += len(data)
            waiting.clear()

        for batch in batches:
            columns = (batch.column(x).to_pylist() for x in ("surt", "page_id", "file", "start", "length"))
            for surt, page, file, start, length in zip(*columns, strict=True):
                if out is None:
                    (name, out), first = place.new("index"), (surt, page)
                waiting.append([escaped(surt), "" if page is None else str(page), file, str(start), str(length)])
                total += 1
                size += length
                if len(waiting) == BLOCK_ROWS:
                    close_block()
        if out is not None:
            if waiting:
                close_block()
            out.close()
            listed, sparse = place.new("directory")
            sparse.write("\n".join(directory).encode("utf-8", "surrogatepass"))
            sparse.close()
            yield columns_of([(*first, name, listed, total, size)], RUNS)

    return run


def escaped(surt: str) -> str:
    return re.sub(r"[\t\n%]", lambda c: f"%{ord(c[0]):02X}", surt)


def plain(surt: str) -> str:
    return re.sub(r"%(09|0A|25)", lambda c: chr(int(c[1], 16)), surt)


def key_of(surt: str, page: str) -> tuple[bytes, int]:
    return order_of(plain(surt), int(page) if page else None)


class Index:
    """Looks captures up: run, block, capture; keeps the last run's directory and the last block."""

    def __init__(self, folder: str, runs: list[tuple]):
        self.place = Folder(folder)
        self.runs = sorted(runs, key=lambda x: order_of(x[0], x[1]))
        self.firsts = [order_of(x[0], x[1]) for x in self.runs]
        self.opened, self.directory, self.keys = -1, [], []
        self.block, self.rows, self.row_keys = (-1, -1), [], []

    def find(self, surt: str, page: int | None) -> list[tuple[str, int, int]]:
        """(file, start, length) of every record of a capture."""
        wanted, out = order_of(surt, page), []
        run = bisect_right(self.firsts, wanted) - 1
        # Repeated rows of one capture may lie on both sides of a border.
        while run >= 0:
            before = len(out)
            self.open_run(run)
            block = bisect_right(self.keys, wanted) - 1
            while block >= 0:
                self.open_block(run, block)
                low, high = bisect_left(self.row_keys, wanted), bisect_right(self.row_keys, wanted)
                out += [(x[2], int(x[3]), int(x[4])) for x in self.rows[low:high]]
                if low or self.row_keys[0] < wanted:
                    return out
                block -= 1
            if len(out) == before and self.firsts[run] < wanted:
                return out
            run -= 1
        return out

    def open_run(self, run: int) -> None:
        if self.opened != run:
            text = self.place.whole(self.runs[run][3]).decode("utf-8", "surrogatepass")
            self.directory = [line.split("\t") for line in text.split("\n")]
            self.keys = [key_of(*x[:2]) for x in self.directory]
            self.opened = run

    def open_block(self, run: int, block: int) -> None:
        if self.block != (run, block):
            _, _, start, length = self.directory[block]
            data = zlib.decompress(self.place.read(self.runs[run][2], int(start), int(length)))
            self.rows = [line.split("\t") for line in data.decode("utf-8", "surrogatepass").split("\n")]
            self.row_keys = [key_of(*x[:2]) for x in self.rows]
            self.block = (run, block)


def reader(folder: str, runs: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper from wanted captures (surt, page_id) to their records, read through the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, runs)
        for batch in batches:
            rows, size = [], 0
            for surt, page in zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist(), strict=True):
                for file, start, length in index.find(surt, page):
                    found = parsed(zlib.decompress(index.place.read(file, start, length), 31))
                    rows.append(tuple(found.values()))
                    size += len(found["payload"] or b"")
                if size > 1 << 23:
                    yield columns_of(rows, READ)
                    rows, size = [], 0
            yield columns_of(rows, READ)

    return run


def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([url_key(x) for x in batch.column("url").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([keys, batch.column("page_id")], ["surt", "page_id"])


class Archive:
    """Archives and their index in one folder."""

    def __init__(self, folder: str, runs: list[tuple]):
        self.folder, self.runs = folder, runs

    @classmethod
    def write(cls, pages: DataFrame, folder: str | None = None) -> Archive:
        """Writes ``pages(page_id, url, html)``."""
        folder = folder or work_folder(pages.sparkSession, "warc")
        pages = pages.select(
            F.col("page_id").cast("long").alias("page_id"), *(F.col(x).cast("string").alias(x) for x in ("url", "html"))
        )
        digests = pages.select("page_id", "html").mapInArrow(digest_rows, "page_id long, digest string, size long")
        digests = staged(digests.where(F.col("size") >= MIN_REVISIT_BYTES).drop("size"), "digests")
        first = digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("found"))
        revisits = digests.join(first.where("found > 1").drop("found"), "digest").where("page_id <> refers_to")
        revisits = staged(revisits.select("page_id", "digest", "refers_to").distinct(), "revisits")
        # A page id that comes with two payloads has a decision for each.
        decided = revisits.groupBy("page_id").agg(F.collect_list(F.struct("digest", "refers_to")).alias("decided"))
        placed = staged(pages.join(decided, "page_id", "left").mapInArrow(archiver(folder), PLACED), "placed")
        ordered = placed.repartitionByRange("surt", "page_id").sortWithinPartitions("surt", "page_id")
        runs = ordered.mapInArrow(indexer(folder), RUNS).collect()
        return cls(folder, [tuple(x) for x in runs])

    def read(self, captures: DataFrame) -> DataFrame:
        """Records of ``captures(page_id, url)``, one for each record of each distinct capture."""
        wanted = captures.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"))
        wanted = wanted.mapInArrow(key_rows, "surt string, page_id long").distinct()
        # A key is small, but each one fetches a record: tasks follow the bytes to be read.
        tasks = max(1, -(-sum(run[5] for run in self.runs) // READ_BYTES))
        wanted = wanted.repartitionByRange(tasks, "surt", "page_id").sortWithinPartitions("surt", "page_id")
        return wanted.mapInArrow(reader(self.folder, self.runs), READ)
