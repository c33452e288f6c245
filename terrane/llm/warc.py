"""WARC archives: written as one gzip stream, normalised to a member per record, read by offset.

``write_archives`` gives whole-file gzip streams, as crawlers' tools often leave them.
``normalise`` inflates such a stream once, from front to back, rewrites every record
as a gzip member of its own and writes a sidecar of offsets. ``read_by_offset`` then
opens single members. Files go through pyarrow's file systems, into the shared folder;
each is written under a name of the attempt and moved, so a retried task leaves whole
files only. Memory holds one record and one block of inflated bytes at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Raw bytes after which a writer starts the next archive.
ROLL_BYTES = 512 << 20
#: Index rows that a task holds at a time.
ROWS = 20_000
DATE = "2024-01-01T00:00:00Z"
INDEX = "archive string, record long, offset long, length long, record_id string, record_type string, page_id long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": quote(url, safe=":/?#[]@!$&'()*+,;=%-._~") if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    if refers_to is not None:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = record_id(refers_to, digest)
        head["WARC-Refers-To-Page-ID"] = str(refers_to)
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def heads(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def inflate(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in blocks of ``chunk`` at most; a cut-off member is an error."""
    z, fresh = zlib.decompressobj(31), True
    while data := stream.read(chunk):
        while data:
            yield z.decompress(data, chunk)
            fresh = z.eof
            if z.eof:
                data = z.unused_data
                z = zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail
    if not fresh:
        while more := z.decompress(z.unconsumed_tail, chunk):
            yield more
        if not z.eof:
            raise ValueError("the stream ends within a gzip member")


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(head fields, block, raw record) of a WARC byte stream."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = next(parts, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        while need(1) and held[:1] in (b"\r", b"\n"):
            del held[:1]
        if not held:
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(len(held) + 1):
                raise ValueError("a record's head is cut off")
        head = heads(bytes(held[:end]))
        size = end + 4 + int(head["content-length"])
        if not need(size):
            raise ValueError("a record's block is cut off")
        raw = bytes(held[:size])
        del held[:size]
        yield head, raw[end + 4 :], raw + b"\r\n\r\n"


class Output:
    """A file under the attempt's name, moved to its own when it is whole."""

    def __init__(self, uri: str):
        from pyarrow import fs

        self.uri = uri
        parent, _, name = uri.rpartition("/")
        self.fs, folder = fs.FileSystem.from_uri(parent)
        self.fs.create_dir(folder, recursive=True)
        self.path = f"{folder}/{name}"
        self.own = f"{folder}/.{name}.{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.own, compression=None)

    def close(self) -> None:
        """Attempts write the same bytes: where another one's file is in place already, it stays."""
        self.stream.close()
        try:
            self.fs.move(self.own, self.path)
        except OSError:
            if not self.fs.get_file_info(self.path).is_file:
                raise
            self.fs.delete_file(self.own)


def opened(uri: str, random: bool = False):
    from pyarrow import fs

    f, path = fs.FileSystem.from_uri(uri)
    return f.open_input_file(path) if random else f.open_input_stream(path, compression=None)


def number(x: str | None) -> int | None:
    return int(x) if x else None


def table(form: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch; whole numbers stay whole beside nulls."""
    columns = list(zip(*rows)) or [()] * len(form)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, form)], [name for name, _ in form])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """pages: page_id, url, payload, digest, refers_to. One row per archive: path, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, done = TaskContext.get().partitionId(), [], 0
        out = z = None
        size = n = 0
        for b in batches:
            for page, url, payload, digest, ref in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    out, z = Output(f"{folder}/raw-{part:06d}-{done:04d}.warc.gz"), zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = record(page, url, payload.encode(), digest, ref)
                out.stream.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size > ROLL_BYTES:
                    out.stream.write(z.flush())
                    out.close()
                    made.append((out.uri, n))
                    out, size, n, done = None, 0, 0, done + 1
        if out is not None:
            out.stream.write(z.flush())
            out.close()
            made.append((out.uri, n))
        yield table([("path", pa.string()), ("n", pa.int64())], made)

    return pages.mapInArrow(run, "path string, n long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """A member per record and a sidecar ``.idx`` (a JSON object a line) for each archive in ``path`` of ``n`` records; the index rows."""

    def one(uri: str, n: int) -> Iterator[tuple]:
        name = uri.rpartition("/")[2].removeprefix("raw-").removesuffix(".warc.gz")
        out, side = Output(f"{folder}/{name}.warc.gz"), Output(f"{folder}/{name}.warc.gz.idx")
        offset, k = 0, -1
        with opened(uri) as stream:
            for k, (head, _, raw) in enumerate(records(inflate(stream))):
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                out.stream.write(member)
                row = (out.uri, k, offset, len(member), head["warc-record-id"], head["warc-type"], number(head.get("warc-page-id")))
                side.stream.write((json.dumps(dict(zip(("record", "offset", "length", "id", "type"), row[1:6]))) + "\n").encode())
                offset += len(member)
                yield row
        if k + 1 != n:
            raise ValueError(f"{uri} holds {k + 1} records, not {n}")
        out.close()
        side.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = [(c.split(" ")[0], {"long": pa.int64(), "string": pa.string()}[c.split(" ")[1]]) for c in INDEX.split(", ")]
        for b in batches:
            for uri, n in zip(b.column("path").to_pylist(), b.column("n").to_pylist()):
                rows = one(uri, n)
                while part := list(islice(rows, ROWS)):
                    yield table(form, part)

    return archives.mapInArrow(run, INDEX)


def read_by_offset(archives: DataFrame) -> DataFrame:
    """Every record of the normalised archives in ``archive``, each from its own member by the sidecar."""
    def one(uri: str) -> Iterator[tuple]:
        with opened(f"{uri}.idx") as side:
            entries = [json.loads(line) for line in side.read().splitlines()]
        with opened(uri, random=True) as f:
            for e in entries:
                f.seek(e["offset"])
                [(head, block, _)] = records(iter([zlib.decompress(f.read(e["length"]), 31)]))
                if head["warc-record-id"] != e["id"]:
                    raise ValueError(f"the index of {uri} is off at record {e['record']}")
                at = block.index(b"\r\n\r\n")
                size, digest = int(heads(block[:at])["content-length"]), head["warc-payload-digest"].removeprefix("sha256:")
                if head["warc-type"] == "response":
                    payload = block[at + 4 :]
                    if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"record {e['record']} of {uri} does not match its digest")
                yield number(head.get("warc-page-id")), size, digest, head["warc-type"], number(head.get("warc-refers-to-page-id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
        for b in batches:
            for uri in b.column("archive").to_pylist():
                rows = one(uri)
                while part := list(islice(rows, ROWS)):
                    yield table(form, part)

    return archives.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC, normalises the files and reads them back by offset.

    Of pages with equal payloads of at least ``least`` bytes, the smallest page_id is
    the response and others are revisits of it; rows that repeat that page_id are
    responses too. A null html is an empty payload; pages without an id are responses,
    as nothing can tell them apart. Other columns are ignored; an empty table gives
    an empty one; ids are never rounded. Groups of copies are compared by digest on narrow rows only.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    narrow = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    # a table of its own, so that the copies of one page, however many, can be dealt to several tasks
    first = ws.save(first, "first")
    revisits = narrow.join(first, "digest").where("page_id > refers_to").distinct()
    archives = ws.save(write_archives(rows.join(revisits, ["page_id", "digest"], "left"), f"{ws.root}/raw"), "archives")
    n = max(1, archives.count())
    index = ws.save(normalise(archives.repartition(2 * n, "path"), f"{ws.root}/warc"), "index")
    return read_by_offset(index.select("archive").repartition(2 * n, "archive").distinct())
