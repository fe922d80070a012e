"""WARC archives of pages, and their records as chunk rows."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabwright.llm.common import column, small_batches, written
from tabwright.session import scratch_dir

LEAST_SHARED = 1000  # bytes from which equal payloads share one response record
CHUNK_BYTES = 1 << 20
READ_BYTES = 256 << 10
ARCHIVE_BYTES = 256 << 20  # an archive is closed beyond this size; each is read by one task
# Names and forms of the record format.
VERSION = b"WARC/1.0\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "archive string, records bigint, bytes bigint"
CHUNKS = (
    "record_id string, page_id bigint, record_type string, refers_to bigint, chunk_no bigint, chunk_offset bigint, chunk_bytes bigint, "
    "running_sha1 string, last boolean, payload_bytes bigint, payload_digest string"
)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder that all executors reach."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


class Archive:
    """One archive, written record by record; each record is a gzip member of its own."""

    def __init__(self, folder: str, name: str):
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        self.name, self.records, self.bytes = f"{folder}/{name}", 0, 0
        self.out = fs.open_output_stream(f"{path}/{name}")

    def add(self, fields: list[tuple[str, object]], payload: memoryview, http: bytes) -> None:
        head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        self._put(packer.compress(head + f"Content-Length: {len(http) + len(payload)}\r\n\r\n".encode() + http))
        for start in range(0, len(payload), CHUNK_BYTES):
            self._put(packer.compress(payload[start : start + CHUNK_BYTES]))
        self._put(packer.compress(b"\r\n\r\n") + packer.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``(page_id, url, html, size, digest, first_id)`` and returns the manifest of archives.

    Every task attempt writes files of its own name, and only a finished attempt returns their
    names, so files of a lost executor are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, archive, made = TaskContext.get(), None, 0

        def close(a: Archive) -> pa.RecordBatch:
            a.out.close()
            return pa.RecordBatch.from_pylist([{"archive": a.name, "records": a.records, "bytes": a.bytes}])

        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for row in range(batch.num_rows):
                page_id, url, html, size, digest, first = (c[row].as_py() if i != 2 else c[row] for i, c in enumerate(columns))
                if archive is None:
                    archive, made = Archive(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{made:04d}.warc.gz"), made + 1
                again = first is not None and first != page_id
                fields = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE),
                    ("WARC-Target-URI", quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")), ("WARC-Payload-Digest", f"sha1:{digest}"),
                    ("WARC-Profile", PROFILE if again else None), ("WARC-Refers-To", record_id(first) if again else None),
                    ("X-Page-Id", page_id), ("X-Refers-To-Page", first if again else None), ("X-Payload-Length", size),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                body = html.as_buffer() if not again and html.is_valid else None
                archive.add(fields, memoryview(body) if body else memoryview(b""), HTTP_HEAD)
                if archive.bytes >= ARCHIVE_BYTES:
                    yield close(archive)
                    archive = None
        if archive is not None:
            yield close(archive)

    return pages.mapInArrow(run, MANIFEST)


class RecordReader:
    """Records of one archive from a stream of small reads; nothing is held but one read."""

    def __init__(self, stream):
        self.stream, self.unpack, self.held, self.raw = stream, zlib.decompressobj(31), b"", b""

    def _more(self) -> bool:
        """Unpack further; at most READ_BYTES at a time, however far a member expands."""
        while True:
            data = self.unpack.unconsumed_tail or self.raw
            if not data:
                data = self.stream.read(READ_BYTES)
                if not data:
                    return False
            elif not self.unpack.unconsumed_tail:
                self.raw = b""
            made = self.unpack.decompress(data, READ_BYTES)
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data, zlib.decompressobj(31)
            if made:
                self.held += made
                return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.held:
            if not self._more():
                return None
        line, self.held = self.held.split(b"\r\n", 1)
        return line

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError("an archive ends within a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece

    def fields(self) -> dict[str, str] | None:
        """Header of the next record."""
        line = self.line()
        while line == b"":
            line = self.line()
        if line is None:
            return None
        if line + b"\r\n" != VERSION:
            raise ValueError("not the start of a record")
        found = {}
        while line := self.line():
            name, value = line.decode().split(": ", 1)
            found[name] = value
        return found


def record_chunks(reader: RecordReader, fields: dict[str, str], data: bool) -> Iterator[dict]:
    """The chunk rows of one record: each has the SHA-1 of all payload bytes up to its end."""
    left, http = int(fields["Content-Length"]), 0
    while line := reader.line():
        http += len(line) + 2
    left -= http + 2
    page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page")
    base = {"record_id": fields["WARC-Record-ID"], "page_id": int(page) if page else None, "record_type": fields["WARC-Type"], "refers_to": int(refers) if refers else None}
    digest, number, offset = hashlib.sha1(), 0, 0
    while True:
        size, kept = min(left, CHUNK_BYTES), []
        for piece in reader.take(size):
            digest.update(piece)
            if data:
                kept.append(piece)
        left -= size
        row = base | {"chunk_no": number, "chunk_offset": offset, "chunk_bytes": size, "running_sha1": digest.copy().hexdigest(), "last": left == 0, "payload_bytes": None, "payload_digest": None}
        number, offset = number + 1, offset + size
        if left == 0:
            said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            whole = base["record_type"] != "revisit"
            if whole and said != row["running_sha1"]:
                raise ValueError(f"record {base['record_id']}: the payload does not have its digest")
            row |= {"payload_bytes": offset if whole else int(fields["X-Payload-Length"]), "payload_digest": row["running_sha1"] if whole else said}
        yield row | ({"data": b"".join(kept)} if data else {})
        if left == 0:
            return


def read_archives(manifest: DataFrame, data: bool = True) -> DataFrame:
    """Chunk rows ``(record_id, chunk_no)`` of all records of the archives in a manifest.

    A payload comes in chunks of CHUNK_BYTES, so no record is ever held whole; ``running_sha1``
    goes on from chunk to chunk. The last chunk has ``payload_bytes`` and ``payload_digest``; a
    revisit, which has no payload of its own, one empty chunk with those of the full payload.
    """
    schema = CHUNKS + (", data binary" if data else "")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                folder, name = archive.rsplit("/", 1)
                fs, path = open_folder(folder)
                with fs.open_input_stream(f"{path}/{name}") as stream:
                    reader, rows, size = RecordReader(stream), [], 0
                    while (fields := reader.fields()) is not None:
                        for row in record_chunks(reader, fields, data):
                            rows.append(row)
                            size += row["chunk_bytes"] if data else 0
                            if len(rows) >= 2048 or size >= 4 * CHUNK_BYTES:
                                yield pa.RecordBatch.from_pylist(rows, arrow)
                                rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, arrow)

    return manifest.select("archive").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every page as a WARC record below ``folder``; returns the manifest as a written table.

    Of the pages with equal payloads of at least LEAST_SHARED bytes, the one with the largest
    id is a response and the others revisit it; the rest are responses. Payloads are compared by
    SHA-1 and length. A null html is an empty payload, a null url an empty target; a page with
    a null id never stands for others but may revisit; rows that repeat a whole page, id
    included, are responses each. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        column(id_col).cast("bigint").alias("page_id"), column(url_col).cast("string").alias("url"), column(html_col).cast("string").alias("html"),
        F.octet_length(F.coalesce(column(html_col).cast("string"), F.lit(""))).alias("size"), F.sha1(F.coalesce(column(html_col).cast("string"), F.lit(""))).alias("digest"),
    )
    shared = (
        rows.select("page_id", "size", "digest").filter(F.col("size") >= LEAST_SHARED).groupBy("digest", "size")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "size", "first_id")
    )
    # Written first: its size is then known, and pages are shuffled only if it is large.
    shared = written(shared, "shared")
    return written(write_archives(rows.join(shared, ["digest", "size"], "left").select("page_id", "url", "html", "size", "digest", "first_id"), folder), "manifest")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive the pages and read the archives back: one row per record."""
    manifest = archive_pages(pages, folder or scratch_dir(pages.sparkSession, "warc"))
    spread = manifest.repartition(max(1, manifest.count()))
    return read_archives(spread, data=False).filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
