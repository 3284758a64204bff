"""WARC archives: writing, normalising a monolithic gzip stream, reading by a sidecar index.

`write` makes archives whose whole file is one gzip member, as careless crawlers do: nothing in them can be read without
inflating all before it. `normalise` inflates each such stream once, from front to end, rewrites every record as a gzip
member of its own and writes a sidecar index of offsets beside the archive. `read` takes the index and inflates single
members.

A record's payload is a page's html in UTF-8 behind HTTP headers. Of pages with equal payloads (of `min_revisit` bytes
at least) that with the largest id is the response; the others are revisit records, which hold the HTTP headers only and
refer to it.

Scale: pages are written where they are scanned. Only digests that repeat are joined back, from a written table whose
size the planner knows, so it is broadcast below Spark's own threshold and shuffled above it. Archives roll over at
`ROLL_BYTES`; writers, normalisers and readers stream, one record in memory at a time. An archive is written under a
name of its attempt and then moved, so a lost executor's task can run again. Files go through pyarrow's file systems, to
a folder that all executors share.

Cases: null html is an empty payload; a null url has no WARC-Target-URI, and line ends in one are percent-encoded. A null
id takes part like any other row, but no revisit refers to it unless all ids of its group are null, in which case all are
responses. Rows that repeat the largest id are all responses. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean, shared_folder, shuffle_partitions, stored

ROLL_BYTES = 64 << 20
_READ = 1 << 20
_LEVEL = 3
_DATE = "1970-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in (fields | {"Content-Length": str(len(block))}).items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": _DATE}
    if url is not None:
        fields["WARC-Target-URI"] = url.replace("\r", "%0D").replace("\n", "%0A")
    fields["WARC-Payload-Digest"] = f"sha1:{digest_of(payload)}"
    if refers_to is not None:
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
    fields["Content-Type"] = "application/http; msgtype=response"
    return record_bytes(fields, _HTTP.format(len(payload)).encode() + (payload if refers_to is None else b""))


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of a record's head, names in lower case."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


#: Tasks for each shuffle partition, at most, that rewrite archives; beyond, a task has several.
_ARCHIVES = 16


class _Whole:
    """A file that appears under its name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out, self.at = self.fs.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def discard(self) -> None:
        """After a failure: what is written so far goes."""
        try:
            self.out.close()
            self.fs.delete_file(self.own)
        except OSError:
            pass

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.own, self.path)
        except OSError:  # a store whose moves don't replace
            self.fs.delete_file(self.path)
            self.fs.move(self.own, self.path)


def inflated(uri: str) -> Iterator[bytes]:
    """The content of a gzip file of one member or more, in pieces; a stream that breaks off is an error."""
    fs, path = pafs.FileSystem.from_uri(uri)
    member, started = zlib.decompressobj(31), False
    with fs.open_input_stream(path, compression=None) as f:
        while piece := f.read(_READ):
            while piece:
                yield member.decompress(piece)
                piece = member.unused_data if member.eof else b""
                if member.eof:
                    member = zlib.decompressobj(31)
                    started = bool(piece)
                else:
                    started = True
    if started:
        raise EOFError(f"{uri} breaks off inside a gzip member")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole bytes) of each record of an inflated stream."""
    buffer, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        del buffer[:at]
        at = 0
        for piece in pieces:
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    raise EOFError("the last record's head breaks off")
                return
        fields = parse_head(bytes(buffer[at:end]))
        size = end + 4 - at + int(fields["content-length"]) + 4
        while len(buffer) - at < size:
            if not more():
                raise EOFError("the last record's block breaks off")
        yield fields, bytes(buffer[at : at + size])
        at += size


def write(pages: DataFrame, folder: str, *, min_revisit: int = 0) -> DataFrame:
    """Writes archives of one gzip member each; a written table of their (path, records)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    groups = rows.where(F.octet_length("html") >= min_revisit).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1 and last is not null")
    same = stored(groups.select(F.col("sha").alias("of"), "last"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("html") >= min_revisit), F.col("last"))
    ready = rows.join(same, F.col("sha") == F.col("of"), "left").select("page_id", "url", "html", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, out, count, raw, member = TaskContext.get().partitionId(), 0, None, 0, 0, None
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out
            out.write(member.flush())
            out.close()
            done.append((f"{folder}/raw/part-{part:06d}-{number:04d}.warc.gz", count))
            out = None

        try:
            for batch in batches:
                for page_id, url, html, refers_to in zip(*(batch.column(k) for k in range(4))):
                    if out is None:
                        out, member, count, raw = _Whole(f"{folder}/raw/part-{part:06d}-{number:04d}.warc.gz"), zlib.compressobj(_LEVEL, wbits=31), 0, 0
                        out.write(member.compress(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:archive:{part}-{number}>", "WARC-Date": _DATE}, b"")))
                    record = page_record(page_id.as_py(), url.as_py(), html.as_py().encode(), refers_to.as_py())
                    out.write(member.compress(record))
                    count, raw = count + 1, raw + len(record)
                    if raw >= ROLL_BYTES:
                        close()
                        number += 1
            if out is not None:
                close()
        except BaseException:
            if out is not None:
                out.discard()
            raise
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return stored(ready.mapInArrow(lean(run), "path string, records long"))


def _normalised(path: str) -> tuple[str, int]:
    """Rewrites one archive; the new path and the number of its records."""
    new = path.replace("/raw/", "/members/")
    archive, index, count = _Whole(new), _Whole(f"{new}.idx"), 0
    try:
        for fields, whole in records(inflated(path)):
            at, member = archive.at, zlib.compressobj(_LEVEL, wbits=31)
            archive.write(member.compress(whole) + member.flush())
            index.write(f"{fields['warc-record-id']} {fields['warc-type']} {at} {archive.at - at}\n".encode())
            count += 1
    except BaseException:
        archive.discard()
        index.discard()
        raise
    archive.close()
    index.close()
    return new, count


def normalise(archives: DataFrame) -> DataFrame:
    """From (path, ...) of whole-file gzip archives: (path, records) of the rewritten ones, each with its index at path.idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                new, count = _normalised(path)
                yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([count], pa.int64())], ["path", "records"])

    many = max(1, min(archives.count(), _ARCHIVES * shuffle_partitions(archives.sparkSession)))
    return archives.select("path").repartitionByRange(many, "path").mapInArrow(lean(run), "path string, records long")


def index_of(uri: str) -> Iterator[tuple[str, str, int, int]]:
    """record id, type, offset and length of each record."""
    fs, path = pafs.FileSystem.from_uri(f"{uri}.idx")
    with fs.open_input_stream(path, compression=None) as f:
        for line in f.read().decode().splitlines():
            name, kind, at, length = line.rsplit(" ", 3)
            yield name, kind, int(at), int(length)


def _id(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


_READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, archive string, offset long"


def read(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Rows of the page records in normalised archives, by their indexes; each response is checked against its digest."""
    names = [x.split()[0] for x in _READ_SCHEMA.split(", ")]

    def row(path: str, at: int, whole: bytes) -> tuple:
        head, _, rest = whole.partition(b"\r\n\r\n")
        fields = parse_head(head)
        http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
        size = int(http.rpartition(b"Content-Length: ")[2])
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
            raise ValueError(f"{path} at {at}: the payload doesn't fit its digest")
        refers = _id(fields["warc-refers-to"]) if kind == "revisit" else None
        return _id(fields["warc-record-id"]), size, digest, kind, refers, fields.get("warc-target-uri"), payload if payloads and kind == "response" else None, path, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, local = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                held = 0
                with fs.open_input_file(local) as f:
                    for _, kind, at, length in index_of(path):
                        if kind != "warcinfo":
                            f.seek(at)
                            rows.append(row(path, at, zlib.decompress(f.read(length), 31)))
                            held += length
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return archives.select("path").mapInArrow(lean(run), _READ_SCHEMA)


def round_trip(pages: DataFrame, *, min_revisit: int = 0, folder: str | None = None) -> DataFrame:
    """Pages written, normalised and read back."""
    folder = folder or shared_folder(pages.sparkSession)
    return read(normalise(write(pages, folder, min_revisit=min_revisit)), payloads=False)
