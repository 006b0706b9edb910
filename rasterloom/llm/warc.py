"""WARC archives: written as one gzip stream, normalised to a member a record, read back.

``write`` makes one archive per task, a single gzip stream (the monolithic form that
record readers can't seek in).  ``normalise`` inflates each such stream once, piece by
piece, rewrites every record as a gzip member of its own, and writes a sidecar index of
``record_id  offset  length`` lines beside it.  ``read`` opens members by their offsets.

Files go to the folder that all executors share, each under a name of its own attempt;
the paths come back as rows of a written manifest, so a retried or lost task leaves at
most an unlisted file, and later steps read listed files only.  Any store that pyarrow
can open serves.  Memory: one record, one read buffer and ``_INDEX_ROWS`` rows of the index.

Which records are revisits is decided before writing, by digest: ids and digests are
all that is shuffled, and equal digests are combined before the shuffle.  Of equal
payloads of at least ``min_revisit_bytes`` bytes, the largest id is the response.

Null html is an empty payload; empty payloads follow the same rule.  Very long payloads are
a record like any other.  A repeated id with equal payload is a response in each of its rows
if the id is the largest.  Null ids are written with an empty id and read back as null; they
revisit like others, and a group of only null ids is all response.  An empty table gives no
archive and no record.  Other columns may have any name; they are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, hot_among, prepare, spread_join, staged

_READ = 1 << 20
_INDEX_ROWS = 8192
_MANIFEST = "path string, records long, bytes long"
_INDEX = "path string, record_id string, offset long, length long"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, digest: str) -> bytes:
    """One record: a revisit carries the digest and what it refers to, not the payload."""
    body = payload if kind == "response" else b""
    target = (url or "").replace("\r", "").replace("\n", "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


class RecordReader:
    """Cuts a stream of inflated bytes into records."""

    def __init__(self):
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        at = 0
        while (end := self.buffer.find(b"\r\n\r\n", at)) >= 0:
            stop = end + 4 + int(headers(bytes(self.buffer[at : end + 4]))["content-length"]) + 4
            if stop > len(self.buffer):
                break
            yield bytes(self.buffer[at:stop])
            at = stop
        del self.buffer[:at]


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def _latest(rows: DataFrame, min_revisit_bytes: int) -> DataFrame:
    """sha, latest, count: of payloads that several records share, the largest page id."""
    marks = rows.select("page_id", F.sha1("payload").alias("sha"), F.length("payload").alias("size")).where(F.col("size") >= min_revisit_bytes)
    found = marks.groupBy("sha").agg(F.max("page_id").alias("latest"), F.count("*").alias("count")).where("count > 1 and latest is not null")
    return staged(found, "digests")


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, level: int = 1, broadcast_rows: int = 200_000) -> DataFrame:
    """Manifest of the monolithic archives, one a task.

    Rows learn from the digest of their payload which record theirs repeats.  Up to ``broadcast_rows``
    digests that repeat (60 bytes each) go to the rows, so that payloads stay where they are; beyond
    that rows and digests are joined, digests that many rows share being spread.
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = fresh_path(spark, "warc")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    latest = _latest(rows, min_revisit_bytes)
    shared = rows.withColumn("own_sha", F.sha1("payload"))
    if latest.count() <= broadcast_rows:
        joined = shared.join(F.broadcast(latest.drop("count")), F.col("own_sha") == F.col("sha"), "left")
    else:
        joined = spread_join(shared.withColumn("row", F.monotonically_increasing_id()), latest.drop("count"), "own_sha", "sha", "row", hot=hot_among(latest, "sha"), how="left")
    refers = F.when((F.length("payload") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest"))
    marked = joined.select("page_id", "url", "payload", refers.alias("refers_to"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open_fs(folder)
        fs.create_dir(root, recursive=True)
        name, count, size = f"raw-{uuid4().hex}.warc.gz", 0, 0
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for page_id, url, payload, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    kind = "response" if refers is None else "revisit"
                    size += out.write(packer.compress(record(page_id, url, payload, kind, refers, digest32(payload))))
                    count += 1
            size += out.write(packer.flush())
        yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [size]})

    return staged(marked.mapInArrow(archive, _MANIFEST).where("records > 0"), "manifest")


def _dealt(df: DataFrame, tasks: int) -> DataFrame:
    return df.repartition(max(1, tasks))


def normalise(manifest: DataFrame, *, level: int = 1) -> DataFrame:
    """Index of the normalised archives: path, record_id, offset, length of every record."""
    prepare(manifest.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from _rewrite(path, level)

    return staged(_dealt(manifest.select("path"), manifest.count()).mapInArrow(rewrite, _INDEX), "index")


def _rewrite(path: str, level: int) -> Iterator[pa.RecordBatch]:
    """The members and their index, written side by side; the index also comes back in batches."""
    fs, source = _open_fs(path)
    stem = f"{path.rsplit('/', 1)[0]}/members-{uuid4().hex}"
    target = f"{stem}.warc.gz"
    lines: list[tuple[str, int, int]] = []
    at = 0
    reader = RecordReader()

    def batch() -> pa.RecordBatch:
        ids, offsets, lengths = zip(*lines, strict=True) if lines else ((), (), ())
        side.write("".join(f"{i}\t{o}\t{n}\n" for i, o, n in lines).encode())
        lines.clear()
        return pa.RecordBatch.from_pydict({"path": pa.array([target] * len(ids), pa.string()), "record_id": pa.array(ids, pa.string()), "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64())})

    out_path, side_path = _open_fs(target)[1], _open_fs(f"{stem}.idx")[1]
    with fs.open_input_stream(source, compression=None) as raw, fs.open_output_stream(out_path, compression=None) as out, fs.open_output_stream(side_path, compression=None) as side:
        for data in _inflated(raw):
            for item in reader.feed(data):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(item) + packer.flush()
                out.write(member)
                lines.append((headers(item[: item.index(b"\r\n\r\n") + 2])["warc-record-id"], at, len(member)))
                at += len(member)
                if len(lines) == _INDEX_ROWS:
                    yield batch()
        yield batch()
    if reader.buffer:
        raise ValueError(f"{path} ends inside a record")


def _inflated(raw: pa.NativeFile) -> Iterator[bytes]:
    """Bounded pieces, even of a stream that inflates a thousandfold; further members follow on."""
    unpacker = zlib.decompressobj(31)
    while data := raw.read(_READ):
        while data:
            yield unpacker.decompress(data, 4 * _READ)
            data = unpacker.unconsumed_tail
            if unpacker.eof:
                data, unpacker = unpacker.unused_data, zlib.decompressobj(31)
    yield unpacker.flush()


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _page(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read(index: DataFrame, *, payloads: bool = True) -> DataFrame:
    """A row per record, from its own member; ``payloads`` false leaves the bytes out."""
    prepare(index.sparkSession)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if path not in opened:
                    for other in opened.values():
                        other.close()
                    fs, place = _open_fs(path)
                    opened = {path: fs.open_input_file(place)}
                rows.append(_record(zlib.decompress(opened[path].read_at(length, offset), 31), payloads))
                if len(rows) == 256:
                    yield pa.RecordBatch.from_pylist(rows, schema=_record_schema())
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_record_schema())

    return index.select("path", "offset", "length").mapInArrow(load, _RECORDS)


def _record_schema() -> pa.Schema:
    return pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def _record(raw: bytes, payloads: bool) -> dict:
    cut = raw.index(b"\r\n\r\n") + 4
    head = headers(raw[:cut])
    body = raw[cut : cut + int(head["content-length"])]
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and digest32(body) != digest:
        raise ValueError(f"record {head['warc-record-id']} doesn't match its digest")
    return {
        "page_id": _page(head["warc-record-id"]),
        "payload_bytes": int(head["x-payload-length"]),
        "payload_digest": digest,
        "record_type": head["warc-type"],
        "refers_to": _page(head.get("warc-refers-to")),
        "url": head["warc-target-uri"],
        "payload": body if payloads else None,
    }


def remove(manifest: DataFrame) -> None:
    """Delete the monolithic archives once their index is written."""
    for row in manifest.select("path").toLocalIterator():
        fs, place = _open_fs(row.path)
        if fs.get_file_info(place).type != pafs.FileType.NotFound:
            fs.delete_file(place)
