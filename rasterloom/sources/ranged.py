"""Sources that read parts of files: members of tar shards, strips and tiles of TIFF rasters.

Both are Python data sources.  Planning reads headers only (a tar shard's member headers, a
raster's tag directories); a partition is a group of neighbouring parts of about
``partition_bytes``, and a task reads just these byte ranges, so no task holds a file.  Filters on
shard, key and role, or on scene, band, y and x, take parts away before anything is read.  Files
are opened through ``pyarrow.fs`` (a local path or any URI that it knows).

    ranged.register(spark)
    spark.read.format("tar_members").load(folder).where("role = '0.png'")
    spark.read.format("tiff_pixels").option("overview", 1).load(folder).where("band = 0 and y >= 512 and y < 1024")

``spark.sql.python.filterPushdown.enabled`` lets Spark hand filters on; ``register`` sets it.

For very many shards ``tar_index`` walks the headers as a job, a task a shard, and
``members_of`` reads the members that an index (filtered as one likes) names.
"""

from __future__ import annotations

import tarfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..operators.checkpoints import importable
from .readers import META, Tiff, metadata

#: Compressed bytes of one partition, unless the reader is told otherwise.
PARTITION_BYTES = 64 << 20


# ---- files by ranges -------------------------------------------------------------------------


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_below(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files with these suffixes below a folder, by name."""
    system, place = filesystem(path)
    found = system.get_file_info(place)
    prefix = path[: len(path) - len(place)] if path.endswith(place) else ""
    if found.type == fs.FileType.File:
        return [(path, found.size)]
    if found.type == fs.FileType.NotFound:
        return []
    every = system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((prefix + f.path, f.size) for f in every if f.type == fs.FileType.File and f.path.lower().endswith(suffixes))


class Ranges:
    """A file's bytes by place and count; ``taken`` counts what was read."""

    def __init__(self, path: str):
        system, place = filesystem(path)
        self.file, self.taken = system.open_input_file(place), 0
        self.size = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        raw = self.file.read_at(n, at)
        self.taken += len(raw)
        return raw

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


# ---- tar shards ------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    """A file in a shard: its full name, and where its bytes lie."""

    shard: str
    name: str
    at: int
    size: int

    @property
    def key(self) -> str:
        return self.name.rpartition("/")[2].partition(".")[0]

    @property
    def role(self) -> str:
        return self.name.rpartition("/")[2].partition(".")[2]


def _records(raw: bytes) -> dict[str, str]:
    """The keywords of an extended header: lines of length, keyword and value."""
    out, at = {}, 0
    while at < len(raw) and (space := raw.find(b" ", at)) > 0:
        size = int(raw[at:space])
        keyword, _, value = raw[space + 1 : at + size - 1].partition(b"=")
        out[keyword.decode()] = value.decode("utf-8", "surrogateescape")
        at += size
    return out


def walk(shard: str, read: Callable[[int, int], bytes], at: int = 0, end: int | None = None) -> Iterator[Member]:
    """The regular members of a shard from its headers, from one at ``at`` on to ``end``; bodies are stepped over."""
    return (member for _, member in _walked(shard, read, at, end))


def _walked(shard: str, read: Callable[[int, int], bytes], at: int, end: int | None) -> Iterator[tuple[int, Member]]:
    """Each member with the place of its first header: extended ones come before its own."""
    longer, extra, first = None, {}, at
    while (end is None or at < end) and len(block := read(at, tarfile.BLOCKSIZE)) == tarfile.BLOCKSIZE and block != bytes(tarfile.BLOCKSIZE):
        head = tarfile.TarInfo.frombuf(block, "utf-8", "surrogateescape")
        size, body = int(extra.get("size", head.size)) if head.type not in (b"x", b"g", b"L", b"K") else head.size, at + tarfile.BLOCKSIZE
        if head.type == b"L":  # a long name for the next member
            longer = read(body, size).rstrip(b"\0").decode("utf-8", "surrogateescape")
        elif head.type == b"x":
            extra = _records(read(body, size))
        elif head.type not in (b"g", b"K"):
            if head.type in (tarfile.REGTYPE, tarfile.AREGTYPE, tarfile.CONTTYPE) and not head.name.endswith("/"):
                yield first, Member(shard, extra.get("path", longer or head.name), body, size)
            longer, extra = None, {}
            size = 0 if head.type in (b"1", b"2", b"3", b"4", b"5", b"6") else size
        at = body + -(-size // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
        if not extra and longer is None and head.type not in (b"g", b"K"):
            first = at


@dataclass
class Group(InputPartition):
    """Parts of files that one task reads."""

    parts: list


def grouped(parts: Iterator, size_of: Callable, most: int) -> Iterator[Group]:
    """Neighbouring parts of one file until they have ``most`` bytes; a larger part is a group by itself."""
    held, size, path = [], 0, None
    for part in parts:
        own, of = size_of(part)
        if held and (size + own > most or of != path):
            yield Group(held)
            held, size = [], 0
        held, size, path = [*held, part], size + own, of
    if held:
        yield Group(held)


_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", In: "in"}


def _conditions(filters: list[Filter]) -> list[tuple[str, str, object]]:
    """(column, operator, value) of the filters that parts can be judged by."""
    return [(f.attribute[0], _OPERATORS[type(f)], f.value) for f in filters if type(f) in _OPERATORS and len(f.attribute) == 1]


def _may_hold(conditions: list[tuple[str, str, object]], column: str, least: object, most: object) -> bool:
    """Whether some value from ``least`` to ``most`` fits all conditions on ``column``."""
    for name, op, value in conditions:
        if name != column or value is None:
            continue
        if op == "in":
            if not any(v is not None and least <= v <= most for v in value):
                return False
        elif op == "=" and not least <= value <= most or op == ">" and not most > value or op == ">=" and not most >= value or op == "<" and not least < value or op == "<=" and not least <= value:
            return False
    return True


class _Pruning(DataSourceReader):
    conditions: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Filters only take parts away; Spark still applies them to the rows."""
        self.conditions = _conditions(filters)
        return iter(filters)


@dataclass
class Run(InputPartition):
    """Neighbouring members of a shard that one task reads: where the first one's headers and the last one's end lie; the task walks between them."""

    shard: str
    at: int
    end: int
    conditions: list

    def members(self) -> Iterator[Member]:
        with Ranges(self.shard) as read:
            yield from _fitting(walk(self.shard, read, self.at, self.end), self.conditions)

    @property
    def parts(self) -> list[Member]:
        return list(self.members())


def _fitting(members: Iterator[Member], conditions: list) -> Iterator[Member]:
    return (m for m in members if all(_may_hold(conditions, c, v, v) for c, v in (("key", m.key), ("role", m.role), ("name", m.name))))


class TarReader(_Pruning):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[InputPartition]:
        """Runs of at most ``most`` bytes (a larger member alone); no list of members is held."""
        return list(self._runs()) or [Group([])]

    def _runs(self) -> Iterator[Run]:
        for path, _ in files_below(self.path, (".tar",)):
            if _may_hold(self.conditions, "shard", path, path):
                with Ranges(path) as read:
                    start, end, held = None, 0, 0
                    for first, m in _walked(path, read, 0, None):
                        if not any(True for _ in _fitting([m], self.conditions)):
                            continue
                        if start is not None and held + m.size > self.most:
                            yield Run(path, start, end, self.conditions)
                            start, held = None, 0
                        start, end, held = first if start is None else start, m.at + m.size, held + m.size
                    if start is not None:
                        yield Run(path, start, end, self.conditions)

    def read(self, partition: Run | Group) -> Iterator[pa.RecordBatch]:
        return _contents(partition.members() if isinstance(partition, Run) else partition.parts)


def _contents(members: Iterable[Member]) -> Iterator[pa.RecordBatch]:
    shard, read = None, None
    for m in members:
        if m.shard != shard:
            shard, read = m.shard, Ranges(m.shard)
        yield pa.RecordBatch.from_pydict({"shard": [m.shard], "key": [m.key], "role": [m.role], "name": [m.name], "content": pa.array([read(m.at, m.size)], pa.binary())})


class TarMembers(DataSource):
    """``shard, key, role, name, content``: a row per member; options ``path`` and ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "shard string, key string, role string, name string, content binary"

    def reader(self, schema: object) -> TarReader:
        return TarReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


_INDEX = "shard string, name string, key string, role string, at long, size long"


def tar_index(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, name, key, role, at, size`` of every member, the headers walked by a task a shard."""

    importable(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with Ranges(path) as read:
                    members = list(walk(path, read))
                yield pa.RecordBatch.from_pydict({
                    "shard": [path] * len(members), "name": [m.name for m in members], "key": [m.key for m in members], "role": [m.role for m in members],
                    "at": pa.array([m.at for m in members], pa.int64()), "size": pa.array([m.size for m in members], pa.int64()),
                })

    shards = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tar").load(folder).select("path")
    return shards.repartition("path").mapInArrow(look, _INDEX)


def members_of(index: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``shard, key, role, name, content`` of an index's members, dealt by runs of neighbouring bytes of a shard."""
    run = F.floor(F.sum("size").over(Window.partitionBy("shard").orderBy("at")) / partition_bytes)
    dealt = index.withColumn("run", run).repartition("shard", "run").sortWithinPartitions("shard", "at")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _contents([Member(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)])

    return dealt.select("shard", "name", "at", "size").mapInArrow(fetch, "shard string, key string, role string, name string, content binary")


# ---- TIFF windows ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """A strip or tile: its bytes, and the pixels that it holds."""

    scene: str
    image: int
    band: int
    y: int
    x: int
    h: int
    w: int
    at: int
    size: int


def images(read: Callable[[int, int], bytes]) -> list[Tiff]:
    """The file's images in the order of their directories: the full one, then its overviews (not masks)."""
    found, at = [], None
    while at != 0:
        tiff = Tiff(read, at)
        if not found or tiff.reduced and (tiff.bands, tiff.kind) == (found[0].bands, found[0].kind):
            found.append(tiff)
        at = tiff.next
    return found


def parts_of(scene: str, image: int, tiff: Tiff) -> Iterator[Part]:
    offsets, sizes = tiff.places()
    across, down = -(-tiff.w // tiff.part_w), -(-tiff.h // tiff.part_h)
    for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        band, place = divmod(i, across * down)
        y, x = place // across * tiff.part_h, place % across * tiff.part_w
        yield Part(scene, image, band if tiff.planar == 2 else -1, y, x, min(tiff.part_h, tiff.h - y), min(tiff.part_w, tiff.w - x), at, size)


class TiffReader(_Pruning):
    """``overview``: 0 is the full image, 1 its first overview; an image that has fewer gives its smallest."""

    def __init__(self, path: str, most: int, overview: int, nodata: float | None):
        self.path, self.most, self.overview, self.nodata = path, most, overview, nodata

    def partitions(self) -> list[Group]:
        return list(grouped(self._parts(), lambda p: (p.size, p.scene), self.most)) or [Group([])]

    def _parts(self) -> Iterator[Part]:
        for path, _ in files_below(self.path, (".tif", ".tiff")):
            if _may_hold(self.conditions, "scene", path, path):
                with Ranges(path) as read:
                    found = images(read)
                    chosen = min(self.overview, len(found) - 1)
                    yield from filter(self._wanted(found[chosen].bands), parts_of(path, chosen, found[chosen]))

    def _wanted(self, bands: int) -> Callable[[Part], bool]:
        def test(p: Part) -> bool:
            first, last = (0, bands - 1) if p.band < 0 else (p.band, p.band)
            return _may_hold(self.conditions, "y", p.y, p.y + p.h - 1) and _may_hold(self.conditions, "x", p.x, p.x + p.w - 1) and _may_hold(self.conditions, "band", first, last)

        return test

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        path, tiff = None, None
        for p in partition.parts:
            if p.scene != path:
                path, tiff = p.scene, images(Ranges(p.scene))[p.image]
            none = tiff.nodata if self.nodata is None else self.nodata
            cube = tiff.part(p.at, p.size, p.h)[: p.h, : p.w].transpose(2, 0, 1).astype(np.float64)
            cube[~np.isfinite(cube) if none is None else ~np.isfinite(cube) | (cube == none)] = np.nan
            for n, plane in enumerate(cube):
                band = n if p.band < 0 else p.band
                if not _may_hold(self.conditions, "band", band, band):
                    continue
                for y in range(0, p.h, 64):
                    rows = plane[y : y + 64]
                    ys, xs = np.indices(rows.shape)
                    yield pa.RecordBatch.from_pydict({"scene": [p.scene] * rows.size, "band": pa.array(np.full(rows.size, band, np.int32)), "y": pa.array(ys.ravel() + p.y + y), "x": pa.array(xs.ravel() + p.x), "v": pa.array(rows.ravel(), from_pandas=True)})


class TiffPixels(DataSource):
    """The pixel relation ``scene, band, y, x, v``; options ``path``, ``partitionBytes``, ``overview`` and ``nodata``."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return "scene string, band int, y long, x long, v double"

    def reader(self, schema: object) -> TiffReader:
        none = self.options.get("nodata")
        return TiffReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)), int(self.options.get("overview", 0)), None if none is None else float(none))


def raster_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """As ``readers.raster_metadata``, by reading headers only: no file passes through a task."""
    importable(spark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in META.split(", ")])
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                with Ranges(path) as read:
                    rows.append(metadata(path, read(0, 1 << 16), read))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.repartition("path").mapInArrow(look, META)


def register(spark: SparkSession) -> None:
    """Make both sources known to the session."""
    importable(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TarMembers)
    spark.dataSource.register(TiffPixels)
