"""Readers: JSON lines, wrapped JSON, image listings, tar members, TIFF rasters and images."""

from __future__ import annotations

import io
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

#: Keys that may hold the records of a wrapped file, in order; and image suffixes.  Fixed values.
WRAPPERS = ("data", "annotations", "records", "questions", "items")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, limit: int = 0, order: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines with blank lines skipped; a missing file is an empty table.  A limit takes the first rows in ``order``."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).json(path)
    return (rows.orderBy(*order) if order else rows).limit(limit) if limit > 0 else rows


def read_records(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """``record`` variants of files that hold a list, JSON lines, or an object that wraps a list.

    The list is under ``key``, else under the first known name, else the only list there is;
    a file with none of these fails the read.  A file is one row until it is taken apart, as
    a JSON document has no places to split at; JSON lines should come by ``read_jsonl``.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"), "value")
    lines = F.transform(F.filter(F.split("value", "\n"), lambda s: T.strip(s) != ""), lambda s: F.try_parse_json(s))
    as_list = lambda v: F.try_variant_get(v, "$", "array<variant>")
    members = F.try_variant_get("doc", "$", "map<string,variant>")
    lists = F.filter(F.map_values(F.map_filter(members, lambda k, v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY")))), lambda v: v.isNotNull())
    named = F.coalesce(*[F.try_variant_get("doc", f"$.{k}", "array<variant>") for k in ((key,) if key else WRAPPERS)])
    # Several lines that are values each are JSON lines: a parser of the whole would stop after the first.
    by_line = F.when(F.forall(lines, lambda r: r.isNotNull()), lines)
    found = F.coalesce(F.when(F.size(lines) > 1, by_line), as_list(F.col("doc")), named, F.when(F.size(lists) == 1, as_list(lists[0])))
    checked = F.when(found.isNull(), F.raise_error(F.lit("no list of records in the file"))).otherwise(found)
    return whole.select(F.explode(checked).alias("record"))


def describe(records: DataFrame, column: str = "record") -> DataFrame:
    """Field names and types that occur, with counts."""
    fields = F.try_variant_get(column, "$", "map<string,variant>")
    return records.select(F.explode(fields).alias("field", "v")).groupBy("field", F.schema_of_variant("v").alias("type")).agg(F.count("*").alias("n"))


def list_files(spark: SparkSession, folder: str, contains: tuple[str, ...] = (), suffixes: tuple[str, ...] = IMAGE_SUFFIXES) -> DataFrame:
    """path, length, name, stem of files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes + tuple(s.upper() for s in suffixes)) + "}").load(folder)
    wanted = F.lit(True)
    for part in contains:
        wanted = wanted & F.contains(F.lower(T.basename(F.col("path"))), F.lit(part.lower()))
    return files.select("path", "length").where(wanted).select("path", "length", T.basename(F.col("path")).alias("name"), T.stem(F.col("path")).alias("stem"))


def first_match(files: DataFrame, parts: tuple[str, ...]) -> str | None:
    """The least path whose name holds all of ``parts``, whatever their case."""
    low, wanted = F.lower("name"), F.lit(True)
    for part in parts:
        wanted = wanted & F.contains(low, F.lit(part.lower()))
    return files.where(wanted).agg(F.min("path")).first()[0]


def image_index(files: DataFrame, by: str = "name") -> DataFrame:
    """One path per base name or stem: the least."""
    return files.groupBy(by).agg(F.min("path").alias("path"))


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files with their content address."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.concat(F.lit("."), F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", "content", T.upload_name(F.col("content"), suffix).alias("stored_as"))


def tar_members(spark: SparkSession, path: str) -> DataFrame:
    """shard, key, role, content: members grouped by the name before the first dot."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:  # a row at a time: only the shard itself is held
                        if member.isfile():
                            key, _, role = member.name.rpartition("/")[2].partition(".")
                            yield pa.RecordBatch.from_pydict({"shard": [shard], "key": [key], "role": [role], "content": pa.array([tar.extractfile(member).read()], pa.binary())})

    shards = spark.read.format("binaryFile").load(path).select("path", "content")
    return shards.mapInArrow(unpack, "shard string, key string, role string, content binary")


def change_samples(members: DataFrame) -> DataFrame:
    """key, first, second, annotation: members by role (``0.*``, ``1.*``, ``*json``); null where one is missing."""
    pick = lambda test: F.min_by(F.when(test, F.col("content")), F.when(test, F.col("role")))
    role = F.col("role")
    return members.groupBy("shard", "key").agg(pick(role.startswith("0.")).alias("first"), pick(role.startswith("1.")).alias("second"), pick(role.endswith("json")).cast("string").alias("annotation"))


# ---- rasters ---------------------------------------------------------------------------------

META = "path string, driver string, w int, h int, bands int, dtype string, crs string, x0 double, y0 double, x1 double, y1 double, rx double, ry double, nodata double, error string"
#: (sample format, bits) to number type; 5 and 6 are complex.
_KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8", (5, 32): "i2", (6, 64): "c8", (6, 128): "c16"}
_TAG_KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, widened one code early."""
    out, table, width, bits, have, before = bytearray(), [], 9, 0, 0, None
    for byte in data:
        bits, have = bits << 8 | byte, have + 8
        while have >= width:
            have -= width
            code, bits = bits >> have, bits & (1 << have) - 1
            if code == 256:
                table, width, before = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if code == 257:
                return bytes(out)
            if before is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else before + before[:1]
                table.append(before + entry[:1])
            out += entry
            before = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: runs and literals."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


_UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


class Tiff:
    """Strips or tiles, classic or big, plain, LZW, deflated or PackBits, with predictors; one sample
    type, chunky or planar; north-up geo keys.  So also cloud-optimised files, whose first image is the full one."""

    def __init__(self, raw: bytes | Callable[[int, int], bytes], directory: int | None = None):
        """``raw``: the file's bytes, or a function that reads (place, count); ``directory``: of the image, else the first."""
        self.read = raw if callable(raw) else lambda at, n: raw[at : at + n]
        head = self.read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}[head[:2]]
        magic = struct.unpack(self.order + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        at = directory or struct.unpack_from(self.order + ("Q" if self.big else "I"), head, 8 if self.big else 4)[0]
        (count, ahead), step = (self._number(at, "Q"), 20) if self.big else (self._number(at, "H"), 12)
        rows = self.read(at + ahead, count * step + 8)
        self.next = struct.unpack_from(self.order + ("Q" if self.big else "I"), rows, count * step)[0] if len(rows) >= count * step + (8 if self.big else 4) else 0
        self.tags = dict(self._tag(rows, step * i) for i in range(count))
        one = lambda t, d=None: (self.tags.get(t) or [d])[0]
        self.reduced = one(254, 0) == 1
        self.w, self.h, self.bands = one(256), one(257), one(277, 1)
        self.complex_ints = one(339, 1) == 5
        self.kind = _KINDS[(one(339, 1), one(258, 1))]
        self.compression, self.planar, self.predictor = one(259, 1), one(284, 1), one(317, 1)
        if self.compression not in _UNPACK or self.predictor not in (1, 2, 3):
            raise ValueError(f"compression {self.compression} or predictor {self.predictor} isn't supported")
        self.tiled = 324 in self.tags
        self.part_w, self.part_h = (one(322), one(323)) if self.tiled else (self.w, min(one(278, self.h), self.h))
        text = one(42113)
        self.nodata = float(text.rstrip(b"\0 ")) if text else None

    def _number(self, at: int, code: str) -> tuple[int, int]:
        size = struct.calcsize(code)
        return struct.unpack(self.order + code, self.read(at, size))[0], size

    def _tag(self, rows: bytes, at: int) -> tuple[int, list]:
        tag, kind, n = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), rows, at)
        code, size = _TAG_KINDS.get(kind, ("B", 1))
        inline, wide, place = (8, "Q", at + 12) if self.big else (4, "I", at + 8)
        raw = rows[place : place + n * size] if n * size <= inline else self.read(struct.unpack_from(self.order + wide, rows, place)[0], n * size)
        if code == "s":
            return tag, [raw[:n]]
        return tag, list(struct.unpack_from(f"{self.order}{n}{code}" if len(code) == 1 else self.order + code * n, raw))

    def geo(self) -> dict:
        scale, tie, keys = self.tags.get(33550), self.tags.get(33922), self.tags.get(34735, [])
        if not scale or not tie:
            return {}
        code = next((keys[i + 3] for i in range(4, len(keys), 4) if keys[i] in (3072, 2048)), None)
        x0, y1 = tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]
        return {"crs": f"EPSG:{code}" if code else None, "x0": x0, "y1": y1, "x1": x0 + self.w * scale[0], "y0": y1 - self.h * scale[1], "rx": scale[0], "ry": scale[1]}

    def places(self) -> tuple[list[int], list[int]]:
        """Where the strips or tiles lie, and their sizes."""
        return (self.tags[324], self.tags[325]) if self.tiled else (self.tags[273], self.tags[279])

    def part(self, at: int, size: int, rows: int) -> np.ndarray:
        """(rows, width, samples) of one strip or tile of ``rows`` rows inside the image; complex samples as their amplitude."""
        found = self._part(at, size, self.part_h if self.tiled else rows, 1 if self.planar == 2 else self.bands)
        if self.complex_ints:
            found = found[..., ::2].astype(np.float64) + 1j * found[..., 1::2]
        return np.abs(found) if np.iscomplexobj(found) else found

    def _part(self, at: int, size: int, rows: int, samples: int) -> np.ndarray:
        """(rows, width, values) as they are stored."""
        data = _UNPACK[self.compression](self.read(at, size))
        kind = np.dtype(self.kind).newbyteorder(self.order)
        values_per = samples * (2 if self.complex_ints else 1)
        n = rows * self.part_w * values_per
        if self.predictor == 3:  # bytes of the numbers, most significant first, as differences along a row
            width = kind.itemsize
            planes = np.frombuffer(data, np.uint8, n * width).reshape(rows, -1).copy()
            for s in range(values_per):
                planes[:, s::values_per] = np.cumsum(planes[:, s::values_per], axis=1, dtype=np.uint8)
            whole = planes.reshape(rows, width, -1).transpose(0, 2, 1)
            return np.ascontiguousarray(whole).view(np.dtype(self.kind).newbyteorder(">")).reshape(rows, self.part_w, values_per)
        values = np.frombuffer(data, kind, n).reshape(rows, self.part_w, values_per)
        return np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")) if self.predictor == 2 else values

    def pixels(self) -> np.ndarray:
        """(bands, h, w); complex samples as their amplitude."""
        offsets, sizes = self.places()
        across, down = -(-self.w // self.part_w), -(-self.h // self.part_h)
        out = None
        for i, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
            band, place = divmod(i, across * down)
            y, x = place // across * self.part_h, place % across * self.part_w
            part = self.part(at, size, min(self.part_h, self.h - y))
            if out is None:
                out = np.zeros((self.bands, self.h, self.w), part.dtype.newbyteorder("="))
            inside = part[: self.h - y, : self.w - x].transpose(2, 0, 1)
            out[band : band + 1 if self.planar == 2 else None, y : y + inside.shape[1], x : x + inside.shape[2]] = inside
        return out


def _image_size(raw: bytes) -> dict | None:
    """Driver, size and bands of a PNG, GIF, BMP or JPEG file, from its header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n":
        w, h = struct.unpack(">II", raw[16:24])
        return {"driver": "PNG", "w": w, "h": h, "bands": {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[raw[25]], "dtype": "u1" if raw[24] <= 8 else "u2"}
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        w, h = struct.unpack("<HH", raw[6:10])
        return {"driver": "GIF", "w": w, "h": h, "bands": 1, "dtype": "u1"}
    if raw[:2] == b"BM":
        w, h, _, bits = struct.unpack("<iiHH", raw[18:30])
        return {"driver": "BMP", "w": w, "h": abs(h), "bands": {24: 3, 32: 4}.get(bits, 1), "dtype": "u1"}
    if raw[:3] == b"\xff\xd8\xff":
        at = 2
        while raw[at] == 0xFF and at + 9 < len(raw):
            if raw[at + 1] in (0xC0, 0xC1, 0xC2, 0xC3):  # a frame's header
                h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
                return {"driver": "JPEG", "w": w, "h": h, "bands": raw[at + 9], "dtype": "u1"}
            at += 2 + struct.unpack(">H", raw[at + 2 : at + 4])[0]
        raise ValueError("a JPEG without a frame")
    return None


def metadata(path: str, raw: bytes, read: Callable[[int, int], bytes] | None = None) -> dict:
    """The row of a file from its bytes, or from its first ones and a function that reads others."""
    row = dict.fromkeys(c.split()[0] for c in META.split(", "))
    row["path"] = path
    try:
        if image := _image_size(raw):
            return row | image
        tiff = Tiff(read or raw)
        return row | {"driver": "GTiff", "w": tiff.w, "h": tiff.h, "bands": tiff.bands, "dtype": tiff.kind, "nodata": tiff.nodata} | tiff.geo()
    except Exception as error:  # noqa: BLE001  a broken file is a row with its error, never a failed job
        return row | {"error": f"{type(error).__name__}: {error}"}


def raster_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A row per file, never an exception: unreadable ones carry ``error``."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in META.split(", ")])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([metadata(p, c) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(look, META)


_PIXELS = "scene string, band int, y long, x long, v double"


def _pixel_rows(scene: str, band: int, plane: np.ndarray) -> Iterator[pa.RecordBatch]:
    for y in range(0, len(plane), 64):
        part = plane[y : y + 64]
        ys, xs = np.indices(part.shape)
        yield pa.RecordBatch.from_pydict({"scene": pa.array([scene] * part.size), "band": pa.array(np.full(part.size, band, np.int32)), "y": pa.array(ys.ravel() + y), "x": pa.array(xs.ravel()), "v": pa.array(part.ravel(), from_pandas=True)})


def raster_pixels(spark: SparkSession, path: str, bands: tuple[int, ...] = (), nodata: float | None = None, every_band: bool = False) -> DataFrame:
    """The pixel relation of TIFF files; only ``bands`` (from 0) if given; no-data and non-finite values are null.

    No-data is the file's own value unless one is given; with ``every_band`` a pixel is null in all
    bands if it is in one.  Some rows of pixels at a time leave the worker, so one file is all that
    a task holds.
    """

    def burst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scene, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tiff = Tiff(content)
                cube, none = tiff.pixels().astype(np.float64), tiff.nodata if nodata is None else nodata
                gone = ~np.isfinite(cube) if none is None else ~np.isfinite(cube) | (cube == none)
                cube[np.broadcast_to(gone.any(axis=0), cube.shape) if every_band else gone] = np.nan
                for band in bands or range(len(cube)):
                    yield from _pixel_rows(scene, band, cube[band])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(burst, _PIXELS)


def image_pixels(spark: SparkSession, path: str) -> DataFrame:
    """The pixel relation of PNG, JPEG, GIF and BMP files, decoded in the JVM; bands are red, green, blue (and alpha)."""

    def burst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for scene, h, w, n, data in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                cube = np.frombuffer(data, np.uint8).reshape(h, w, n).transpose(2, 0, 1).astype(np.float64)
                for band, plane in enumerate(cube if n == 1 else [*cube[2::-1], *cube[3:]]):  # stored blue first
                    yield from _pixel_rows(scene, band, plane)

    shown = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return shown.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(burst, _PIXELS)


def cached(requests: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Requests with a cached answer or null, and ``cache_hit``; ``cache(key, answer, confidence)``."""
    return requests.withColumn("_key", key).join(cache.withColumnRenamed("key", "_cached"), F.col("_key") == F.col("_cached"), "left").withColumn("cache_hit", F.col("_cached").isNotNull()).drop("_cached").withColumnRenamed("_key", "key")
