"""Exports: JSON lines, GeoJSON, traces, Markdown, stand-alone HTML, tar shards and TIFFs, as columns and writers."""

from __future__ import annotations

import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.checkpoints import importable
from .ranged import filesystem


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A folder of JSON line files, one a partition; text isn't escaped."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def geojson(rows: DataFrame, ring: Column, properties: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One FeatureCollection per group, as text; a null ring gives a null geometry."""
    geometry = F.when(ring.isNotNull(), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))
    packed = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.to_json(F.struct(*properties)).alias("k"), feature.alias("f")))).alias("all"))
    collection = F.struct(F.lit("FeatureCollection").alias("type"), F.transform("all", lambda x: x["f"]).alias("features"))
    return packed.select(*by, F.to_json(collection, {"ignoreNullFields": "false"}).alias("geojson"))


def html_table(pairs: Column) -> Column:
    """Two-column table of array<struct<key,value>>; both escaped."""
    rows = F.transform(pairs, lambda p: F.concat(F.lit("<tr><th>"), T.html_escape(p["key"]), F.lit("</th><td>"), T.html_escape(p["value"]), F.lit("</td></tr>")))
    return F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>"))


def html_report(title: Column, answer: Column, facts: Column, steps: Column, warnings: Column, geojson_text: Column, images: Column | None = None, stamp: Column | None = None) -> Column:
    """A page that needs nothing else: answer, facts, steps (array<string>), warnings, images (array of
    data addresses), the time it was made (UTC) and data."""
    items = lambda xs: F.concat(F.lit("<ul>"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("<li>"), T.html_escape(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    figures = F.lit("") if images is None else F.concat(F.lit("<h2>Images</h2>"), F.array_join(F.transform(images, lambda i: F.concat(F.lit("<figure><img src='"), i, F.lit("'></figure>"))), ""))
    made = F.lit("") if stamp is None else F.concat(F.lit("<p>"), F.date_format(stamp, "yyyy-MM-dd HH:mm"), F.lit(" UTC</p>"))
    return F.concat(
        F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), T.html_escape(title), F.lit("</title></head><body><h1>"), T.html_escape(title), F.lit("</h1><p>"), T.html_escape(answer), F.lit("</p>"), html_table(facts),
        F.lit("<h2>Steps</h2>"), items(steps), F.lit("<h2>Warnings</h2>"), items(F.array_distinct(warnings)), figures, made, F.lit("<pre>"), T.html_escape(geojson_text), F.lit("</pre></body></html>"),
    )


def markdown_table(rows: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One Markdown table per group, its rows in the order of their text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    return rows.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("markdown"))


def write_report(report: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report of few rows (one per build or task) as one JSON file, nulls kept."""
    report.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)


def _put(folder: str, name: str, raw: bytes) -> str:
    """Written under another name first: a task that is run again leaves whole files only."""
    system, place = filesystem(folder)
    system.create_dir(place, recursive=True)
    path, part = f"{place}/{name}", f"{place}/.{name}.{uuid.uuid4().hex[:8]}"
    with system.open_output_stream(part) as out:
        out.write(raw)
    system.move(part, path)
    return f"{folder}/{name}"


def write_tar(members: DataFrame, folder: str, volume_bytes: int | None = None) -> DataFrame:
    """``path, members`` of a tar shard for each ``shard`` of ``members(shard, name, content)``; a task streams to it, row by row.

    With ``volume_bytes`` a shard of more is dealt over volumes of about so many bytes (``00003-shard.tar``) by its samples'
    names, so that no task writes a whole shard; members of a sample stay together.
    """
    importable(members.sparkSession)
    rows = members.select(F.col("shard").cast("string").alias("shard"), F.lit(None).cast("long").alias("volume"), "name", F.col("content").cast("binary").alias("content"))
    if volume_bytes:
        counts = rows.groupBy("shard").agg(F.ceil(F.sum(F.coalesce(F.length("content"), F.lit(0)) + 2 * tarfile.BLOCKSIZE) / volume_bytes).alias("volumes"))
        sample = F.regexp_extract("name", r"^(?:.*/)?[^./]*", 0)
        rows = rows.join(F.broadcast(counts), "shard").select("shard", F.pmod(F.xxhash64(sample), "volumes").alias("volume"), "name", "content")  # a row per shard

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            shards, volumes, names, contents = batch.columns
            for n in range(batch.num_rows):
                to = shards[n].as_py(), volumes[n].as_py()
                if held is None or held.to != to:
                    if held is not None:
                        yield held.done()
                    held = _Shard(folder, to)
                held.add(names[n].as_py(), contents[n].as_py() or b"")
        if held is not None:
            yield held.done()

    return rows.repartition("shard", "volume").sortWithinPartitions("shard", "volume", "name").mapInArrow(pack, "path string, members long")


class _Shard:
    """A tar file that grows by members; it has its name once it is whole."""

    def __init__(self, folder: str, to: tuple[str, int | None]):
        self.to, self.folder, self.count = to, folder, 0
        shard, volume = to
        self.name = f"{shard}.tar" if volume is None else f"{volume:05}-{shard}.tar"
        self.system, self.place = filesystem(folder)
        self.system.create_dir(self.place, recursive=True)
        self.part = f"{self.place}/.{self.name}.{uuid.uuid4().hex[:8]}"
        self.out = self.system.open_output_stream(self.part)
        self.tar = tarfile.open(fileobj=self.out, mode="w|")

    def add(self, name: str, raw: bytes) -> None:
        info = tarfile.TarInfo(name)
        info.size = len(raw)
        self.tar.addfile(info, io.BytesIO(raw))
        self.tar.members.clear()  # kept for listings, a record a member
        self.count += 1

    def done(self) -> pa.RecordBatch:
        self.tar.close()
        self.out.close()
        self.system.move(self.part, f"{self.place}/{self.name}")
        return pa.RecordBatch.from_pydict({"path": [f"{self.folder}/{self.name}"], "members": pa.array([self.count], pa.int64())})


def tiff_bytes(cube: np.ndarray, *, rows_per_strip: int = 16, nodata: float | None = None, overviews: int = 0) -> bytes:
    """(bands, h, w) as a deflated TIFF of strips, a band after the other, with overviews of every second row and column."""
    kind = {"u": 1, "i": 2, "f": 3}[cube.dtype.kind]
    out, last = bytearray(b"II*\0\0\0\0\0"), 4
    for level in range(overviews + 1):
        planes = cube[:, :: 1 << level, :: 1 << level].astype(cube.dtype.newbyteorder("<"))
        strips = [zlib.compress(np.ascontiguousarray(p[y : y + rows_per_strip]).tobytes()) for p in planes for y in range(0, p.shape[0], rows_per_strip)]
        offsets = []
        for raw in strips:
            offsets.append(len(out))
            out += raw
        tags = [(254, "I", [int(level > 0)]), (256, "I", [planes.shape[2]]), (257, "I", [planes.shape[1]]), (258, "H", [8 * cube.dtype.itemsize] * len(cube)), (259, "H", [8]), (262, "H", [1]),
            (273, "I", offsets), (277, "H", [len(cube)]), (278, "I", [rows_per_strip]), (279, "I", [len(s) for s in strips]), (284, "H", [2]), (339, "H", [kind] * len(cube))]
        tags += [] if nodata is None else [(42113, "s", list(f"{nodata:g}\0".encode()))]
        rows = b""
        for tag, code, values in tags:
            raw = bytes(values) if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
            if len(raw) > 4:
                place, raw = len(out), raw + b"\0" * (len(raw) % 2)
                out += raw
                raw = struct.pack("<I", place)
            rows += struct.pack("<HHI", tag, {"H": 3, "I": 4, "s": 2}[code], len(values)) + raw.ljust(4, b"\0")
        struct.pack_into("<I", out, last, len(out))
        last = len(out) + 2 + len(rows)
        out += struct.pack("<H", len(tags)) + rows + bytes(4)
    return bytes(out)


def write_tiffs(pixels: DataFrame, folder: str, *, kind: str = "f4", rows_per_strip: int = 16, nodata: float | None = None, overviews: int = 0) -> DataFrame:
    """``path, rows`` of a TIFF for each ``scene`` of ``scanlines(scene, band, y, values)``; a scene is what a task writes."""

    def draw(group: pa.Table) -> pa.Table:
        band, y = group.column("band").to_numpy(), group.column("y").to_numpy()
        values = np.stack(group.column("values").to_numpy())
        cube = np.full((band.max() + 1, y.max() + 1, values.shape[1]), 0 if nodata is None else nodata, np.dtype(kind))
        cube[band, y] = values
        scene = group.column("scene")[0].as_py()
        path = _put(folder, f"{scene}.tif", tiff_bytes(cube, rows_per_strip=rows_per_strip, nodata=nodata, overviews=overviews))
        return pa.table({"path": [path], "rows": pa.array([group.num_rows], pa.int64())})

    rows = pixels.select(F.col("scene").cast("string").alias("scene"), F.col("band").cast("int").alias("band"), F.col("y").cast("long").alias("y"), "values")
    return rows.groupBy("scene").applyInArrow(draw, "path string, rows long")
