"""Sources that read parts of files: what they give, and how little they read."""

import io
import tarfile

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from rasterloom.sources import ranged, readers, sinks


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    """Two shards; long names of both kinds, a folder, a link and an empty member among them."""
    folder = tmp_path_factory.mktemp("shards")
    for shard, form in (("a", tarfile.GNU_FORMAT), ("b", tarfile.PAX_FORMAT)):
        with tarfile.open(folder / f"{shard}.tar", "w", format=form) as tar:
            folders = tarfile.TarInfo("d/")
            folders.type = tarfile.DIRTYPE
            tar.addfile(folders)
            link = tarfile.TarInfo("d/link.txt")
            link.type, link.linkname = tarfile.SYMTYPE, "000.json"
            tar.addfile(link)
            for k in range(30):
                for role, raw in (("json", b"{%d}" % k), ("0.png", bytes([k]) * (700 * k)), ("1.png", b"x" * 511)):
                    info = tarfile.TarInfo(("é" * 90 + "/" if k % 7 == 3 else "d/") + f"{k:03}.{role}")
                    info.size = len(raw)
                    tar.addfile(info, io.BytesIO(raw))
    return str(folder)


def of_tarfile(folder):
    out = []
    for shard in "ab":
        with tarfile.open(f"{folder}/{shard}.tar") as tar:
            out += [(shard, m.name, tar.extractfile(m).read()) for m in tar if m.isfile()]
    return sorted(out)


def test_tar_members(spark, shards):
    ranged.register(spark)
    read = spark.read.format("tar_members").option("partitionBytes", 20_000).load(shards)
    assert read.rdd.getNumPartitions() > 8
    got = sorted((r.shard.rsplit("/", 1)[1][0], r.name, bytes(r.content)) for r in read.collect())
    assert got == of_tarfile(shards)
    assert sorted((r.key, r.role, bytes(r.content)) for r in read.collect()) == sorted((r.key, r.role, bytes(r.content)) for r in readers.tar_members(spark, shards).collect())
    assert read.where("role = '0.png' and key in ('004', '010')").count() == 4


def test_tar_index(spark, shards):
    index = ranged.tar_index(spark, shards)
    got = ranged.members_of(index.where("role = '0.png'"), 20_000)
    assert sorted((r.name, bytes(r.content)) for r in got.collect()) == sorted((n, raw) for _, n, raw in of_tarfile(shards) if n.endswith(".0.png"))
    assert spark.read.format("tar_members").load(shards + "/none").count() == 0


def test_a_walk_reads_headers_only(shards):
    with ranged.Ranges(f"{shards}/a.tar") as read:
        members = list(ranged.walk("a", read))
        assert len(members) == 90 and read.taken < 512 * 150 < read.size / 3


def test_filters_take_members_away(shards):
    reader = ranged.TarReader(shards, 10_000)
    list(reader.pushFilters([EqualTo(("role",), "0.png"), In(("key",), ("004", "029"))]))
    parts = [m for g in reader.partitions() for m in g.parts]
    assert sorted({m.key for m in parts}) == ["004", "029"] and len(parts) == 4
    assert all(len(g.parts) == 1 or sum(m.size for m in g.parts) <= 10_000 for g in reader.partitions())


def test_a_plan_holds_no_members(shards):
    """A run is two places in a shard, however many members lie between them; headers that come before a member's own are in its run."""
    runs = ranged.TarReader(shards, 5_000).partitions()
    assert len(runs) > 20 and all(isinstance(r, ranged.Run) for r in runs)
    assert sorted((r.shard[-5], m.name) for r in runs for m in r.members()) == [(s, n) for s, n, _ in of_tarfile(shards)]


def test_shards_are_streamed_in_volumes(spark, tmp_path):
    rows = spark.range(400).selectExpr("id % 2 as shard", "inline(array(struct(concat('d/', id, '.0.txt') as name, repeat('x', cast(id as int)) as content), struct(concat('d/', id, '.json') as name, '{}' as content)))")
    told = sinks.write_tar(rows, f"{tmp_path}/v", 20_000).collect()
    assert len(told) > 10 and sum(r.members for r in told) == 800
    seen = {}
    for r in told:
        with tarfile.open(r.path) as tar:
            for m in tar:
                key = m.name.split(".")[0]
                assert seen.setdefault(key, r.path) == r.path and r.path.endswith(f"-{int(key[2:]) % 2}.tar")
                assert tar.extractfile(m).read() in (b"{}", b"x" * int(key[2:]))
    assert len(seen) == 400
    assert sorted(r.path.rsplit("/", 1)[1] for r in sinks.write_tar(rows, f"{tmp_path}/w").collect()) == ["0.tar", "1.tar"]


@pytest.fixture(scope="module")
def rasters(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("rasters"), np.random.default_rng(5)
    cube = rng.integers(0, 4000, (2, 100, 37)).astype(np.uint16)
    cube[0, 3, 4] = 9999
    (folder / "a.tif").write_bytes(sinks.tiff_bytes(cube, nodata=9999, overviews=2))
    (folder / "b.TIF").write_bytes(sinks.tiff_bytes(cube[:1].astype(np.float32), rows_per_strip=7))
    return str(folder), cube


def test_tiff_pixels(spark, rasters):
    folder, cube = rasters
    ranged.register(spark)
    read = spark.read.format("tiff_pixels").option("partitionBytes", 3_000).load(folder)
    assert read.rdd.getNumPartitions() > 6
    rows = lambda df: sorted((r.scene.rsplit("/", 1)[1], r.band, r.y, r.x, r.v) for r in df.collect())
    whole = rows(readers.raster_pixels(spark, folder))
    assert [(*r[:4], r[4] or -1) for r in rows(read)] == [(*r[:4], r[4] or -1) for r in whole]
    window = read.where("y >= 20 and y < 33 and x between 3 and 9 and band = 1")
    assert rows(window) == [("a.tif", 1, y, x, float(cube[1, y, x])) for y in range(20, 33) for x in range(3, 10)]
    second = spark.read.format("tiff_pixels").option("overview", 2).load(f"{folder}/a.tif")
    small = np.where(cube == 9999, np.nan, cube)[:, ::4, ::4]
    assert rows(second) == [("a.tif", b, y, x, float(small[b, y, x])) for b in range(2) for y in range(25) for x in range(10)]


def test_windows_read_their_strips_only(rasters, monkeypatch):
    folder, _ = rasters
    opened = []
    plain = ranged.Ranges

    class Counted(plain):
        def __init__(self, path):
            super().__init__(path)
            opened.append(self)

    monkeypatch.setattr(ranged, "Ranges", Counted)
    reader = ranged.TiffReader(f"{folder}/a.tif", 1 << 20, 0, None)
    list(reader.pushFilters([GreaterThanOrEqual(("y",), 32), LessThan(("y",), 48), EqualTo(("band",), 1)]))
    parts = [p for g in reader.partitions() for p in g.parts]
    assert [(p.band, p.y, p.h) for p in parts] == [(1, 32, 16)]
    headers = sum(r.taken for r in opened)
    opened.clear()
    assert sum(b.num_rows for g in reader.partitions() for b in reader.read(g)) == 16 * 37
    assert sum(r.taken for r in opened) <= 2 * headers + parts[0].size < opened[0].size / 3


def test_metadata_by_headers(spark, rasters, tmp_path):
    folder, _ = rasters
    (tmp_path / "broken.tif").write_bytes(b"broken")
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + bytes(8) + (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + b"\x08\x02")
    for place in (folder, str(tmp_path)):
        order = lambda df: sorted(map(tuple, df.collect()), key=lambda r: r[0])
        got, whole = order(ranged.raster_metadata(spark, place)), order(readers.raster_metadata(spark, place))
        assert [r[:-1] for r in got] == [r[:-1] for r in whole] and [bool(r[-1]) for r in got] == [bool(r[-1]) for r in whole]
