import json
import random
import tarfile
import io
import zlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import boxes as B
from rasterloom.functions import text as T
from rasterloom.operators import evaluation as E
from rasterloom.operators import records as R
from rasterloom.operators import imagery, kernels, router, scenes
from rasterloom.plans import datasets as D
from rasterloom.sources import readers, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_pairing_takes_the_latest_open_question(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "<image>\n b "), (1, 2, "assistant", "c"), (1, 3, "assistant", "d"), (1, 4, "system", "x"), (1, 5, "human", " "), (1, 6, "gpt", "e"), (2, 0, "user", "q"), (2, 1, "MODEL", "r")]
    got = R.pair_turns(spark.createDataFrame(turns, "id int, n int, role string, text string"), "id", "n", "role", "text").orderBy("id").collect()
    assert [(r.id, r.question_turn, r.answer_turn, r.question, r.answer) for r in got] == [(1, 1, 2, "b", "c"), (2, 0, 1, "q", "r")]


@pytest.mark.parametrize("fraction", [0.1, 0.25, 0.35, 0.5, 1.0])
def test_caps_equal_the_fixpoint(spark, fraction):
    rng = random.Random(int(fraction * 100))
    cases = [[rng.randint(1, rng.choice([3, 40, 900])) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    rows = [(s, str(i), n) for s, case in enumerate(cases) for i, n in enumerate(case)]
    got = {r.scope: r.cap for r in R.balanced_caps(spark.createDataFrame(rows, "scope int, answer string, n long"), fraction, ["scope"]).collect()}
    for s, case in enumerate(cases):
        want = max(c for c in range(1, max(case) + 1) if c <= max(1, int(fraction * sum(min(n, c) for n in case))))
        assert got[s] == want, (case, fraction)


def test_balance_and_split_properties(spark):
    rows = spark.range(400).select("id", (F.col("id") % 37).alias("g"), F.when(F.col("id") % 4 > 0, "yes").otherwise(F.col("id").cast("string")).alias("a"))
    kept = R.balance(rows, F.col("a"), ["id"], 0.3).groupBy("a").count().collect()
    total = sum(r["count"] for r in kept)
    assert max(r["count"] for r in kept) <= max(1, int(total * 0.3)) and len(kept) == 101
    split = R.split_by_group(rows, "g", 0.2, seed=5)
    assert R.leaked(split.where("is_val"), split.where("not is_val"), "g").count() == 0
    assert split.where("is_val").select("g").distinct().count() == 7 and split.count() == 400


def test_answer_normalisation_and_f1(spark):
    row = one(spark, T.normalise_answer(F.lit(" The  a.b, An apple! ")).alias("n"), T.token_f1(F.lit("the cat sat"), F.lit("a cat")).alias("f"), T.token_f1(F.lit("."), F.lit("the")).alias("e"), T.token_f1(F.lit(""), F.lit("x")).alias("z"))
    assert row.n == "ab apple" and abs(row.f - 2 / 3) < 1e-9 and row.e == 1.0 and row.z == 0.0


def test_box_functions(spark):
    lit = lambda *v: tuple(F.lit(float(x)) for x in v)
    w, h = F.lit(400), F.lit(200)
    on = B.to_canvas(lit(10, 20, 110, 120), w, h)
    back = B.from_canvas(on, w, h)
    tokens = B.encode_tokens(lit(112, 56, 0, 224))
    row = one(spark, B.iou(lit(0, 0, 2, 2), lit(1, 1, 3, 3)).alias("i"), B.iou(lit(0, 0, 1, 1), lit(2, 2, 3, 3)).alias("o"), *[c.alias(f"b{i}") for i, c in enumerate(back)], tokens.alias("t"), B.decode_tokens(F.concat(tokens, F.lit(" car ; <loc0001> x ; "), tokens)).alias("d"), B.encode_tokens(lit(0, 224, 112, 56)).alias("inv"))
    assert abs(row.i - 1 / 7) < 1e-9 and row.o == 0
    assert [round(row[f"b{i}"], 6) for i in range(4)] == [10, 20, 110, 120]
    assert row.t == "<loc0256><loc0000><loc1023><loc0512>" == row.inv
    assert [d.label for d in row.d] == ["car", "region"] and abs(row.d[0].x1 - 112) < 0.2


def test_routing(spark):
    asked = [(1, "How many ships are in the harbor?", "single", 1), (2, "describe the scene", "single", 1), (3, "what changed?", "single", 1), (4, "locate the thing", "single", 1), (5, "tanker", "single", 1), (6, "built-up area and area", "single", 2)]
    got = {r.id: r for r in router.repair(router.route(spark.createDataFrame(asked, "id int, query string, input_mode string, image_count int"))).collect()}
    assert [got[i].task for i in (1, 2, 3, 4)] == ["vqa", "caption", "vqa", "vqa"]
    assert got[1].target_entity == "ship" and got[5].target_entity is None and got[6].target_entity == "built-up area"


def test_coregistration_statuses(spark):
    side = "valid boolean, crs string, w int, h int, x0 double, y0 double, x1 double, y1 double, rx double, ry double".split(", ")
    schema = ", ".join(f"{t}_{c}" for t in "ab" for c in side)

    def scene(shift=0.0, valid=True, crs="EPSG:32643", w=100, r=10.0):
        return (valid, crs, w, 100, shift, shift, shift + 1000.0, shift + 1000.0, r, r)

    cases = [(scene(), "identical_grid"), (scene(3.0), "aligned_within_tolerance"), (scene(100.0), "resampling_required"), (scene(5000.0), "no_overlap"), (scene(crs=None), "not_georeferenced"), (scene(crs=None, w=90), "dimension_mismatch"), (scene(valid=False), "unreadable"), (scene(crs="EPSG:4326"), "no_overlap")]
    got = scenes.coregister(spark.createDataFrame([scene() + b for b, _ in cases], schema)).collect()
    assert [r.status for r in got] == [s for _, s in cases]


def test_records_of_three_shapes(spark, tmp_path):
    raw = [
        {"image": "a\\b\\x.png", "conversations": [{"from": "human", "value": "<image> q?"}, {"from": "gpt", "value": " yes "}]},
        {"img": "y.png", "question": "how many", "answer": 3}, {"image": "z.png", "caption": "a field"}, {"image": "w.png", "question": "q", "answer": True}, {"question": "no image", "answer": "x"}, {"image": "v.png", "conversations": [{"from": "gpt", "value": "orphan"}], "question": "q", "answer": "a"},
    ]
    (tmp_path / "wrapped.json").write_text(json.dumps({"info": {}, "records": raw}))
    (tmp_path / "lines.json").write_text("\n\n".join(map(json.dumps, raw)))
    for name in ("wrapped.json", "lines.json"):
        records = readers.read_records(spark, str(tmp_path / name)).withColumn("record_id", F.monotonically_increasing_id())
        got = sorted((r.image_id, r.question, r.answer) for r in D.normalise(records).collect())
        assert got == [("x.png", "q?", "yes"), ("y.png", "how many", "3"), ("z.png", D.CAPTION_QUESTION, "a field")]
    assert readers.describe(readers.read_records(spark, str(tmp_path / "wrapped.json"))).count() >= 6
    assert readers.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    (tmp_path / "bad.json").write_text('{"a": 1}')
    with pytest.raises(Exception, match="no list of records"):
        readers.read_records(spark, str(tmp_path / "bad.json")).collect()


def test_grounding_records(spark):
    raw = [{"image": "a.png", "conversations": [{"from": "human", "value": "the car"}, {"from": "gpt", "value": "{<10><20><30.5><40>}"}]}, {"image": "b.png", "phrase": "ship", "bbox": [1, 2, 3, 4]}, {"image": "c.png", "phrase": "x", "box": "5 6 7 8"}, {"image": "d.png", "phrase": "none"}]
    records = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raw)], "record_id long, j string").select("record_id", F.parse_json("j").alias("record"))
    got = {r.image_id: (r.phrase, r.bbox, r.bbox_convention) for r in D.with_convention(D.normalise_grounding(records)).collect()}
    assert got == {"a.png": ("the car", [10, 20, 30.5, 40], "percent_0_100"), "b.png": ("ship", [1, 2, 3, 4], "percent_0_100"), "c.png": ("x", [5, 6, 7, 8], "percent_0_100")}


def test_build_questions(spark):
    raw = [(i, json.dumps({"image": f"im{i % 40}.png", "question": f"q{i}", "answer": "yes" if i % 3 else f"v{i}"})) for i in range(240)]
    records = spark.createDataFrame(raw, "record_id long, j string").select("record_id", F.parse_json("j").alias("record"))
    files = spark.createDataFrame([(f"/d/im{i}.{'png' if i % 2 else 'tif'}",) for i in range(40)], "path string")
    built = D.build_questions(records, files, min_records=50, min_groups=30, min_answers=20)
    assert R.leaked(built.rows.where("is_val"), built.rows.where("not is_val"), "image_id").count() == 0
    assert built.report.first().top_answer_fraction <= 0.35
    with pytest.raises(R.BuildError, match="too_few_records"):
        D.build_questions(records, files)
    with pytest.raises(R.BuildError, match="image_file_missing"):
        D.build_questions(records, files.limit(10))


def test_label_questions(spark):
    rows = spark.createDataFrame([(1, ["Urban fabric", "Inland waters", " 3 "]), (2, []), (3, ["Mixed forest"])], "patch int, labels array<string>")
    got = D.label_questions(rows, "labels").groupBy("patch").agg(F.collect_list(F.struct("template", "answer")).alias("qa")).collect()
    by = {r.patch: {q.template: q.answer for q in r.qa} for r in got}
    assert len(by[1]) == 10 and len(by[2]) == 7 and by[1]["urban_rural"] == "urban" and by[3]["presence_forest"] == "yes"
    assert by[1]["land_cover_detail"] == "inland waters, urban fabric." and by[1]["land_cover_groups"] == "built-up, water."


def test_change_build_from_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for k in range(12):
            talk = {"conversations": [{"from": "human", "value": f"<image> what {k}"}, {"from": "gpt", "value": f"answer {k}"}]}
            for role, data in (("0.png", b"one%d" % (k // 2)), ("1.png", b"two"), ("json", json.dumps(talk).encode())):
                if (k, role) == (11, "1.png"):
                    continue
                info = tarfile.TarInfo(f"d/{k:03}.{role}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    built = D.build_change(readers.change_samples(readers.tar_members(spark, str(tmp_path / "s.tar"))), cap=1)
    assert {r.reason: r.n for r in built.report.collect()} == {"kept": 11, "image_missing": 1}
    assert built.rows.count() == built.rows.select("pair_id").distinct().count() == 6


def _tiff(path, cube, geo=True):
    bands, h, w = len(cube), len(cube[0]), len(cube[0][0])
    strips = [zlib.compress(b"".join(struct.pack("<H", v) for row in plane for v in row)) for plane in cube]
    data, sizes = b"".join(strips), list(map(len, strips))
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [16]), (259, 3, [8]), (273, 4, [8 + sum(sizes[:i]) for i in range(bands)]), (277, 3, [bands]), (278, 4, [h]), (279, 4, sizes), (284, 3, [2])]
    tags += [(33550, 12, [10.0, 10.0, 0.0]), (33922, 12, [0, 0, 0, 500000.0, 2000000.0, 0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32643])] if geo else []
    extra, entries, at = b"", b"", 8 + len(data)
    after = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(values), *values)
        if len(packed) <= 4:
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<HHII", tag, kind, len(values), after + len(extra))
            extra += packed
    path.write_bytes(b"II*\0" + struct.pack("<I", at) + data + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0" + extra)


def test_tiff_source(spark, tmp_path):
    _tiff(tmp_path / "a.tif", [[[1, 2, 3], [4, 5, 6]], [[7, 8, 9], [10, 11, 9999]]])
    (tmp_path / "b.tif").write_bytes(b"broken")
    meta = {r.path.rsplit("/", 1)[1]: r for r in readers.raster_metadata(spark, str(tmp_path)).collect()}
    assert (meta["a.tif"].w, meta["a.tif"].h, meta["a.tif"].bands, meta["a.tif"].crs, meta["a.tif"].x1) == (3, 2, 2, "EPSG:32643", 500030.0)
    assert meta["b.tif"].error and not meta["a.tif"].error
    pixels = readers.raster_pixels(spark, str(tmp_path / "a.tif"), bands=(1,), nodata=9999)
    assert [(r.y, r.x, r.v) for r in pixels.orderBy("y", "x").collect()] == [(0, 0, 7), (0, 1, 8), (0, 2, 9), (1, 0, 10), (1, 1, 11), (1, 2, None)]


def test_cache_metrics_and_reports(spark):
    gold = spark.createDataFrame([(1, "yes", "a"), (2, "no", "a"), (3, "two", "b")], "id int, answer string, kind string")
    said = spark.createDataFrame([(1, "Yes."), (2, "no")], "id int, prediction string")
    metrics, types = D.benchmark(gold, said, "id", "kind")
    assert abs(metrics.first().exact_match - 2 / 3) < 1e-9 and {r.kind: r.n for r in types.collect()} == {"a": 2, "b": 1, None: 3}
    timed = said.withColumns({"latency": F.lit(2.0), "cache_hit": F.col("id") == 1})
    row = D.benchmark(gold, timed, "id")[0].first()
    assert (row.mean_latency, row.cache_hits, row.most_common_prediction) == (2.0, 1, "")
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 0, 0, 10, 10), (3, 5, 5, 6, 6)], "id int, x0 int, y0 int, x1 int, y1 int")
    found = spark.createDataFrame([(1, 0, 0, 10, 10, "vlm"), (1, 90, 90, 99, 99, "vlm"), (2, 0, 0, 10, 5, "detector")], "id int, x0 int, y0 int, x1 int, y1 int, backend string")
    row = D.benchmark_boxes(boxes, found, "id").first()
    assert (row.n, round(row.mean_iou, 6), round(row.acc_50, 6), round(row.no_detection_rate, 6), row.backends) == (3, 0.5, round(2 / 3, 6), round(1 / 3, 6), {"detector": 1, "none": 1, "vlm": 1})
    hit = readers.cached(said, spark.createDataFrame([("1", "cached", 0.5)], "key string, answer string, confidence double"), F.col("id").cast("string"))
    assert {r.id: r.cache_hit for r in hit.collect()} == {1: True, 2: False}
    facts = F.array(F.struct(F.lit("a<b").alias("key"), F.lit("1 & 2").alias("value")))
    page = one(spark, sinks.html_report(F.lit("T"), F.lit("x < y"), facts, F.array(F.lit("s")), F.array(F.lit("w"), F.lit("w")), F.lit("{}")).alias("p")).p
    assert "x &lt; y" in page and page.count("<li>w</li>") == 1 and "<th>a&lt;b</th>" in page
    assert sinks.markdown_table(gold, ["id", "answer"], ["kind"]).count() == 2
    assert abs(E.sequence_likelihood(spark.createDataFrame([(1, 0.5), (1, 0.5)], "s int, p double"), "s", "p").first().likelihood - 0.5) < 1e-9


def test_modality_and_positions(spark):
    row = one(spark, T.modality(F.lit("/x/S1A_scene.tif"), F.lit("u2"), F.lit(3)).alias("a"), T.modality(F.lit("p.tif"), F.lit("float32"), F.lit(1)).alias("b"), T.modality(F.lit("p.tif"), F.lit("u1"), F.lit(2)).alias("c"), T.position_words(F.lit(90), F.lit(90), F.lit(100), F.lit(100)).alias("p"), T.position_words(F.lit(50), F.lit(50), F.lit(100), F.lit(100)).alias("m"), T.detect_prompt(F.array(F.lit("ship. "), F.lit(" "))).alias("d"))
    assert (row.a, row.b, row.c, row.p, row.m, row.d) == ("sar", "sar", "unknown", "southern eastern", "centre", "detect ship")


def test_listing_and_writers(spark, tmp_path):
    for name in ("a/tile_1.png", "a/tile_2.PNG", "b/other.tif", "b/notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = readers.list_files(spark, str(tmp_path))
    assert sorted(r.name for r in files.collect()) == ["other.tif", "tile_1.png", "tile_2.PNG"]
    assert readers.first_match(files, ("tile", "png")).endswith("a/tile_1.png") and readers.first_match(files, ("none",)) is None
    assert {r.stem for r in readers.image_index(files, "stem").collect()} == {"tile_1", "tile_2", "other"}
    rows = spark.createDataFrame([(1, "é <a>", None), (2, "b", 0.5)], "id int, text string, score double")
    sinks.write_jsonl(rows.coalesce(1), str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out").glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"id": 1, "text": "é <a>", "score": None}, {"id": 2, "text": "b", "score": 0.5}]
    assert readers.read_jsonl(spark, str(tmp_path / "out"), "id int, text string, score double", limit=1, order=("id",)).first().id == 1
    sinks.write_report(rows.limit(1), str(tmp_path / "report"))
    assert json.loads(next((tmp_path / "report").glob("*.json")).read_text())["score"] is None
    stored = readers.uploads(spark, str(tmp_path / "b")).collect()
    assert {r.stored_as.rsplit(".", 1)[1] for r in stored} == {"tif", "txt"} and len({r.stored_as.split(".")[0] for r in stored}) == 1
    assert imagery.column_layout(["B04", "B03", "B02", "VV", "VH", "labels"]) == "per_band" and imagery.column_layout(["s1", "S2"]) == "stacked"
    with pytest.raises(ValueError, match="neither"):
        imagery.column_layout(["x"])


def test_predictions_from_a_table_and_from_a_function(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    told = spark.createDataFrame([(1, "yes")], "id int, answer string")
    assert {r.id: r.answer for r in kernels.predict_from_table(asked, told, "id").collect()} == {1: "yes", 2: None}

    def shout(batch):
        return pa.RecordBatch.from_pydict({"id": batch.column(0), "answer": [p.upper() for p in batch.column(1).to_pylist()]})

    assert {r.id: r.answer for r in kernels.predict(asked, shout, "id int, answer string").collect()} == {1: "A", 2: "B"}


def test_more_prompts(spark):
    row = one(spark, T.fusion_prompt(F.lit(" q ")).alias("f"), T.caption_prompt().alias("c"), T.detect_prompt(F.array(F.lit("ship."), F.lit("car "))).alias("d"))
    assert row.f == "answer en " + T.FUSION_PREFIX + "q" and row.c == "caption en" and row.d == "detect ship ; car"


def _pack_lzw(data):
    """A plain TIFF LZW writer: clears its table whenever it is full."""
    out, have, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal have, bits
        bits, have = bits << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
            bits &= (1 << have) - 1

    table, width, before = {}, 9, b""

    def clear():
        nonlocal table, width
        put(256, width)
        table, width = {bytes([i]): i for i in range(256)}, 9

    clear()
    for byte in data:
        if (more := before + bytes([byte])) in table:
            before = more
            continue
        put(table[before], width)
        table[more] = len(table) + 2
        width = 9 if len(table) + 2 < 512 else 10 if len(table) + 2 < 1024 else 11 if len(table) + 2 < 2048 else 12
        before = bytes([byte])
        if len(table) + 2 >= 4094:
            put(table[before], width)
            before = b""
            clear()
    if before:
        put(table[before], width)
    put(257, width)
    if have:
        out.append(bits << 8 - have & 255)
    return bytes(out)


def test_lzw_and_packbits():
    rng = random.Random(5)
    for data in (b"", b"a" * 5000, bytes(rng.randrange(256) for _ in range(20_000)), bytes(rng.randrange(4) for _ in range(30_000))):
        assert readers.unpack_lzw(_pack_lzw(data)) == data
    assert readers.unpack_bits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 7])) == b"\x01\x02\x03\x09\x09\x09\x07"


@pytest.mark.parametrize("compression", [1, 5, 8, 32773])
@pytest.mark.parametrize(("kind", "form", "predictor"), [("u1", 1, 1), ("u2", 1, 2), ("i2", 2, 2), ("f4", 3, 1), ("f4", 3, 3), ("f8", 3, 3), ("c8", 6, 1)])
@pytest.mark.parametrize(("planar", "big"), [(1, False), (2, True)])
def test_tiled_tiffs(compression, kind, form, predictor, planar, big):
    rng = np.random.default_rng(3)
    cube = (rng.integers(0, 200, (3, 37, 45)) + (1j * rng.integers(0, 9, (3, 37, 45)) if kind == "c8" else 0)).astype(kind)
    size, parts = 16, []
    for planes in ([[b] for b in range(3)] if planar == 2 else [[0, 1, 2]]):
        for y in range(0, 37, size):
            for x in range(0, 45, size):
                tile = np.zeros((size, size, len(planes)), kind)
                piece = cube[planes, y : y + size, x : x + size].transpose(1, 2, 0)
                tile[: piece.shape[0], : piece.shape[1]] = piece
                if predictor == 2:
                    tile[:, 1:] = np.diff(tile, axis=1)
                raw = tile.astype(np.dtype(kind).newbyteorder("<")).tobytes()
                if predictor == 3:
                    n = len(planes)
                    rows = tile.astype(np.dtype(kind).newbyteorder(">")).reshape(size, -1).view(np.uint8).reshape(size, -1, np.dtype(kind).itemsize).transpose(0, 2, 1).reshape(size, -1)
                    rows = rows.copy()
                    rows[:, n:] = rows[:, n:] - rows[:, :-n]
                    raw = rows.tobytes()
                packbits = lambda r: b"".join(bytes([len(r[i : i + 128]) - 1]) + r[i : i + 128] for i in range(0, len(r), 128))
                parts.append({1: bytes, 5: _pack_lzw, 8: zlib.compress, 32773: packbits}[compression](raw))
    bits = np.dtype(kind).itemsize * 8
    start = 16 if big else 8
    body, offsets = b"", []
    for part in parts:
        offsets.append(start + len(body))
        body += part
    tags = [(256, 4, [45]), (257, 4, [37]), (258, 3, [bits]), (259, 3, [compression]), (277, 3, [3]), (284, 3, [planar]), (317, 3, [predictor]), (322, 3, [size]), (323, 3, [size]), (324, 4, offsets), (325, 4, list(map(len, parts))), (339, 3, [form]), (42113, 2, b"7\0")]
    place = start + len(body)
    after = place + (8 + 20 * len(tags) + 8 if big else 2 + 12 * len(tags) + 4)
    entries, extra, room = b"", b"", 8 if big else 4
    for tag, code, values in tags:
        packed = values if code == 2 else struct.pack("<" + {3: "H", 4: "I"}[code] * len(values), *values)
        entries += struct.pack("<HHQ" if big else "<HHI", tag, code, len(values))
        if len(packed) <= room:
            entries += packed.ljust(room, b"\0")
        else:
            entries += struct.pack("<Q" if big else "<I", after + len(extra))
            extra += packed
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, place) if big else struct.pack("<2sHI", b"II", 42, place)
    raw = head + body + struct.pack("<Q" if big else "<H", len(tags)) + entries + (b"\0" * (8 if big else 4)) + extra
    tiff = readers.Tiff(raw)
    assert np.allclose(tiff.pixels(), np.abs(cube) if kind == "c8" else cube) and tiff.nodata == 7


def test_images_are_decoded_in_the_jvm(spark, tmp_path):
    w, h = 5, 4
    rows = [[(x * 40, y * 50, (x + y) * 20) for x in range(w)] for y in range(h)]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    lines = b"".join(b"\0" + b"".join(bytes(p) for p in row) for row in rows)
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))
    pixel = b"".join(b"".join(bytes(p[::-1]) for p in row) + b"\0" * (-3 * w % 4) for row in rows[::-1])
    (tmp_path / "b.bmp").write_bytes(struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(pixel), 0, 0, 54, 40, w, h, 1, 24, 0, len(pixel), 0, 0, 0, 0) + pixel)
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + struct.pack("<HH", 7, 3) + b"\0\0\0")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 6, 9) + b"\x03" + b"\0" * 12)
    (tmp_path / "e.jpg").write_bytes(b"\xff\xd8\xff")
    meta = {r.path.rsplit("/", 1)[1]: r for r in readers.raster_metadata(spark, str(tmp_path)).collect()}
    assert [(meta[n].driver, meta[n].w, meta[n].h, meta[n].bands) for n in ("a.png", "b.bmp", "c.gif", "d.jpg")] == [("PNG", 5, 4, 3), ("BMP", 5, 4, 3), ("GIF", 7, 3, 1), ("JPEG", 9, 6, 3)] and meta["e.jpg"].error
    got = {(r.scene[-5:], r.y, r.x, r.band): r.v for r in readers.image_pixels(spark, str(tmp_path)).collect()}
    assert all(got[name, y, x, b] == rows[y][x][b] for name in ("a.png", "b.bmp") for y in range(h) for x in range(w) for b in range(3)) and len(got) == 2 * 3 * w * h


def test_every_band_has_to_be_there(spark, tmp_path):
    _tiff(tmp_path / "a.tif", [[[1, 9999, 3]], [[7, 8, 9999]]])
    both = readers.raster_pixels(spark, str(tmp_path), nodata=9999, every_band=True).where("v is not null").collect()
    assert sorted((r.band, r.x, r.v) for r in both) == [(0, 0, 1.0), (1, 0, 7.0)]


@pytest.mark.parametrize("most", [0, 1, 7, 99, 100, 1500, 5000])
def test_seeded_sample_is_the_first_in_order(spark, most):
    """Few rows leave most bins empty: the bin that is cut is the next one with rows."""
    rows = spark.range(1500).withColumnRenamed("id", "k")
    want = {r.k for r in rows.orderBy(R.seeded(4, F.col("k")), "k").limit(most).collect()}
    assert {r.k for r in R.seeded_sample(rows, ["k"], most, seed=4).collect()} == want
