"""Reference systems beside tabulated points and an integral; footprints of all sizes; sizes; word scores."""

import cmath
import math
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_grid import array, plane

from rasterloom.functions import projections as P
from rasterloom.functions import text as T
from rasterloom.operators import grid as G
from rasterloom.operators import router, scenes

E2 = P.FLAT * (2 - P.FLAT)


def arc(phi):
    """Meridian arc to a (complex) latitude by 64-point Gauss-Legendre quadrature."""
    at, weight = np.polynomial.legendre.leggauss(64)
    phis = phi * (at + 1) / 2
    return P.A * (1 - E2) * complex(np.sum(weight * (1 - E2 * np.sin(phis) ** 2) ** -1.5)) * phi / 2


def plain_zone(meridian, south, lon, lat):
    """Transverse Mercator as the analytic continuation of the arc over the isometric latitude."""
    e, phi = math.sqrt(E2), math.radians(lat)
    target = math.asinh(math.tan(phi)) - e * math.atanh(e * math.sin(phi)) + 1j * math.radians(lon - meridian)
    z = complex(phi, math.radians(lon - meridian) * math.cos(phi))
    for _ in range(50):
        wrong = cmath.asinh(cmath.tan(z)) - e * cmath.atanh(e * cmath.sin(z)) - target
        z -= wrong * cmath.cos(z) * (1 - E2 * cmath.sin(z) ** 2) / (1 - E2)
    m = arc(z)
    return P.SCALE * m.imag + P.EAST, P.SCALE * m.real + (P.NORTH if south else 0.0)


def test_zones_equal_the_integral_and_come_back(spark):
    rng = np.random.default_rng(1)
    rows = [(f"EPSG:{32600 + z + (100 if lat < 0 else 0)}", (z * 6 - 183), float(z * 6 - 183 + d), float(lat)) for z, d, lat in zip(rng.integers(1, 61, 60), rng.uniform(-6, 6, 60), rng.uniform(-80, 80, 60), strict=True)]
    table = spark.createDataFrame([(c, float(m), lo, la) for c, m, lo, la in rows], "crs string, m double, lon double, lat double")
    there = table.withColumn("p", P.from_lonlat(F.col("crs"), F.col("lon"), F.col("lat")))
    for r in there.withColumn("q", P.to_lonlat(F.col("crs"), F.col("p.x"), F.col("p.y"))).collect():
        x, y = plain_zone(r.m, r.lat < 0, r.lon, r.lat)
        assert abs(r.p.x - x) < 1e-4 and abs(r.p.y - y) < 1e-4
        assert abs((r.q.x - r.lon + 180) % 360 - 180) < 1e-9 and abs(r.q.y - r.lat) < 1e-9


def test_tabulated_points(spark):
    """On a central meridian: the quarter and the eighth of the meridian; the tower of Toronto; web Mercator's edge."""
    rows = [("EPSG:32631", 3.0, 0.0, 500000.0, 0.0), ("EPSG:32631", 3.0, 90.0, 500000.0, 10001965.7293 * 0.9996), ("EPSG:32631", 3.0, 45.0, 500000.0, 4984944.3780 * 0.9996), ("EPSG:32731", 3.0, 0.0, 500000.0, 1e7), ("EPSG:3857", 180.0, 0.0, 20037508.342789244, 0.0), ("EPSG:3857", 0.0, 85.0511287798066, 0.0, 20037508.342789244)]
    table = spark.createDataFrame(rows, "crs string, lon double, lat double, x double, y double")
    for r in table.withColumn("p", P.from_lonlat(F.col("crs"), F.col("lon"), F.col("lat"))).collect():
        assert abs(r.p.x - r.x) < 1e-3 and abs(r.p.y - r.y) < 1e-3, r
    tower = spark.range(1).select(P.from_lonlat(F.lit("EPSG:32617"), F.lit(-(79 + 23 / 60 + 13.7 / 3600)), F.lit(43 + 38 / 60 + 33.24 / 3600)).alias("p")).first().p
    assert (round(tower.x), round(tower.y)) == (630084, 4833439)
    odd = [("EPSG:9999", 1.0, 1.0), (None, 1.0, 1.0), ("EPSG:32631", 100.0, 0.0), ("EPSG:32631", 3.0, 91.0), ("EPSG:3857", 3.0, 90.0), ("local", 0.0, 0.0)]
    assert spark.createDataFrame(odd, "crs string, lon double, lat double").where(P.from_lonlat(F.col("crs"), F.col("lon"), F.col("lat")).isNotNull()).count() == 0


def test_pairs_in_two_systems_reach_their_status(spark):
    box = lambda crs, lon, lat, lon2, lat2: spark.range(1).select(P.bounds(F.lit("EPSG:4326"), F.lit(crs), tuple(map(F.lit, (lon, lat, lon2, lat2)))).alias("b")).first().b
    near, far = box("EPSG:32632", 8.9, 47.9, 9.1, 48.1), box("EPSG:32632", 12.0, 47.9, 12.2, 48.1)
    rows = [(1, "EPSG:4326", "EPSG:32632", 8.9, 47.9, 9.1, 48.1, *near, True), (2, "EPSG:4326", "EPSG:32632", 8.9, 47.9, 9.1, 48.1, *far, True), (3, "EPSG:4326", "EPSG:1234", 8.9, 47.9, 9.1, 48.1, *near, True), (4, "EPSG:4326", "EPSG:32632", 8.9, 47.9, 9.1, 48.1, *near, False)]
    names = "id int, a_crs string, b_crs string, a_x0 double, a_y0 double, a_x1 double, a_y1 double, b_x0 double, b_y0 double, b_x1 double, b_y1 double, a_valid boolean"
    pairs = spark.createDataFrame(rows, names).withColumns({"b_valid": F.lit(True), **{f"{s}_{d}": F.lit(100) for s in "ab" for d in "wh"}, "a_rx": F.lit(0.002), "a_ry": F.lit(0.002), "b_rx": F.lit(150.0), "b_ry": F.lit(220.0)})
    got = {r.id: r for r in scenes.coregister(pairs).collect()}
    assert {i: r.status for i, r in got.items()} == {1: "resampling_required", 2: "no_overlap", 3: "no_overlap", 4: "unreadable"}
    assert got[1].overlap > 0.99 and got[1].b_x0 == near.x0 and "_moved" not in got[1].asDict()


# ---- footprints --------------------------------------------------------------------------------


@pytest.mark.parametrize("edge", [1.0, 10.0, 64.0])
def test_footprints_of_all_sizes(spark, edge):
    rng = np.random.default_rng(9)

    def some(n, first):
        at, size = rng.uniform(-300, 300, (n, 2)), 10 ** rng.uniform(-1, 3.3, (n, 2))
        return [(first + i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(at, size, strict=True))]

    left = [*some(120, 0), (900, 0.0, 0.0, 3000.0, 3000.0), (901, 5.0, 5.0, 5.0, 9.0), (902, 0.0, 0.0, 64.0, 64.0), (903, 1.0, None, 2.0, 2.0)]
    right = [*some(120, 0), (900, 0.0, 0.0, 64.0, 64.0), (901, -1e7, -1e7, 1e7, 1e7), (902, 64.0, 64.0, 128.0, 128.0)]
    frame = lambda rows: spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.left_id, r.right_id, round(r.overlap, 9)) for r in scenes.footprint_pairs(frame(left), frame(right), edge, 0.3).collect())
    want = []
    for a in left:
        for b in right:
            if None in a:
                continue
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            smaller = min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))
            if w > 0 and h > 0 and smaller > 0 and w * h / smaller >= 0.3:
                want.append((a[0], b[0], round(w * h / smaller, 9)))
    assert got == sorted(want) and len(got) > 100


@pytest.mark.parametrize("least", [0.55, 0.6, 1.0])
def test_footprints_meet_by_their_centres(spark, least):
    rng = np.random.default_rng(3)

    def some(n):
        at, size = rng.integers(-40, 40, (n, 2)) / 2, 2.0 ** rng.integers(-3, 7, (n, 2))
        return [(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(at, size, strict=True))]

    frame = lambda rows: spark.createDataFrame(rows, "id int, x0 double, y0 double, x1 double, y1 double")
    left, right, want = some(150), [*some(150), (900, 5.0, 5.0, 5.0, 9.0), (901, -1e6, -1e6, 1e6, 1e6), (902, 9.0, 9.0, 1.0, 1.0)], []
    for a in left:
        for b in right:
            w, h = min(a[3], b[3]) - max(a[1], b[1]), min(a[4], b[4]) - max(a[2], b[2])
            smaller = min((a[3] - a[1]) * (a[4] - a[2]), (b[3] - b[1]) * (b[4] - b[2]))
            if w > 0 and h > 0 and smaller > 0 and w * h / smaller >= least:
                want.append((a[0], b[0], w * h / smaller))
    assert sorted(map(tuple, scenes.footprint_pairs(frame(left), frame(right), 10.0, least).collect())) == sorted(want) and len(want) > 300


def test_few_footprints_are_met_in_vain(spark):
    """Scenes of like sizes, smaller than a cell: cells of the edge's width met some 38 pairs for one that overlaps."""
    left = spark.range(400).selectExpr("id", "id * 7919 % 110 * 1d as x0", "id % 97 * 1d as y0", "id * 7919 % 110 + 6d as x1", "id % 97 + 6d as y1")
    right = spark.range(3000).selectExpr("id", "id * 104729 % 1100 / 10d as x0", "id % 97 * 1d as y0", "id * 104729 % 1100 / 10d + 8d as x1", "id % 97 + 5d as y1")
    met, found = scenes.footprints_met(left, right, 10.0).count(), scenes.footprint_pairs(left, right, 10.0).count()
    assert found > 1000 and met < 8 * found


def test_a_continent_takes_four_cells_at_most(spark):
    from rasterloom.functions import boxes as B

    rows = [(float(x), float(y), float(x + w), float(y + h)) for x, y, w, h in ((0, 0, 3000, 3000), (-7.5, 3, 1e6, 2), (1, 1, 0, 0), (9.999, 0, 10, 10), (0, 0, 40, 40))]
    table = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")
    box = tuple(map(F.col, table.columns))
    assert max(r[0] for r in table.select(F.size(B.cells_at(box, 10.0, B.cell_level(box, 10.0)))).collect()) <= 4


# ---- sizes, words, plans -----------------------------------------------------------------------


def plain_resize(a, out, whole):
    """Triangles as wide as the coarser pixels, along rows, then along columns."""
    for axis in (1, 0):
        n, m = a.shape[axis], out[axis]
        scale, wide = n / m, max(n / m, 1.0)
        k = np.maximum(0, 1 - np.abs((np.arange(n)[None, :] + 0.5 - (np.arange(m)[:, None] + 0.5) * scale) / wide))
        a = np.moveaxis(np.tensordot(k / k.sum(1, keepdims=True), a, axes=(1, axis)), 0, axis)
        a = np.floor(a + 0.5) if whole else a
    return a


@pytest.mark.parametrize("out", [(5, 7), (23, 40), (11, 4), (1, 1)])
def test_resize(spark, out):
    a = np.random.default_rng(3).integers(0, 256, (11, 17)).astype(float)
    pairs = spark.createDataFrame([("s", *out, *a.shape)], "scene string, a_h long, a_w long, b_h long, b_w long")
    assert np.allclose(array(G.resize(plane(spark, a), pairs, whole=False)), plain_resize(a, out, False))
    assert np.abs(array(G.resize(plane(spark, a), pairs)) - plain_resize(a, out, True)).max() <= 1
    assert array(G.resize(plane(spark, np.full((8, 8), 7.0)), pairs.selectExpr("scene", "a_h", "a_w", "8L as b_h", "8L as b_w"))).std() == 0


def test_word_scores_of_long_texts(spark):
    rng = np.random.default_rng(2)
    texts = [(" ".join(f"w{i}" for i in rng.integers(0, k, n)), " ".join(f"w{i}" for i in rng.integers(0, k, m))) for n, m, k in ((0, 0, 1), (0, 5, 9), (7, 9, 4), (60, 40, 20), (20_000, 20_000, 10**6), (20_000, 15_000, 3))]
    table = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id int, a string, b string").coalesce(1)
    began = time.time()
    got = {r.id: r.f1 for r in table.select("id", T.token_f1(F.col("a"), F.col("b")).alias("f1")).collect()}
    assert time.time() - began < 10
    for i, (a, b) in enumerate(texts):
        p, g = a.split(), b.split()
        same = sum((Counter(p) & Counter(g)).values())
        want = float(len(p) == len(g)) if not p or not g else 2 * same / (len(p) + len(g))
        assert abs(got[i] - want) < 1e-12


def test_plan_steps_from_sql(spark):
    router.register_plans(spark)
    rows = [(1, "vqa", None), (2, "grounding", ["ship.", "road."]), (3, "change_analysis", None), (4, "unheard of", None), (5, None, None)]
    routed = spark.createDataFrame(rows, "request_id int, task string, search_nouns array<string>")
    routed.createOrReplaceTempView("_plans_here")
    want = sorted((r.request_id, r.step_order, r.tool, r.purpose, r.parameters) for r in router.plan(routed).collect())
    lateral = spark.sql("SELECT r.request_id, s.* FROM _plans_here r, LATERAL plan_steps(r.task, r.search_nouns) s")
    assert sorted(map(tuple, lateral.collect())) == want == sorted(map(tuple, spark.sql("SELECT * FROM plan_steps(TABLE(_plans_here) PARTITION BY request_id)").collect()))
    with pytest.raises(Exception, match="lacks"):
        spark.sql("SELECT * FROM plan_steps(TABLE(SELECT 1 AS request_id))").collect()
