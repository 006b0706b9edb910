import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import grid as G
from rasterloom.operators import kernels as K


def plane(spark, *bands, scene="s"):
    rows = [(scene, b, y, x, float(a[y, x])) for b, a in enumerate(bands) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "scene string, band int, y long, x long, v double")


def array(df, column="v", shape=None):
    rows = df.select("y", "x", column).collect()
    out = np.zeros(shape or (max(r.y for r in rows) + 1, max(r.x for r in rows) + 1))
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


@pytest.fixture
def rng():
    return np.random.default_rng(1234)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_box_mean_and_lee_equal_their_kernels(spark, rng, radius):
    a = rng.gamma(1.0, 0.05, (9, 12))
    k = np.pad(a, radius, mode="reflect")
    naive = np.array([[k[y : y + 2 * radius + 1, x : x + 2 * radius + 1].mean() for x in range(12)] for y in range(9)])
    pixels = plane(spark, a)
    assert np.allclose(array(G.box_means(pixels, radius)), naive)
    assert np.allclose(array(K.plane_kernel(pixels, lambda p: K.box_mean(p, radius))), naive)
    assert np.allclose(array(G.lee(pixels, radius)), K.lee(a, radius))
    assert K.lee(a, radius).var() < a.var()


def test_stretch(spark, rng):
    out = array(G.stretch(plane(spark, rng.normal(0, 50, (20, 20)))))
    assert out.min() == 0 and out.max() == 255
    assert np.all(array(G.stretch(plane(spark, np.full((3, 3), 7.0)))) == 0)


def test_decibels(spark):
    a = np.array([[1.0, 10.0], [100.0, 1000.0]])
    power, dn = array(G.decibels(plane(spark, a / 1e4))), array(G.decibels(plane(spark, a / 1e4), integer=True))
    assert np.allclose(np.diff(power.ravel())[1:2], 10) and dn.min() >= -30
    assert G.decibels(plane(spark, a - 50)).first().label == "already_db"


def test_otsu_separates_two_groups(spark):
    a = np.concatenate([np.full(500, 0.1), np.full(500, 0.8)]).reshape(20, 50)
    row = G.otsu(plane(spark, a)).first()
    assert 25 / 256 < row.threshold < 0.8 and row.separability > 0.9  # the first of equal bins: the one that holds 0.1


def test_otsu_equals_the_dense_histogram(spark, rng):
    a = np.clip(np.concatenate([rng.normal(0.3, 0.05, 300), rng.normal(0.7, 0.1, 100)]), 0, 1).reshape(20, 20)
    hist, edges = np.histogram(a, 256, (0, 1))
    p, c = hist / hist.sum(), (edges[:-1] + edges[1:]) / 2
    w, m = p.cumsum(), (p * c).cumsum()
    with np.errstate(all="ignore"):
        s = np.nan_to_num((m[-1] * w - m) ** 2 / (w * (1 - w)), posinf=0, neginf=0)
    assert abs(G.otsu(plane(spark, a)).first().threshold - c[np.argmax(s)]) < 1e-9


def test_radiometric_fit_undoes_gain_and_offset(spark, rng):
    a = rng.uniform(40, 200, (24, 24))
    same = G.radiometric_fit(plane(spark, a), plane(spark, a)).first()
    assert abs(same.gain - 1) < 1e-9 and abs(same.offset) < 1e-9
    moved = a * 0.6 + 15
    back = array(G.radiometric_normalise(plane(spark, a), plane(spark, moved)))
    assert np.abs(back - a).mean() * 4 < np.abs(moved - a).mean()


def test_morphology(spark):
    a = np.zeros((16, 16))
    a[4:10, 4:10] = 1
    a[1, 14] = 1
    pin = a.copy()
    pin[6, 6] = 0
    mask = lambda m: plane(spark, m).select("scene", "band", "y", "x", (F.col("v") > 0).alias("on"))
    assert array(G.opened(mask(a)), "on")[1, 14] == 0 and array(G.opened(mask(a)), "on")[4:10, 4:10].all()
    assert array(G.closed(mask(pin)), "on")[6, 6] == 1


def _components(m):
    label, left = {}, {(int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)}
    while left:
        start = min(left)
        todo = [start]
        left.discard(start)
        while todo:
            y, x = todo.pop()
            label[y, x] = start
            for n in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if n in left:
                    left.discard(n)
                    todo.append(n)
    return label


def test_components_equal_flood_fill(spark, rng):
    for m in (rng.random((14, 17)) < 0.45, np.indices((9, 9)).sum(0) % 2 == 0, np.ones((5, 5), bool)):
        mask = plane(spark, m.astype(float)).select("scene", "band", "y", "x", (F.col("v") > 0).alias("on"))
        got = {(r.cy, r.cx): (r.label.cy, r.label.cx) for r in G.components(G.pooled(mask)).collect()}
        assert got == _components(m)


def test_change_is_found_where_it_is(spark, rng):
    a = rng.uniform(60, 120, (64, 64))
    b = a.copy()
    b[40:60, 40:60] = 250
    mask = G.detect_change(plane(spark, a), plane(spark, b))
    top = G.regions(mask).where("rank = 1").first()
    assert top.direction == "southern eastern" and top.x0 >= 36 and top.y1 <= 64
    assert G.change_summary(G.detect_change(plane(spark, a), plane(spark, a))).first().changed_fraction < 0.02


def test_sar_classes(spark, rng):
    sar, dark, light = rng.uniform(100, 140, (32, 32)), np.full((32, 32), 30.0), rng.uniform(60, 90, (32, 32))
    sar[:12, :12] = 2
    optical = light.copy()
    optical[:12, :12] = dark[:12, :12]
    water = array(G.sar_classes(plane(spark, optical), plane(spark, sar)), "water")
    assert water[2:9, 2:9].all() and water[20:, 20:].sum() < 30
    optical[:12, :12] = 250
    rejected = G.sar_classes(plane(spark, optical), plane(spark, sar)).agg(F.count_if("rejected")).first()[0]
    assert rejected > 80


def test_bands_colour_and_overlay(spark):
    c = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    rgb = lambda n, names=(), ci=(): spark.range(1).select(G.rgb_bands(F.lit(n), c(*names), c(*ci))).first()[0]
    assert rgb(4) == [3, 2, 1] and rgb(12) == [4, 3, 2] and rgb(1) == [1] and rgb(7) == [1, 2, 3]
    assert rgb(4, ci=("red", "green", "blue", "alpha")) == [1, 2, 3] and rgb(5, names=("B02", "B03", "B04", "B08", "x")) == [3, 2, 1]
    assert spark.range(1).select(G.luminance(F.lit(255), F.lit(255), F.lit(255))).first()[0] == 255
    both = G.false_colour(plane(spark, np.full((2, 2), 200.0)), plane(spark, np.full((2, 2), 50.0)))
    assert both.first().b == 255
    classes = both.select("scene", "y", "x", (F.col("y") == 0).alias("water"), (F.col("x") == 0).alias("built_up"))
    assert {(r.y, r.x): r.r for r in G.overlay(both, classes).collect()}[1, 1] == 200


def test_bilinear_resampling(spark):
    a = np.arange(12, dtype=float).reshape(3, 4)
    grid = spark.createDataFrame([("s", 0, 0, 0.5, 0.5), ("s", 0, 1, 2.0, 3.0), ("s", 0, 2, 5.0, 5.0)], "scene string, y long, x long, sy double, sx double")
    got = {r.x: r.v for r in G.resample_bilinear(plane(spark, a), grid).collect()}
    assert got[0] == 2.5 and got[1] == 11.0 and got.get(2) is None
