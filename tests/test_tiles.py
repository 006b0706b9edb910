"""Tiles beside whole planes; rank selection beside the grouped percentile."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_grid import array, plane

from rasterloom.operators import grid as G
from rasterloom.operators import ranks, tiles


def planes(spark, arrays):
    rows = [(s, b, y, x, None if np.isnan(v) else float(v)) for (s, b), a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "scene string, band int, y long, x long, v double")


def cells(df):
    return sorted((r.scene, r.band, r.y, r.x, None if r.v is None else round(r.v, 9)) for r in df.collect())


@pytest.fixture
def two(spark):
    """Two planes whose sizes no edge divides, one with missing pixels."""
    rng = np.random.default_rng(8)
    a, b = rng.gamma(1.0, 0.05, (17, 23)), rng.gamma(1.0, 0.05, (9, 8))
    a[3, 4:9] = a[16, 22] = np.nan
    return planes(spark, {("s", 0): a, ("s", 1): b, ("t", 0): a[:7, :5]})


@pytest.mark.parametrize("edge", [3, 5, 8, 64])
def test_there_and_back(two, edge):
    assert cells(tiles.untiled(tiles.tiled(two, edge), edge)) == cells(two)


@pytest.mark.parametrize("edge", [3, 7, 64])
def test_neighbourhoods_equal_the_window_forms(two, edge):
    cut = tiles.tiled(two, edge)
    for mine, theirs in ((tiles.box_means(cut, 2, edge=edge), G.box_means(two, 2)), (tiles.lee(cut, 2, edge=edge), G.lee(two, 2)), (tiles.texture(cut, 1, edge=edge), G.texture(two, 1)), (tiles.box_means(cut, 0, edge=edge), two)):
        assert cells(tiles.untiled(mine, edge)) == cells(theirs)


@pytest.mark.parametrize("edge", [6, 9, 64])
def test_morphology_equals_the_window_form(spark, edge):
    on = np.random.default_rng(2).random((20, 31)) < 0.6
    mask = planes(spark, {("s", 0): on.astype(float)})
    whole = mask.select("scene", "band", "y", "x", (F.col("v") == 1).alias("on"))
    cut = tiles.tiled(mask, edge)
    got = {k: array(tiles.untiled(d, edge)) for k, d in (("open", tiles.opened(cut, edge=edge)), ("close", tiles.closed(cut, 2, edge=edge)), ("both", tiles.morphology(cut, (("erode", 1), ("dilate", 1), ("dilate", 2), ("erode", 2)), edge=edge)))}
    expected = {"open": G.opened(whole), "close": G.closed(whole, 2), "both": G.closed(G.opened(whole), 2)}
    for name, df in expected.items():
        assert (got[name] == array(df.withColumn("on", F.col("on").cast("int")), "on")).all(), name
    with pytest.raises(ValueError):
        tiles.opened(cut, edge, edge=edge)
    with pytest.raises(ValueError):
        tiles.morphology(cut, (("grow", 1),), edge=edge)


def spiral(n):
    """One component that winds from the corner to the middle."""
    out, y, x, dy, dx = np.zeros((n, n)), 0, 0, 0, 1
    for _ in range(n * n):
        out[y, x] = 1
        ahead = lambda k, dy, dx: (y + k * dy, x + k * dx)  # noqa: B023, E731
        blocked = lambda p: not (0 <= p[0] < n and 0 <= p[1] < n)
        if blocked(ahead(1, dy, dx)) or not blocked(ahead(2, dy, dx)) and out[ahead(2, dy, dx)]:
            dy, dx = dx, -dy
            if blocked(ahead(1, dy, dx)) or out[ahead(1, dy, dx)] or not blocked(ahead(2, dy, dx)) and out[ahead(2, dy, dx)]:
                break
        y, x = ahead(1, dy, dx)
    return out


def flooded(on):
    labels, out = {}, {}
    for y, x in zip(*np.nonzero(on), strict=True):
        if (y, x) in labels:
            continue
        todo = [(y, x)]
        while todo:
            p = todo.pop()
            if p in labels or not (0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1]) or not on[p]:
                continue
            labels[p] = (y, x)
            todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    for p, label in labels.items():
        out.setdefault((int(label[0]), int(label[1])), []).append((int(p[0]), int(p[1])))
    return out


@pytest.mark.parametrize("edge", [4, 5, 64])
def test_components_equal_flooding(spark, edge):
    rng = np.random.default_rng(7)
    masks = {("s", 0): spiral(21), ("s", 1): (rng.random((19, 26)) < 0.55).astype(float), ("t", 0): np.ones((9, 9)), ("u", 0): np.zeros((6, 6))}
    masks[("s", 1)][2, 2] = np.nan
    labelled = tiles.components(tiles.tiled(planes(spark, masks), edge), edge=edge)
    got = {(r.scene, r.band, r.label_y, r.label_x): (r.cells, r.x0, r.y0, r.x1, r.y1, round(r.cy, 9), round(r.cx, 9)) for r in tiles.component_boxes(labelled, edge=edge).collect()}
    expected = {}
    for (scene, band), on in masks.items():
        for label, found in flooded(on == 1).items():
            ys, xs = [p[0] for p in found], [p[1] for p in found]
            expected[(scene, band, *label)] = (len(found), min(xs), min(ys), max(xs) + 1, max(ys) + 1, round(float(np.mean(ys)), 9), round(float(np.mean(xs)), 9))
    assert got == expected


def test_label_block():
    on = spiral(15) == 1
    labels = tiles.label_block(on, 100, 7, 1000)
    for label, found in flooded(on).items():
        assert {int(labels[p]) for p in found} == {(100 + label[0]) * 1000 + 7 + label[1]}
    assert (labels[~on] == -1).all() and (tiles.label_block(np.zeros((3, 3), bool), 0, 0, 3) == -1).all()


def test_halos_shuffle_less(spark):
    """A row per tile and neighbour, not per pixel."""
    big = planes(spark, {("s", 0): np.arange(64.0 * 64).reshape(64, 64)})
    cut = tiles.tiled(big, 16)
    assert cut.count() == 16 and tiles.untiled(tiles.box_means(cut, 2, edge=16), 16).count() == 64 * 64


# ---- ranks -------------------------------------------------------------------------------------


@pytest.mark.parametrize("most, bins", [(1, 64), (10, 300), (1 << 16, 4096)])
def test_percentiles_are_the_grouped_ones(spark, most, bins):
    rng = np.random.default_rng(4)
    groups = {
        "normal": rng.normal(0, 50, 700), "heavy": np.exp(rng.normal(0, 30, 300)), "equal": np.full(90, 7.5), "two": np.array([1.0, 1.0, 2.0]), "one": np.array([-3.25]), "ties": rng.integers(0, 3, 400).astype(float),
        "far": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, -0.0, 1.0]), None: rng.normal(0, 1, 50), "none": np.array([np.nan]),
    }
    rows = [(k, None if np.isnan(v) else float(v)) for k, a in groups.items() for v in a] + [("normal", None), ("normal", float("nan"))]
    table = spark.createDataFrame(rows, "k string, v double")
    shares = (0.0, 0.02, 0.25, 0.5, 0.98, 1.0)
    expected = {r.k: r.q for r in table.where("not isnan(v)").groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).where("q is not null").collect()}
    got = {r.k: r.q for r in ranks.percentiles(table, "v", shares, ("k",), most=most, bins=bins).collect()}
    assert {k: [x + 0.0 for x in q] for k, q in got.items()} == {k: [x + 0.0 for x in q] for k, q in expected.items()}
    whole = ranks.percentiles(table.where("k = 'normal'"), "v", (0.1, 0.9), most=most, bins=bins).first().q
    assert whole == table.where("k = 'normal' and not isnan(v)").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.9)))).first()[0]
    assert ranks.percentiles(table.limit(0), "v", shares, ("k",), most=most).count() == 0
