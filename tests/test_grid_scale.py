"""Steps over planes of any size: no task holds a plane's values, few shuffles."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import grid as G
from rasterloom.operators.checkpoints import checkpointed


def plane(spark, a):
    y, x = np.indices(a.shape)
    return checkpointed(spark.createDataFrame([("s", 0, *r) for r in zip(y.ravel().tolist(), x.ravel().tolist(), a.ravel().tolist(), strict=True)], "scene string, band int, y long, x long, v double"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_reducer_holds_the_values_of_a_plane(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0, 9, (40, 30)), rng.uniform(0, 9, (40, 30))
    first, second = plane(spark, a), plane(spark, b)
    for out in (G.stretch(first), G.decibels(first), G.radiometric_fit(first, second), G.sar_classes(first, second), G.with_percentiles(first, (0.5,), ("m",))):
        assert "percentile" not in plan_of(out)
    fit = G.radiometric_fit(first, second).first()
    (r1, r3), (t1, t3) = np.percentile(a, [25, 75]), np.percentile(b, [25, 75])
    assert np.isclose(fit.gain, (r3 - r1) / (t3 - t1)) and np.isclose(fit.offset, r1 - fit.gain * t1)
    nothing = first.withColumn("v", F.lit(None).cast("double"))
    assert G.stretch(nothing).count() == 1200
    assert G.with_percentiles(nothing, (0.5,), ("m",)).where("m is null").count() == 1200


def test_opening_and_closing_share_their_shuffles(spark):
    a = np.random.default_rng(2).random((23, 31)) < 0.5
    mask = plane(spark, a.astype(float)).select("scene", "band", "y", "x", (F.col("v") > 0).alias("on"))
    out = G.morphology(mask, {"opened": (("erode", 1), ("dilate", 1)), "closed": (("dilate", 1), ("erode", 1))}, ["on"])
    assert plan_of(out).count("Exchange hashpartitioning") == 3

    def spread(m, pick, fill):
        wide = np.pad(m, 1, constant_values=fill)
        return pick(np.lib.stride_tricks.sliding_window_view(wide, (3, 3)), axis=(2, 3))

    want = spread(spread(a, np.all, True), np.any, False), spread(spread(a, np.any, False), np.all, True)
    for r in out.collect():
        assert (r.on, r.opened, r.closed) == (a[r.y, r.x], want[0][r.y, r.x], want[1][r.y, r.x])


def test_components_across_tiles(spark):
    a = np.ones((11, 10), bool)
    a[1:10:4, :9] = a[3:10:4, 1:] = False  # one snake through all tiles
    a[6:, 4] = False
    cells = plane(spark, a.astype(float)).where("v > 0").selectExpr("scene", "y as cy", "x as cx")
    got = {e: {(r.cy, r.cx): (r.label.cy, r.label.cx) for r in G.components(cells, edge=e).collect()} for e in (3, 256)}
    assert got[3] == got[256] and len(got[3]) == a.sum() and len(set(got[3].values())) > 1
