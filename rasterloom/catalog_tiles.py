"""Queries over tiles and rank selection, each beside the SQL of its whole-plane or grouped form."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _MASK, _PX, _mask, _mean_sql, _pixels, _spread_sql, query, table
from .operators import checkpoints, ranks, tiles

_EDGE = 32


@query(f"WITH {_PX}, {_mean_sql('px', 'bm', 2)} SELECT y, x, round(v, 6) AS v FROM bm")
def tiles_box_mean(spark, sf_dir):
    out = tiles.box_means(tiles.tiled(_pixels(spark, sf_dir), _EDGE), 2, edge=_EDGE)
    return tiles.untiled(out, _EDGE).select("y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {_PX.replace('unnest(embedding)::DOUBLE', 'abs(unnest(embedding)::DOUBLE)')}, sq AS (SELECT y, x, v * v AS v FROM px), {_mean_sql('px', 'bm', 2)}, {_mean_sql('sq', 'bs', 2)},
  j AS (SELECT px.y, px.x, px.v, bm.v AS m, greatest(bs.v - bm.v * bm.v, 0) / greatest(bm.v * bm.v, 1e-10) AS ci2 FROM px JOIN bm USING (y, x) JOIN bs USING (y, x))
SELECT y, x, round(m + greatest(0, least(1, 1 - 0.523 * 0.523 / greatest(ci2, 1e-10))) * (v - m), 6) AS v FROM j""")
def tiles_lee(spark, sf_dir):
    out = tiles.lee(tiles.tiled(_pixels(spark, sf_dir).withColumn("v", F.abs("v")), _EDGE), edge=_EDGE)
    return tiles.untiled(out, _EDGE).select("y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {_MASK}, {_spread_sql('mask', 'e1', 'min', 1)}, {_spread_sql('e1', 'o1', 'max', 1)}, {_spread_sql('o1', 'd2', 'max', 2)}, {_spread_sql('d2', 'c2', 'min', 2)} SELECT y, x, b AS "on" FROM c2""")
def tiles_open_close(spark, sf_dir):
    """Opening by one pixel and closing by two, by one exchange of halos."""
    mask = _mask(spark, sf_dir).select("scene", "band", "y", "x", F.col("on").cast("double").alias("v"))
    steps = (("erode", 1), ("dilate", 1), ("dilate", 2), ("erode", 2))
    return tiles.untiled(tiles.morphology(tiles.tiled(mask, _EDGE), steps, edge=_EDGE), _EDGE).select("y", "x", (F.col("v") == 1).alias("on"))


@query(f"""WITH RECURSIVE {_MASK}, cells AS (SELECT y AS cy, x AS cx FROM mask WHERE b),
  walk AS (SELECT cy, cx, cy * 1000000 + cx AS label FROM cells UNION SELECT c.cy, c.cx, least(w.label, c.cy * 1000000 + c.cx) FROM walk w JOIN cells c ON abs(c.cy - w.cy) + abs(c.cx - w.cx) = 1),
  labelled AS (SELECT cy, cx, min(label) AS label FROM walk GROUP BY ALL)
SELECT label // 1000000 AS label_y, label % 1000000 AS label_x, count(*) AS cells, min(cx) AS x0, min(cy) AS y0, max(cx) + 1 AS x1, max(cy) + 1 AS y1 FROM labelled GROUP BY label""")
def tiles_components(spark, sf_dir):
    """Components at full resolution: joined in tiles first, then across their borders."""
    mask = _mask(spark, sf_dir).select("scene", "band", "y", "x", F.col("on").cast("double").alias("v"))
    labelled = tiles.components(tiles.tiled(mask, _EDGE), edge=_EDGE)
    return tiles.component_boxes(labelled, edge=_EDGE).select("label_y", "label_x", "cells", "x0", "y0", "x1", "y1")


@query("""SELECT quantile_cont(l_extendedprice, 0.02) AS p2, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.98) AS p98 FROM lineitem""")
def percentiles_whole(spark, sf_dir):
    """Percentiles of one group that holds all rows, by rank selection."""
    q = ranks.percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.02, 0.5, 0.98), most=1000)
    return q.select(*[F.col("q")[n].alias(name) for n, name in enumerate(("p2", "median", "p98"))])


@query("""SELECT label, quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.99) AS p99 FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label""")
def percentiles_by_label(spark, sf_dir):
    values = checkpoints.written(table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("v")), "values")
    q = ranks.percentiles(values, "v", (0.01, 0.25, 0.99), ("label",), most=200)
    return q.select("label", *[F.col("q")[n].alias(name) for n, name in enumerate(("p1", "p25", "p99"))])
