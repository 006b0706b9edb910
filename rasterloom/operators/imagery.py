"""Whole-image steps over the pixel relation: display renders, alignment decisions, composites, detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes as B
from . import grid as G
from .checkpoints import checkpointed

#: Largest share of the frame that a detection may cover, and how many are kept.  Fixed values.
MAX_BOX_FRACTION, TOP_K, BOX_THRESHOLD = 0.92, 8, 0.25


def as_rgb(pixels: DataFrame, bands: Sequence[int]) -> DataFrame:
    """scene, y, x, r, g, b of three bands (or one, three times), each stretched by itself."""
    chosen = list(bands) if len(bands) == 3 else [bands[0]] * 3
    plane = G.stretch(pixels.where(F.col("band").isin(*set(chosen))))
    return plane.groupBy("scene", "y", "x").agg(*[F.max(F.when(F.col("band") == b, F.col("v"))).alias(c) for b, c in zip(chosen, "rgb", strict=True)])


def render_sar(pixels: DataFrame, radius: int = 2, integer: bool = False) -> DataFrame:
    """Speckle filter on linear power, then decibels, then the stretch."""
    return G.stretch(checkpointed(G.decibels(checkpointed(G.lee(pixels, radius)), integer).drop("label")))


def sar_bands(count: Column) -> Column:
    """One band is shown grey; of more, the first two."""
    return F.when(count == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))


def stack_layout(d0: Column, d1: Column, d2: Column) -> Column:
    """Whether an image array has its bands first or last: the smallest outer dimension of few."""
    return F.when((d0 <= 16) & (d0 < d2), "chw").when((d2 <= 16) & (d2 < d0), "hwc").otherwise(F.when(d0 <= d2, "chw").otherwise("hwc"))


def column_layout(columns: Sequence[str]) -> str:
    """per_band where the optical and radar bands are columns, stacked where two arrays are."""
    names = {c.lower() for c in columns}
    if {"b04", "b03", "b02", "vv", "vh"} <= names:
        return "per_band"
    if {"s2", "s1"} <= names:
        return "stacked"
    raise ValueError(f"neither bands nor stacks among {sorted(columns)}")


def alignment(a_crs: Column, b_crs: Column, same_grid: Column, same_size: Column) -> tuple[Column, Column]:
    """How the second image is brought onto the first one's grid, and the warning that goes with it.

    Two reference systems would need a projection library: such a pair is resized, as a failed reprojection is.
    """
    both = a_crs.isNotNull() & b_crs.isNotNull()
    plain = F.when(same_size, "identical_grid").otherwise("pixel_resize")
    method = F.when(both & ~same_grid & (a_crs == b_crs), "reproject_to_reference_grid").otherwise(plain)
    return method, F.when(both & (a_crs != b_crs), "reprojection_failed")


def align_pairs(images: DataFrame, pairs: DataFrame) -> DataFrame:
    """scene, band, y, x, v of each second image on its first one's grid, and the method.

    ``images(scene, band, y, x, v)`` are the second ones; ``pairs(scene, a_crs, b_crs, a_h, a_w, a_x0, a_y1,
    a_rx, a_ry, b_...)`` has a row a scene.
    """
    c = F.col
    same_size = (c("a_h") == c("b_h")) & (c("a_w") == c("b_w"))
    same_grid = same_size & (c("a_crs") == c("b_crs"))
    for k in ("x0", "y1", "rx", "ry"):
        same_grid = same_grid & (c(f"a_{k}") == c(f"b_{k}"))
    method, warning = alignment(c("a_crs"), c("b_crs"), F.coalesce(same_grid, F.lit(False)), same_size)
    told = checkpointed(pairs.withColumns({"method": method, "warning": warning}))
    moved = G.grid_map(told.where("method = 'reproject_to_reference_grid'")).unionByName(G.resize_map(told.where("method = 'pixel_resize'")))
    kept = images.join(told.where("method = 'identical_grid'").select("scene"), "scene", "left_semi").select("scene", "band", "y", "x", "v")
    placed = G.resample_bilinear(images, moved).unionByName(kept)
    return placed.join(told.select("scene", "method", "warning"), "scene")


def fit_into(image: DataFrame, cell: int, shift: int = 0, padding: float = 128.0) -> DataFrame:
    """An image letterboxed into a square cell by nearest pixels: scene, cy, cx, v; the rest is padding."""
    size = image.groupBy("scene").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    fit = B.letterbox(F.col("w"), F.col("h"), cell)
    upto = F.explode(F.sequence(F.lit(0), F.lit(cell - 1)))
    canvas = size.select("scene", "w", "h", *[c.alias(n) for n, c in fit.items()]).withColumn("cy", upto).withColumn("cx", upto)
    inside = (F.col("cx") >= F.col("dx")) & (F.col("cx") < F.col("dx") + F.col("new_w")) & (F.col("cy") >= F.col("dy")) & (F.col("cy") < F.col("dy") + F.col("new_h"))
    source = lambda at, d, new, n: F.when(inside, F.floor((F.col(at) - F.col(d) + 0.5) * F.col(n) / F.col(new)))
    asked = canvas.select("scene", "cy", (F.col("cx") + shift).alias("cx"), source("cy", "dy", "new_h", "h").alias("y"), source("cx", "dx", "new_w", "w").alias("x"))
    return asked.join(image.select("scene", "y", "x", "v"), ["scene", "y", "x"], "left").select("scene", "cy", "cx", F.coalesce("v", F.lit(padding)).alias("v"))


def pair_composite(left: DataFrame, right: DataFrame, cell: int = 224) -> DataFrame:
    """Two images side by side on one canvas, each letterboxed into its half; ``side`` tells which."""
    return fit_into(left, cell).withColumn("side", F.lit(0)).unionByName(fit_into(right, cell, cell).withColumn("side", F.lit(1)))


def kept_detections(detections: DataFrame, image: str, threshold: float = BOX_THRESHOLD, most: int = TOP_K) -> DataFrame:
    """Detections above the threshold, not empty and not the whole frame; the best ``most`` of an image, ranked.

    ``detections(image, x0, y0, x1, y1, w, h, score)``; ties go to the upper left.
    """
    share = B.area_fraction((F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")), F.col("w"), F.col("h"))
    good = detections.withColumn("area_fraction", share).where((F.col("score") >= threshold) & (F.col("area_fraction") > 0) & (F.col("area_fraction") <= MAX_BOX_FRACTION))
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy(image).orderBy(F.desc("score"), "y0", "x0", "y1", "x1")))
    return ranked.where(F.col("rank") <= most)


def task_records(**tables: DataFrame) -> DataFrame:
    """Tables of different tasks as one: kind, key, images, question, answer; missing parts are null."""
    out = None
    for kind, rows in tables.items():
        one = rows.withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def change_text(fraction: Column, regions: Column, position: Column) -> Column:
    """One sentence on how much changed and where most of it lies."""
    percent = F.format_string("%.1f%%", fraction * 100)
    return F.when(fraction < 0.005, "No significant change between the two images.").otherwise(F.concat(percent, F.lit(" of the area changed in "), regions.cast("string"), F.lit(" regions; the largest lies in the "), position, F.lit(" part.")))


def sar_text(water: Column, built: Column) -> Column:
    percent = lambda c: F.format_string("%.1f%%", c * 100)
    wet = F.when(water >= 0.005, F.concat(F.lit("water-covered regions occupy "), percent(water), F.lit(" of the scene"))).otherwise("no significant open water detected")
    dry = F.when(built >= 0.005, F.concat(F.lit("built-up regions occupy "), percent(built))).otherwise("no significant built-up signature detected")
    return F.concat(wet, F.lit("; "), dry)
