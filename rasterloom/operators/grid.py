"""Raster algebra over a pixel relation ``pixels(scene, band, y, x, v)``.

Every window is partitioned by scene, band and a row or a column; scalars of a scene
(percentiles, thresholds) are a row each and are joined back on the scene.  Grids are
dense; NaN is NULL from the source on, and invalid pixels carry NULL in ``v``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import text as T
from . import ranks
from .checkpoints import checkpointed, importable

PLANE = ("scene", "band")
#: Fixed values of the filters and thresholds.
EPS, LEE_CU, CHANGE_FLOOR, WEAK_SEPARABILITY, IMPLAUSIBLE = 1e-10, 0.523, 0.05, 0.40, 0.60


def pixels_of(matrix: DataFrame, row: str, values: str, scene: str = "s0", band: int = 0) -> DataFrame:
    """A table of arrays as a raster: the row's number is y, the place in the array x."""
    cells = matrix.select(F.col(row).cast("long").alias("y"), F.posexplode(values).alias("x", "v"))
    v = F.col("v").cast("double")
    return cells.select(F.lit(scene).alias("scene"), F.lit(band).alias("band"), "y", F.col("x").cast("long").alias("x"), F.when(~F.isnan(v), v).alias("v"))


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy(*PLANE).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))


def percentiles(pixels: DataFrame, shares: Sequence[float], names: Sequence[str], by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """``by`` and exact percentiles (linear interpolation) of each plane, found once; no row for planes without values.

    By rank selection: no task holds a plane's values.  ``pixels`` are read some three times.
    """
    found = ranks.percentiles(pixels, value, shares, by, most=1 << 18)
    return checkpointed(found.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)]))


def with_percentiles(pixels: DataFrame, shares: Sequence[float], names: Sequence[str], by: Sequence[str] = PLANE, value: str = "v") -> DataFrame:
    """Exact percentiles of each plane beside its pixels."""
    return pixels.join(F.broadcast(percentiles(pixels, shares, names, by, value)), list(by), "left")  # a row per plane


def stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """v as 0..255 between two percentiles; constant planes and missing pixels become 0."""
    ends = percentiles(pixels, (0.0, low, high, 1.0), ("least", "p", "q", "most"))
    flat = F.col("q") <= F.col("p")
    lo = F.when(flat, F.col("least")).otherwise(F.col("p"))
    hi = F.when(flat, F.when(F.col("most") > F.col("least"), F.col("most")).otherwise(F.col("least") + 1.0)).otherwise(F.col("q"))
    joined = pixels.join(F.broadcast(ends.select(*PLANE, lo.alias("lo"), hi.alias("hi"))), list(PLANE), "left")  # a row per plane
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    return joined.select(*PLANE, "y", "x", F.coalesce(F.rint(share * 255.0), F.lit(0.0)).cast("int").alias("v"))


def decibels(pixels: DataFrame, integer: bool = False) -> DataFrame:
    """Adds the conversion's ``label``; values below zero mean that it is in decibels already."""
    least = pixels.groupBy(*PLANE).agg(F.min("v").alias("least"))
    label = F.when(F.col("least") < 0, "already_db").otherwise("20log10" if integer else "10log10")
    converted = (20.0 if integer else 10.0) * F.log10(F.greatest(F.col("v"), F.lit(EPS)))
    raw = pixels.join(least, list(PLANE)).select(*PLANE, "y", "x", label.alias("label"), F.when(F.col("least") < 0, F.col("v")).otherwise(F.when(F.col("v").isNotNull(), converted)).alias("v"))
    ends = with_percentiles(raw, (0.01, 0.99), ("p1", "p99"))
    lo, hi = F.greatest(F.lit(-30.0), F.col("p1") - 5.0), F.least(F.lit(5.0), F.col("p99") + 5.0)
    lo, hi = F.when(hi <= lo, F.col("p1")).otherwise(lo), F.when(hi <= lo, F.greatest(F.col("p99"), F.col("p1") + 1.0)).otherwise(hi)
    return ends.select(*PLANE, "y", "x", "label", F.when(F.col("v").isNotNull(), F.least(F.greatest(F.col("v"), lo), hi)).alias("v"))


def _mirrored(pixels: DataFrame, axis: str, size: str, radius: int) -> DataFrame:
    """Rows again at their mirror places within ``radius`` of the edges (the edge itself isn't repeated)."""
    at, n = F.col(axis), F.col(size)
    places = F.filter(F.array(at, F.when((at >= 1) & (at <= radius), -at), F.when((at <= n - 2) & (at >= n - 1 - radius), 2 * (n - 1) - at)), lambda p: p.isNotNull())
    return pixels.withColumn("_at", F.explode(places))


def _along(pixels: DataFrame, axis: str, other: str, size: str, radius: int, values: Sequence[str], carry: Sequence[str]) -> DataFrame:
    frame = Window.partitionBy(*PLANE, other).orderBy("_at").rowsBetween(-radius, radius)
    moved = _mirrored(pixels, axis, size, radius).select(*PLANE, other, "_at", axis, "h", "w", *carry, *[F.sum(v).over(frame).alias(v) for v in values])
    return moved.where(F.col("_at") == F.col(axis)).drop("_at")


def sized(pixels: DataFrame) -> DataFrame:
    """Pixels with the height and width of their plane; as they are if they have them."""
    return pixels if {"h", "w"} <= set(pixels.columns) else pixels.join(sizes(pixels), list(PLANE))


def box_means(pixels: DataFrame, radius: int, values: Sequence[str] = ("v",), carry: Sequence[str] = ()) -> DataFrame:
    """Mean over (2r+1) squared pixels with reflected edges; two window sums, rows then columns.

    Columns to ``carry`` come along as they are (a pixel's own values beside its means: no join).
    """
    if radius < 1:
        return pixels.select(*PLANE, "y", "x", *values, *carry)
    whole = sized(pixels).select(*PLANE, "y", "x", "h", "w", *[c for c in carry if c not in ("h", "w")], *values)
    rest = [c for c in carry if c not in ("h", "w")]
    summed = _along(_along(whole, "x", "y", "w", radius, values, rest), "y", "x", "h", radius, values, rest)
    area = float((2 * radius + 1) ** 2)
    return summed.select(*PLANE, "y", "x", *[(F.col(v) / area).alias(v) for v in values], *carry)


def moments(pixels: DataFrame, radius: int, carry: Sequence[str] = ("v",)) -> DataFrame:
    """Local mean ``m`` and mean square ``s`` of v, beside the pixel's own columns."""
    return box_means(pixels.withColumns({"m": F.col("v"), "s": F.col("v") * F.col("v")}), radius, ("m", "s"), carry)


def lee(pixels: DataFrame, radius: int = 2, cu: float = LEE_CU) -> DataFrame:
    """Lee speckle filter on linear power."""
    var = F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0))
    ci2 = var / F.greatest(F.col("m") * F.col("m"), F.lit(EPS))
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - cu * cu / F.greatest(ci2, F.lit(EPS))))
    return moments(pixels, radius).select(*PLANE, "y", "x", (F.col("m") + weight * (F.col("v") - F.col("m"))).alias("v"))


def deviation() -> Column:
    """Local standard deviation from the columns of ``moments``."""
    return F.sqrt(F.greatest(F.col("s") - F.col("m") * F.col("m"), F.lit(0.0)))


def texture(pixels: DataFrame, radius: int = 2) -> DataFrame:
    """Local standard deviation."""
    return moments(pixels, radius).select(*PLANE, "y", "x", deviation().alias("v"))


def rgb_bands(count: Column, names: Column, interpretation: Column) -> Column:
    """1-based red, green and blue band: by colour interpretation, by band name, by count."""
    at = lambda items, wanted: F.array(*[F.array_position(items, F.lit(w)).cast("int") for w in wanted])
    full = lambda places: F.forall(places, lambda p: p > 0)
    by_color, by_name = at(interpretation, ("red", "green", "blue")), at(names, ("B04", "B03", "B02"))
    three = lambda a, b, c: F.array(F.lit(a), F.lit(b), F.lit(c))
    by_count = F.when(count == 3, three(1, 2, 3)).when(count == 4, three(3, 2, 1)).when(count == 10, three(3, 2, 1)).when(count == 12, three(4, 3, 2)).when(count == 13, three(4, 3, 2))
    return F.when(full(by_color), by_color).when(full(by_name), by_name).when(by_count.isNotNull(), by_count).when(count <= 2, F.array(F.lit(1))).otherwise(three(1, 2, 3))


def false_colour(co: DataFrame, cross: DataFrame) -> DataFrame:
    """R = co, G = cross, B = their difference around 128, from two stretched planes."""
    a = co.select("scene", "y", "x", F.col("v").cast("int").alias("r"))
    b = cross.select("scene", "y", "x", F.col("v").cast("int").alias("g"))
    return a.join(b, ["scene", "y", "x"]).withColumn("b", F.greatest(F.lit(0), F.least(F.lit(255), F.col("r") - F.col("g") + 128)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    """ITU-R 601 grey value in fixed point."""
    return F.shiftright(19595 * r.cast("int") + 38470 * g.cast("int") + 7471 * b.cast("int") + 32768, 16)


def radiometric_fit(reference: DataFrame, target: DataFrame) -> DataFrame:
    """Gain and offset per plane from the quartiles of both; a flat target keeps (1, 0)."""
    quarts = lambda d, n: percentiles(d, (0.25, 0.75), ("low", "high")).select(*PLANE, F.array("low", "high").alias(n))
    planes = reference.select(*PLANE).distinct().join(target.select(*PLANE).distinct(), list(PLANE))
    both = planes.join(quarts(reference, "r"), list(PLANE), "left").join(quarts(target, "t"), list(PLANE), "left")
    width = F.col("t")[1] - F.col("t")[0]
    gain = F.when(F.abs(width) < 1e-6, 1.0).otherwise((F.col("r")[1] - F.col("r")[0]) / width)
    return both.select(*PLANE, gain.alias("gain"), F.when(F.abs(width) < 1e-6, 0.0).otherwise(F.col("r")[0] - gain * F.col("t")[0]).alias("offset"))


def rounded_fit(fit: DataFrame) -> DataFrame:
    """The fit as reports show it."""
    return fit.select(*PLANE, F.round("gain", 5).alias("gain"), F.round("offset", 3).alias("offset"))


def radiometric_normalise(reference: DataFrame, target: DataFrame) -> DataFrame:
    fit = radiometric_fit(reference, target)
    v = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("v") * F.col("gain") + F.col("offset")))
    return target.join(fit, list(PLANE)).select(*PLANE, "y", "x", v.alias("v"))


def change_magnitude(first: DataFrame, second: DataFrame, smooth: int = 1, full_scale: float = 255.0) -> DataFrame:
    """Root mean square difference over the bands, as a share of full scale, smoothed."""
    other = second.select(*PLANE, "y", "x", F.col("v").alias("w"))
    diff = first.join(other, [*PLANE, "y", "x"]).groupBy("scene", "y", "x").agg(F.avg((F.col("v") - F.col("w")) * (F.col("v") - F.col("w"))).alias("m"))
    plane = diff.select("scene", F.lit(0).alias("band"), "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sqrt("m") / full_scale)).alias("v"))
    return box_means(plane, smooth)


def otsu(pixels: DataFrame, by: Sequence[str] = ("scene",), bins: int = 256) -> DataFrame:
    """threshold and separability per scene over a histogram of [0, 1]; the first best bin wins."""
    place = F.least(F.floor(F.col("v") * bins), F.lit(bins - 1)).cast("long")
    counted = pixels.where("v >= 0 and v <= 1").groupBy(*by, place.alias("bin")).agg(F.count("*").alias("n"))
    # Bins without pixels leave the running sums as they are, so their variance equals the
    # bin's before: the first of equals is never one of them (but for the bins before any pixel).
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    centre = (F.col("bin") + 0.5) / bins
    total = F.sum("n").over(whole)
    sums = counted.select(*by, "bin", "n", centre.alias("c"), (F.sum("n").over(upto) / total).alias("w"), (F.sum(F.col("n") * centre).over(upto) / total).alias("m"), (F.sum(F.col("n") * centre).over(whole) / total).alias("mt"), total.alias("total"))
    within = F.col("w") * (1 - F.col("w"))
    between = F.coalesce(F.when(within > 1e-15, F.pow(F.col("mt") * F.col("w") - F.col("m"), 2) / within), F.lit(0.0))
    spread = sums.withColumns({"sb": F.round(between, 12), "st": F.col("n") * F.pow(F.col("c") - F.col("mt"), 2) / F.col("total")})
    best = spread.groupBy(*by).agg(F.max_by("c", F.struct(F.col("sb"), -F.col("bin"))).alias("threshold"), F.max("sb").alias("sb"), F.sum("st").alias("st"))
    return best.select(*by, "threshold", F.when(F.col("st") <= 1e-12, 0.0).otherwise(F.col("sb") / F.col("st")).alias("separability"))


def change_mask(magnitude: DataFrame, floor: float = CHANGE_FLOOR) -> DataFrame:
    """Adds ``on``: above the larger of Otsu's threshold and the floor."""
    cut = otsu(magnitude).select("scene", F.greatest("threshold", F.lit(floor)).alias("cut"), "separability")
    return magnitude.join(cut, "scene").withColumn("on", F.col("v") > F.col("cut"))


def morphology(mask: DataFrame, chains: dict[str, Sequence[tuple[str, int]]], carry: Sequence[str] = ()) -> DataFrame:
    """A boolean column for each chain of equally many squares' erosions (``erode``) and dilations (``dilate``) of ``on``.

    Extremes along rows and along columns commute, so a step begins with the axis that the one
    before ended with: all chains together need one shuffle a step and one more.  Frames end at the border.
    """
    picks = {"erode": F.min, "dilate": F.max}
    out = mask.select(*PLANE, "y", "x", *carry, *[F.col("on").cast("int").alias(name) for name in chains])
    for n, steps in enumerate(zip(*chains.values(), strict=True)):
        for axis, other in (("x", "y"), ("y", "x"))[:: -1 if n % 2 else 1]:
            line = Window.partitionBy(*PLANE, other).orderBy(axis)
            out = out.withColumns({name: picks[step](name).over(line.rowsBetween(-r, r)) for name, (step, r) in zip(chains, steps, strict=True)})
    return out.select(*PLANE, "y", "x", *carry, *[(F.col(name) == 1).alias(name) for name in chains])


def erode(mask: DataFrame, radius: int = 1) -> DataFrame:
    return morphology(mask, {"on": (("erode", radius),)})


def dilate(mask: DataFrame, radius: int = 1) -> DataFrame:
    return morphology(mask, {"on": (("dilate", radius),)})


def opened(mask: DataFrame, radius: int = 1) -> DataFrame:
    return morphology(mask, {"on": (("erode", radius), ("dilate", radius))})


def closed(mask: DataFrame, radius: int = 1) -> DataFrame:
    return morphology(mask, {"on": (("dilate", radius), ("erode", radius))})


def pooled(mask: DataFrame, max_edge: int = 256) -> DataFrame:
    """Cells (scene, cy, cx, scale, w, h) with any pixel on, at most ``max_edge`` along an edge; cut-off rests go."""
    size = mask.groupBy("scene").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
    scale = F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest("h", "w") / max_edge).cast("long"))
    scale = F.when((F.floor(F.col("h") / scale) == 0) | (F.floor(F.col("w") / scale) == 0), F.lit(1).cast("long")).otherwise(scale)
    on = mask.where("on").join(size.select("scene", "h", "w", scale.alias("scale")), "scene")
    cells = on.select("scene", F.floor(F.col("y") / F.col("scale")).alias("cy"), F.floor(F.col("x") / F.col("scale")).alias("cx"), "scale", "w", "h")
    return cells.where((F.col("cy") < F.floor(F.col("h") / F.col("scale"))) & (F.col("cx") < F.floor(F.col("w") / F.col("scale")))).distinct()


def settled(labels: DataFrame, links: DataFrame, by: Sequence[str] = ("scene",), max_rounds: int = 64) -> DataFrame:
    """``labels(by, node, label)`` with the least label that ``links(by, u, v)``, both ways, lead to.

    Labels travel along links with pointer jumping; every round is checkpointed.
    """
    for _ in range(max_rounds):
        near = links.join(labels.select(*by, F.col("node").alias("v"), "label"), [*by, "v"]).groupBy(*by, F.col("u").alias("node")).agg(F.min("label").alias("low"))
        own = labels.join(near, [*by, "node"], "left").select(*by, "node", "label", F.least("label", F.coalesce("low", "label")).alias("low"))
        hooked = own.select(*by, "node", F.col("low").alias("label")).unionAll(own.where("low < label").select(*by, F.col("label").alias("node"), F.col("low").alias("label")))
        hooked = hooked.groupBy(*by, "node").agg(F.min("label").alias("label"))
        up = hooked.select(*by, F.col("node").alias("label"), F.col("label").alias("up"))
        after = checkpointed(hooked.join(up, [*by, "label"], "left").select(*by, "node", F.least("label", F.coalesce("up", "label")).alias("label")))
        moved = after.join(labels.select(*by, "node", F.col("label").alias("old")), [*by, "node"]).where("label <> old")
        labels = after
        if moved.isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def components(cells: DataFrame, max_rounds: int = 64, edge: int = 256) -> DataFrame:
    """Adds ``label``: the least cell (cy, cx) that is 4-connected with it.

    Cells are joined inside tiles of ``edge`` by ``edge`` first; only labels that meet at a tile's
    border are settled in rounds.
    """
    from .tiles import label_block  # tiles are made of this module's relation

    importable(cells.sparkSession)
    schema = StructType([*cells.schema, StructField("label", StructType([StructField("cy", LongType()), StructField("cx", LongType())]))])

    def label(tile: pa.Table) -> pa.Table:
        ys, xs = tile.column("cy").to_numpy(), tile.column("cx").to_numpy()
        on = np.zeros((ys.max() - ys.min() + 1, xs.max() - xs.min() + 1), bool)
        on[ys - ys.min(), xs - xs.min()] = True
        found = label_block(on, int(ys.min()), int(xs.min()), 1 << 31)[ys - ys.min(), xs - xs.min()]
        cell = pa.StructArray.from_arrays([pa.array(found >> 31), pa.array(found & ((1 << 31) - 1))], ["cy", "cx"])
        return tile.append_column("label", cell)

    ty, tx = F.floor(F.col("cy") / edge).alias("_ty"), F.floor(F.col("cx") / edge).alias("_tx")
    local = checkpointed(cells.groupBy("scene", ty, tx).applyInArrow(label, schema))
    sides = []
    for axis, dy, dx in (("cy", 1, 0), ("cx", 0, 1)):
        last = local.where(F.col(axis) % edge == edge - 1).select("scene", (F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx"), F.col("label").alias("u"))
        sides.append(last.join(local.where(F.col(axis) % edge == 0).select("scene", "cy", "cx", F.col("label").alias("v")), ["scene", "cy", "cx"]).select("scene", "u", "v"))
    links = sides[0].unionAll(sides[1]).distinct()
    links = checkpointed(links.unionAll(links.select("scene", F.col("v").alias("u"), F.col("u").alias("v"))))
    roots = settled(links.select("scene", F.col("u").alias("node"), F.col("u").alias("label")).distinct(), links, ("scene",), max_rounds)
    told = local.withColumnRenamed("label", "node").join(roots, ["scene", "node"], "left")
    return told.select(*cells.columns, F.coalesce("label", "node").alias("label"))


def regions(mask: DataFrame, min_fraction: float = 0.0005, most: int = 8, max_edge: int = 256) -> DataFrame:
    """Largest regions: box, area_px (all pixels on in the box), component cells, centroid, position.

    The order of regions of equal area is by their upper left corner.
    """
    mask = checkpointed(mask.select("scene", "y", "x", "on"))  # read for sizes, cells and areas
    labelled = components(pooled(mask, max_edge))
    scale = F.col("scale")
    found = labelled.groupBy("scene", "label", "scale", "w", "h").agg(F.min("cx").alias("a"), F.max("cx").alias("c"), F.min("cy").alias("b"), F.max("cy").alias("d"), F.count("*").alias("cells"), F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    boxes = found.select(
        "scene", "w", "h", "cells", (F.col("a") * scale).alias("x0"), (F.col("b") * scale).alias("y0"),
        F.least((F.col("c") + 1) * scale, "w").alias("x1"), F.least((F.col("d") + 1) * scale, "h").alias("y1"), F.floor(F.col("mx") * scale).alias("cx"), F.floor(F.col("my") * scale).alias("cy"),
    )
    # A box can't hold more pixels than it has: small ones go before any pixel is met.
    boxes = boxes.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) >= min_fraction * F.col("w") * F.col("h"))
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    # Counting by row and box first: the join's rows are those of a box, not its pixels.
    per_row = boxes.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1))).join(mask.where("on").select("scene", "y", "x"), ["scene", "y"]).where(inside)
    area = per_row.groupBy("scene", "x0", "y0", "x1", "y1", "cells", "w", "h", "cx", "cy").agg(F.count("*").alias("area_px"))
    share = F.col("area_px") / (F.col("w") * F.col("h"))
    ranked = area.withColumn("area_fraction", share).where(F.col("area_fraction") >= min_fraction).withColumn("rank", F.row_number().over(Window.partitionBy("scene").orderBy(F.desc("area_px"), "y0", "x0", "y1", "x1")))
    return ranked.where(F.col("rank") <= most).withColumn("direction", T.position_words(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"))).drop("w", "h")


def change_summary(masked: DataFrame, resized: Column | None = None) -> DataFrame:
    """changed_fraction, separability and the warnings they give, per scene; ``resized`` tells of images of two sizes."""
    out = masked.groupBy("scene").agg(F.avg(F.col("on").cast("int")).alias("changed_fraction"), F.max("separability").alias("separability"))
    told = F.when(F.lit(False) if resized is None else resized, "size_mismatch")
    notes = F.filter(F.array(told, F.when(F.col("separability") < WEAK_SEPARABILITY, "weak_separability"), F.when(F.col("changed_fraction") > IMPLAUSIBLE, "implausible_change")), lambda w: w.isNotNull())
    return out.withColumn("warnings", notes)


def detect_change(first: DataFrame, second: DataFrame, open_radius: int = 1, close_radius: int = 2, smooth: int = 1) -> DataFrame:
    """The mask (``on``, with separability) of what changed between two images on one grid.

    The magnitude is written once: the threshold and the mask read it again.
    """
    magnitude = checkpointed(change_magnitude(first, radiometric_normalise(first, second), smooth))
    cut = checkpointed(otsu(magnitude))
    raw = magnitude.join(cut.select("scene", F.greatest("threshold", F.lit(CHANGE_FLOOR)).alias("cut")), "scene").withColumn("on", F.col("v") > F.col("cut"))
    steps = (("erode", open_radius), ("dilate", open_radius), ("dilate", close_radius), ("erode", close_radius))
    return morphology(raw, {"on": steps}).join(cut.select("scene", "separability"), "scene")


def sar_classes(optical: DataFrame, sar: DataFrame, water: float = 0.15, built: float = 0.90, rough: float = 0.55, smooth: int = 1) -> DataFrame:
    """water, built_up and rejected per pixel: dark returns that aren't bright in the optical image, and bright rough ones.

    Radar, optical and texture travel as columns of one relation; it is written once, for the
    percentiles and the classes.
    """
    light = optical.select(*PLANE, "y", "x", F.col("v").alias("o"), F.lit(True).alias("lit"))
    both = sized(sar).select(*PLANE, "y", "x", "h", "w", "v").join(light, [*PLANE, "y", "x"], "left")
    grey = box_means(both, smooth, ("v",), ("o", "lit", "h", "w"))
    every = checkpointed(moments(grey, 2, ("v", "o", "lit")).where("lit").select(*PLANE, "y", "x", "v", "o", deviation().alias("t")))
    joined = every
    for value, shares, names in (("v", (water, built), ("wet", "tall")), ("t", (rough,), ("qt",)), ("o", (0.60,), ("qo",))):
        joined = joined.join(F.broadcast(percentiles(every, shares, names, value=value)), list(PLANE), "left")  # a row per plane
    dark, bright = F.col("v") <= F.col("wet"), F.col("o") > F.col("qo")
    return joined.select(*PLANE, "y", "x", (dark & ~bright).alias("water"), ((F.col("v") >= F.col("tall")) & (F.col("t") >= F.col("qt"))).alias("built_up"), (dark & bright).alias("rejected"))


def overlay(rgb: DataFrame, classes: DataFrame, alpha: float = 0.45) -> DataFrame:
    """Blue over water, then red over built-up, blended onto r, g, b columns."""
    joined = rgb.join(classes.select("scene", "y", "x", "water", "built_up"), ["scene", "y", "x"])

    def blended(name: str, blue: int, red: int) -> Column:
        base = F.col(name).cast("double")
        mix = lambda tint: F.floor(base * (1 - alpha) + tint * alpha).cast("int")
        return F.when(F.col("built_up"), mix(red)).when(F.col("water"), mix(blue)).otherwise(F.col(name).cast("int"))

    return joined.select("scene", "y", "x", blended("r", 0, 255).alias("r"), blended("g", 0, 0).alias("g"), blended("b", 255, 0).alias("b"))


def resample_bilinear(source: DataFrame, grid: DataFrame) -> DataFrame:
    """``source`` at the places ``grid(scene, y, x, sy, sx)`` asks for, in source pixels; null outside.

    Each place gathers its four neighbours by an equi-join and sums them with their weights.
    """
    fy, fx = F.floor("sy"), F.floor("sx")
    dy, dx = F.col("sy") - fy, F.col("sx") - fx
    corner = lambda a, b, w: F.struct((fy + a).alias("y0"), (fx + b).alias("x0"), w.alias("k"))
    four = F.filter(F.array(corner(0, 0, (1 - dy) * (1 - dx)), corner(0, 1, (1 - dy) * dx), corner(1, 0, dy * (1 - dx)), corner(1, 1, dy * dx)), lambda c: c["k"] > 0)
    wanted = grid.select("scene", "y", "x", F.explode(four).alias("c"))
    asked = wanted.select("scene", "y", "x", F.col("c.y0").alias("y0"), F.col("c.x0").alias("x0"), F.col("c.k").alias("k"))
    given = source.select("scene", "band", F.col("y").alias("y0"), F.col("x").alias("x0"), "v")
    met = asked.join(given, ["scene", "y0", "x0"])
    return met.groupBy("scene", "band", "y", "x").agg(F.when(F.sum("k") > 1 - 1e-9, F.sum(F.col("k") * F.col("v"))).alias("v"))


def _places(sizes_: DataFrame) -> DataFrame:
    """A row per pixel of each scene's ``h`` by ``w`` grid; rows of pixels are dealt before they are taken apart."""
    rows = sizes_.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h").cast("long") - 1))).repartition("scene", "y")
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w").cast("long") - 1)))


def grid_map(pairs: DataFrame) -> DataFrame:
    """``grid(scene, y, x, sy, sx)``: where each pixel centre of image a lies in image b, both north-up in one system.

    ``pairs(scene, a_h, a_w, a_x0, a_y1, a_rx, a_ry, b_x0, b_y1, b_rx, b_ry)``: upper left corners and resolutions.
    """
    at = _places(pairs.withColumns({"h": F.col("a_h"), "w": F.col("a_w")}))
    east, north = F.col("a_x0") + (F.col("x") + 0.5) * F.col("a_rx"), F.col("a_y1") - (F.col("y") + 0.5) * F.col("a_ry")
    return at.select("scene", "y", "x", ((F.col("b_y1") - north) / F.col("b_ry") - 0.5).alias("sy"), ((east - F.col("b_x0")) / F.col("b_rx") - 0.5).alias("sx"))


def resize_map(pairs: DataFrame) -> DataFrame:
    """``grid`` of a plain resize of b to a's size; places beyond the edge centres are held at the edge."""
    at = _places(pairs.withColumns({"h": F.col("a_h"), "w": F.col("a_w")}))
    held = lambda place, n: F.greatest(F.lit(0.0), F.least(place, n - 1.0))
    scaled = lambda axis, n: held((F.col(axis) + 0.5) * F.col(f"b_{n}") / F.col(f"a_{n}") - 0.5, F.col(f"b_{n}"))
    return at.select("scene", "y", "x", scaled("y", "h").alias("sy"), scaled("x", "w").alias("sx"))


def _weights(pairs: DataFrame, given: str, wanted: str) -> DataFrame:
    """scene, at, out, k: what pixel ``at`` of an axis gives to pixel ``out``, by a triangle as wide as the pixels of the coarser side."""
    scale = F.col(given) / F.col(wanted)
    wide = F.greatest(scale, F.lit(1.0))
    rows = pairs.select("scene", F.col(given).alias("_n"), scale.alias("_s"), wide.alias("_w"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(wanted).cast("long") - 1)).alias("out"))
    centre = (F.col("out") + 0.5) * F.col("_s")
    first = F.greatest(F.lit(0).cast("long"), F.floor(centre - F.col("_w") + 0.5))
    last = F.least(F.col("_n").cast("long"), F.floor(centre + F.col("_w") + 0.5)) - 1
    near = F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("at"), F.greatest(F.lit(0.0), 1 - F.abs((i + 0.5 - centre) / F.col("_w"))).alias("k")))
    total = F.aggregate(near, F.lit(0.0), lambda n, c: n + c["k"])
    return rows.select("scene", "out", total.alias("_t"), F.explode(near).alias("c")).select("scene", F.col("c.at").alias("at"), "out", (F.col("c.k") / F.col("_t")).alias("k")).where("k > 0")


def resize(source: DataFrame, pairs: DataFrame, whole: bool = True) -> DataFrame:
    """``source`` in other sizes, each output pixel the weighted mean of all that it covers: no aliasing when shrinking.

    ``pairs(scene, a_h, a_w, b_h, b_w)``: to the size of a, from that of b.  Rows first, then columns;
    an input pixel gives to about two output pixels of an axis, so both joins are small.  ``whole``
    rounds after each pass, as 8-bit images do.  A missing pixel makes what it gives to missing.
    """
    rounded = lambda v: F.floor(v + 0.5).cast("double") if whole else v
    gathered = F.when(F.count("*") == F.count("v"), rounded(F.sum(F.col("k") * F.col("v")))).alias("v")
    rows = source.select(*PLANE, "y", F.col("x").alias("at"), "v").join(_weights(pairs, "b_w", "a_w"), ["scene", "at"]).groupBy(*PLANE, "y", F.col("out").alias("x")).agg(gathered)
    return rows.select(*PLANE, F.col("y").alias("at"), "x", "v").join(_weights(pairs, "b_h", "a_h"), ["scene", "at"]).groupBy(*PLANE, F.col("out").alias("y"), "x").agg(gathered)
