"""Box, canvas and footprint expressions.  A box is four columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

Box = tuple[Column, Column, Column, Column]

#: Location tokens of the detection vocabulary.  Fixed value.
LOC_BINS = 1024


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where they don't overlap or the union is empty."""
    width = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def overlap_share(a: Box, b: Box) -> Column:
    """Intersection as a share of the smaller rectangle (left, bottom, right, top)."""
    left, bottom = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    right, top = F.least(a[2], b[2]), F.least(a[3], b[3])
    inter = (right - left) * (top - bottom)
    smaller = F.least(F.abs((a[2] - a[0]) * (a[3] - a[1])), F.abs((b[2] - b[0]) * (b[3] - b[1])))
    return F.when((right <= left) | (top <= bottom) | (smaller <= 0), 0.0).otherwise(inter / smaller)


def letterbox(w: Column, h: Column, size: int = 224) -> dict[str, Column]:
    """scale, dx, dy, new_w, new_h of an image fitted into a square canvas."""
    bad = (w <= 0) | (h <= 0)
    scale = F.when(bad, 1.0).otherwise(F.least(size / w, size / h))
    new_w = F.when(bad, size).otherwise(F.greatest(F.lit(1), F.rint(w * scale).cast("int")))
    new_h = F.when(bad, size).otherwise(F.greatest(F.lit(1), F.rint(h * scale).cast("int")))
    return {"scale": scale, "dx": F.floor((size - new_w) / 2).cast("int"), "dy": F.floor((size - new_h) / 2).cast("int"), "new_w": new_w, "new_h": new_h}


def to_canvas(box: Box, w: Column, h: Column, size: int = 224) -> Box:
    fit = letterbox(w, h, size)
    return tuple(v * fit["scale"] + fit["dx" if i % 2 == 0 else "dy"] for i, v in enumerate(box))  # type: ignore[return-value]


def from_canvas(box: Box, w: Column, h: Column, size: int = 224) -> Box:
    """Back to image pixels, held within the image."""
    fit = letterbox(w, h, size)

    def back(i: int, v: Column) -> Column:
        limit = w if i % 2 == 0 else h
        return F.greatest(F.lit(0.0), F.least((v - fit["dx" if i % 2 == 0 else "dy"]) / fit["scale"], limit.cast("double")))

    return tuple(back(i, v) for i, v in enumerate(box))  # type: ignore[return-value]


def encode_tokens(box: Box, size: int = 224) -> Column:
    """Four location tokens: y0 x0 y1 x1, inverted boxes put right."""

    def token(v: Column) -> Column:
        bin_ = F.greatest(F.lit(0), F.least(F.lit(LOC_BINS - 1), F.rint(v / float(size) * (LOC_BINS - 1)).cast("int")))
        return F.concat(F.lit("<loc"), F.lpad(bin_.cast("string"), 4, "0"), F.lit(">"))

    x0, y0, x1, y1 = box
    return F.concat(token(F.least(y0, y1)), token(F.least(x0, x1)), token(F.greatest(y0, y1)), token(F.greatest(x0, x1)))


def decode_tokens(text: Column, size: int = 224) -> Column:
    """array<struct<x0,y0,x1,y1,label>> of the detections in a text; parts of under four tokens go."""
    scale = size / float(LOC_BINS - 1)

    def one(part: Column) -> Column:
        found = F.regexp_extract_all(part, F.lit(r"<loc(\d{4})>"), F.lit(1))
        value = lambda i: F.try_element_at(found, F.lit(i)).cast("int") * scale
        label = strip(F.regexp_replace(part, r"<loc\d{4}>", ""))
        return F.struct(F.size(found).alias("n"), value(2).alias("x0"), value(1).alias("y0"), value(4).alias("x1"), value(3).alias("y1"), F.when(label == "", "region").otherwise(label).alias("label"))

    found = F.filter(F.transform(F.split(text, ";"), one), lambda d: d["n"] >= 4)
    return F.transform(found, lambda d: d.dropFields("n"))


def detect_suffix(boxes: Column, labels: Column, size: int = 224) -> Column:
    """Training target: tokens and label of each detection, joined."""
    parts = F.zip_with(boxes, labels, lambda b, name: F.concat(encode_tokens((b["x0"], b["y0"], b["x1"], b["y1"]), size), F.lit(" "), F.regexp_replace(strip(name), r"\.+$", "")))
    return F.array_join(parts, " ; ")


def convention(highest: Column) -> tuple[Column, Column]:
    """Name and divisor of the unit that boxes are in, from the largest coordinate."""
    name = F.when(highest.isNull(), "unknown").when(highest <= 1.5, "normalised_0_1").when(highest <= 100.5, "percent_0_100").when(highest <= 1000.5, "per_mille_0_999").otherwise("absolute_pixels")
    divisor = F.when(highest <= 1.5, 1.0).when(highest <= 100.5, 100.0).when(highest <= 1000.5, 999.0)
    return name, divisor


def to_pixels(box: Box, divisor: Column, w: Column, h: Column) -> Box:
    """Relative boxes to pixels of their image; a null divisor leaves them."""
    return tuple(F.when(divisor.isNull(), v).otherwise(v / divisor * (w if i % 2 == 0 else h)) for i, v in enumerate(box))  # type: ignore[return-value]


def area_fraction(box: Box, w: Column, h: Column) -> Column:
    area = F.greatest(F.lit(0.0), box[2] - box[0]) * F.greatest(F.lit(0.0), box[3] - box[1])
    return F.when(w * h > 0, area / (w * h)).otherwise(0.0)


def lonlat_ring(box: Box, left: Column, top: Column, px: Column, py: Column) -> Column:
    """Closed ring of a pixel box under a north-up affine grid (already in degrees)."""
    point = lambda x, y: F.array(left + x * px, top - y * py)
    x0, y0, x1, y1 = box
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0))


def cell_level(box: Box, edge: float) -> Column:
    """The least level whose cells (``edge`` doubled as often) are as wide and high as the rectangle."""
    longest = F.greatest(box[2] - box[0], box[3] - box[1])
    guess = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(longest / edge, F.lit(1e-300)))).cast("int"))
    return F.when(edge * F.pow(F.lit(2.0), guess) < longest, guess + 1).otherwise(guess)  # a logarithm may round down


def cells_at(box: Box, edge: float, level: Column) -> Column:
    """The cells of a level that a rectangle no larger than them touches: four at most."""
    size = edge * F.pow(F.lit(2.0), level)
    span = lambda a, b: F.sequence(F.floor(a / size), F.floor(b / size))
    return F.flatten(F.transform(span(box[0], box[2]), lambda x: F.transform(span(box[1], box[3]), lambda y: F.struct(level.alias("level"), x.alias("cx"), y.alias("cy")))))
