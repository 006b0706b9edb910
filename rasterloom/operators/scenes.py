"""Scene catalogue: metadata checks, footprint joins and co-registration of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import projections as P

#: Raster formats that are accepted.  Fixed values.
DRIVERS = ("GTiff", "COG", "PNG", "JPEG", "BMP", "GIF")
MIN_OVERLAP, TOLERANCE_PX, RESOLUTION_RTOL = 0.60, 1.0, 0.02


def is_valid(scenes: DataFrame) -> Column:
    return F.col("error").isNull() & F.col("driver").isin(*DRIVERS)


def footprint_pairs(left: DataFrame, right: DataFrame, edge: float, least: float = MIN_OVERLAP) -> DataFrame:
    """left_id, right_id, overlap of rectangles (id, x0, y0, x1, y1) that overlap by ``least`` of the smaller one."""
    box = lambda tag: tuple(F.col(f"{tag}_{c}") for c in ("x0", "y0", "x1", "y1"))
    met = footprints_met(left, right, edge, least).select("left_id", "right_id", B.overlap_share(box("left"), box("right")).alias("overlap"))
    return met.where((F.col("overlap") >= least) & (F.col("overlap") > 0))


def footprints_met(left: DataFrame, right: DataFrame, edge: float, least: float = MIN_OVERLAP) -> DataFrame:
    """The pairs that ``footprint_pairs`` measures, each once, among them all that overlap by ``least``.

    More than half of the smaller one's area is more than half of its width and height, so its centre
    lies in the larger one: the smaller one is dealt to the cell of its centre, the larger one
    to the cells that it touches, a quarter as wide as its level's (25 at most), and no pair comes twice.

    By half and less, a rectangle lies in the cells of the grid level of its own size, four at most; a pair meets
    at the coarser of its two levels.  So each rectangle is dealt to its own level and, to meet
    coarser ones, to the levels above it that the other side has (some dozens at most).  A pair is
    kept only in the cell of its intersection's lower left corner, so none comes twice and no
    distinct is needed.
    """
    corners = ("x0", "y0", "x1", "y1")

    def sized(side: DataFrame, tag: str) -> DataFrame:
        named = side.select(F.col("id").alias(f"{tag}_id"), *[F.col(c).alias(f"{tag}_{c}") for c in corners])
        named = named.where((F.col(f"{tag}_x0") < F.col(f"{tag}_x1")) & (F.col(f"{tag}_y0") < F.col(f"{tag}_y1")))
        return named.withColumn(f"{tag}_level", B.cell_level(box(tag), edge)).where(F.col(f"{tag}_level").isNotNull())

    def box(tag: str) -> tuple:
        return tuple(F.col(f"{tag}_{c}") for c in corners)

    def area(tag: str) -> Column:
        return (F.col(f"{tag}_x1") - F.col(f"{tag}_x0")) * (F.col(f"{tag}_y1") - F.col(f"{tag}_y0"))

    def dealt(side: DataFrame, tag: str, level: Column) -> DataFrame:
        return side.withColumn("_level", level).withColumn("cell", F.explode(B.cells_at(box(tag), edge, F.col("_level")))).drop("_level")

    def met(coarse: DataFrame, other: DataFrame, coarse_tag: str, tag: str, strictly: bool) -> DataFrame:
        """Pairs at the level of ``coarse``; the other side's rectangles are no larger (or smaller)."""
        levels = [r[0] for r in coarse.select(f"{coarse_tag}_level").distinct().collect()]  # a level per doubling: dozens
        above = F.filter(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"), lambda n: n > F.col(f"{tag}_level") if strictly else n >= F.col(f"{tag}_level"))
        return dealt(coarse, coarse_tag, F.col(f"{coarse_tag}_level")).join(dealt(other, tag, F.explode(above)), "cell")

    def centred(large: DataFrame, other: DataFrame, large_tag: str, tag: str, strictly: bool) -> DataFrame:
        """Pairs whose ``other`` has the smaller area (or an equal one) and its centre in a cell that ``large`` touches."""
        levels = large.groupBy(f"{large_tag}_level").agg(F.max(area(large_tag))).collect()  # a level per doubling: dozens
        fits = [F.when(F.lit(most) > area(tag) if strictly else F.lit(most) >= area(tag), F.lit(level)) for level, most in levels]
        middle = [F.col(f"{tag}_{k}0") / 2 + F.col(f"{tag}_{k}1") / 2 for k in "xy"]
        spread = large.withColumn("cell", F.explode(B.cells_at(box(large_tag), edge / 4, F.col(f"{large_tag}_level"))))
        place = other.withColumn("level", F.explode(F.array_compact(F.array(*fits)) if fits else F.array().cast("array<int>")))
        size = edge / 4 * F.pow(F.lit(2.0), F.col("level"))
        place = place.withColumns({"cx": F.floor(middle[0] / size), "cy": F.floor(middle[1] / size)})
        # Shuffled by cells even if one side is small: a broadcast would leave all pairs to the few tasks that read the other.
        both = spread.select("*", "cell.level", "cell.cx", "cell.cy").drop("cell").join(place.hint("merge"), ["level", "cx", "cy"])
        return both.where(area(tag) < area(large_tag) if strictly else area(tag) <= area(large_tag))

    a, b = sized(left, "left"), sized(right, "right")
    if least > 0.5 + 1e-6:
        both = centred(b, a, "right", "left", False).unionByName(centred(a, b, "left", "right", True))
    else:
        both = met(a, b, "left", "right", False).unionByName(met(b, a, "right", "left", True))
        size = edge * F.pow(F.lit(2.0), F.col("cell.level"))
        both = both.where((F.col("cell.cx") == F.floor(F.greatest("left_x0", "right_x0") / size)) & (F.col("cell.cy") == F.floor(F.greatest("left_y0", "right_y0") / size)))
    return both.select(*[f"{tag}_{c}" for tag in ("left", "right") for c in ("id", *corners)])


def coregister(pairs: DataFrame) -> DataFrame:
    """Adds status, ok_to_proceed, requires_resampling, overlap and pixel offsets.

    Each side ``a_``/``b_``: valid, crs (null: not georeferenced), w, h, x0, y0, x1, y1, rx, ry.
    A pair in two known reference systems (longitude and latitude, web or transverse Mercator) is
    compared in a's: b's bounds are those of its densified edges there.  One that can't be
    transformed ends as no_overlap.
    """
    c = F.col
    given = pairs.columns
    moved = P.bounds(c("b_crs"), c("a_crs"), tuple(c(f"b_{k}") for k in ("x0", "y0", "x1", "y1")))
    pairs = pairs.withColumn("_moved", F.when(c("a_crs") != c("b_crs"), moved))
    failed = (c("a_crs") != c("b_crs")) & c("_moved").isNull()  # its measures are those of the plain numbers
    pairs = pairs.withColumns({f"b_{k}": F.coalesce(c(f"_moved.{k}"), c(f"b_{k}")) for k in ("x0", "y0", "x1", "y1")} | {f"_b_{k}": c(f"b_{k}") for k in ("x0", "y0", "x1", "y1")})
    box = lambda t: tuple(c(f"{t}_{k}") for k in ("x0", "y0", "x1", "y1"))
    same_dims = (c("a_w") == c("b_w")) & (c("a_h") == c("b_h"))
    overlap = B.overlap_share(box("a"), box("b"))
    px = F.when(F.abs("a_rx") == 0, 1.0).otherwise(F.abs("a_rx"))
    py = F.when(F.abs("a_ry") == 0, 1.0).otherwise(F.abs("a_ry"))
    same_res = (F.abs(F.abs("a_rx") - F.abs("b_rx")) <= RESOLUTION_RTOL * px) & (F.abs(F.abs("a_ry") - F.abs("b_ry")) <= RESOLUTION_RTOL * py)
    dx = F.greatest(F.abs(c("a_x0") - c("b_x0")), F.abs(c("a_x1") - c("b_x1"))) / px
    dy = F.greatest(F.abs(c("a_y0") - c("b_y0")), F.abs(c("a_y1") - c("b_y1"))) / py
    located = c("a_crs").isNotNull() & c("b_crs").isNotNull()
    status = (
        F.when(~(c("a_valid") & c("b_valid")), "unreadable")
        .when(~located & same_dims, "not_georeferenced")
        .when(~located, "dimension_mismatch")
        .when(failed | (overlap < MIN_OVERLAP), "no_overlap")
        .when(same_dims & same_res & (dx < 1e-6) & (dy < 1e-6), "identical_grid")
        .when(same_res & (dx <= TOLERANCE_PX) & (dy <= TOLERANCE_PX), "aligned_within_tolerance")
        .otherwise("resampling_required")
    )
    out = pairs.withColumns({"status": status, "overlap": F.when(located, overlap), "dx_px": F.when(located, dx), "dy_px": F.when(located, dy)})
    out = out.withColumns({f"b_{k}": c(f"_b_{k}") for k in ("x0", "y0", "x1", "y1")}).select(*given, "status", "overlap", "dx_px", "dy_px")
    return out.withColumns({
        "ok_to_proceed": ~c("status").isin("unreadable", "no_overlap"),
        "verified": c("status").isin("identical_grid", "aligned_within_tolerance"),
        "requires_resampling": c("status").isin("dimension_mismatch", "resampling_required") | ((c("status") == "aligned_within_tolerance") & ~same_dims),
    })
