"""Raster algebra on tiles: ``tiles(scene, band, ty, tx, h, w, block)``.

A block holds ``edge`` by ``edge`` pixels (fewer at the right and the bottom) as doubles, missing
ones as NaN; h and w are the plane's size.  A neighbourhood operator sends each tile once and
its edges of ``radius`` pixels to the neighbours: some 8 bytes a pixel through one shuffle, where
the window forms of ``grid`` send a row of keys, sizes and values a pixel through two.  A task
holds one tile with its halo, so planes have no size limit; ``edge`` has to be at least ``radius``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid as G
from .checkpoints import checkpointed, importable, written
from .grid import EPS, LEE_CU, PLANE

_TILE = "scene string, band int, ty long, tx long, h long, w long, block binary"
_PIECE = "scene string, band int, ty long, tx long, h long, w long, dy int, dx int, block binary"
_KEY = ("scene", "band", "ty", "tx")


def _batch(schema: str, columns: dict[str, list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_pydict({name: pa.array(columns[name], kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))})


def _shape(row: dict, edge: int) -> tuple[int, int]:
    return min(edge, row["h"] - row["ty"] * edge), min(edge, row["w"] - row["tx"] * edge)


def _block(row: dict, edge: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(row["block"], kind).reshape(_shape(row, edge))


def tiled(pixels: DataFrame, edge: int = 256) -> DataFrame:
    """Tiles of a pixel relation."""
    importable(pixels.sparkSession)
    rows = G.sized(pixels).select(*PLANE, F.expr(f"y div {edge}").alias("ty"), F.expr(f"x div {edge}").alias("tx"), "h", "w", "y", "x", F.col("v").cast("double").alias("v"))

    def pack(group: pa.Table) -> pa.Table:
        row = {name: group.column(name)[0].as_py() for name in (*_KEY, "h", "w")}
        block = np.full(_shape(row, edge), np.nan)
        block[group.column("y").to_numpy() % edge, group.column("x").to_numpy() % edge] = group.column("v").to_numpy()
        return pa.Table.from_batches([_batch(_TILE, {k: [v] for k, v in row.items()} | {"block": [block.astype("<f8").tobytes()]})])

    return rows.groupBy(*_KEY).applyInArrow(pack, _TILE)


def untiled(tiles: DataFrame, edge: int = 256) -> DataFrame:
    """The pixel relation of tiles."""

    def burst(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row, edge)
                ys, xs = np.indices(block.shape)
                yield pa.RecordBatch.from_pydict({
                    "scene": [row["scene"]] * block.size, "band": pa.array(np.full(block.size, row["band"], np.int32)), "y": pa.array(ys.ravel() + row["ty"] * edge), "x": pa.array(xs.ravel() + row["tx"] * edge),
                    "v": pa.array(block.ravel(), from_pandas=True),
                })

    return tiles.mapInArrow(burst, "scene string, band int, y long, x long, v double")


# ---- neighbourhoods ----------------------------------------------------------------------------


def _pieces(row: dict, edge: int, radius: int) -> Iterator[dict]:
    """The tile for itself and its edges for its neighbours; (dy, dx) is where a piece comes from."""
    block, last_y, last_x = _block(row, edge), -(-row["h"] // edge) - 1, -(-row["w"] // edge) - 1
    cut = {-1: slice(None, radius), 0: slice(None), 1: slice(-radius, None)}
    for to_y in (-1, 0, 1):
        for to_x in (-1, 0, 1):
            ty, tx = row["ty"] + to_y, row["tx"] + to_x
            if 0 <= ty <= last_y and 0 <= tx <= last_x:
                yield row | {"ty": ty, "tx": tx, "dy": -to_y, "dx": -to_x, "block": np.ascontiguousarray(block[cut[to_y], cut[to_x]]).tobytes()}


def _assembled(pieces: list[dict], edge: int, radius: int, reflect: bool) -> np.ndarray:
    """The tile with ``radius`` pixels around it: its neighbours' edges, beyond the plane reflected ones or none."""
    own = next(p for p in pieces if not (p["dy"] or p["dx"]))
    bh, bw = _shape(own, edge)
    y0, x0 = own["ty"] * edge, own["tx"] * edge
    top, left = min(radius, y0), min(radius, x0)
    bottom, right = min(radius, own["h"] - y0 - bh), min(radius, own["w"] - x0 - bw)
    canvas = np.full((top + bh + bottom, left + bw + right), np.nan)
    rows = {-1: slice(0, top), 0: slice(top, top + bh), 1: slice(top + bh, None)}
    columns = {-1: slice(0, left), 0: slice(left, left + bw), 1: slice(left + bw, None)}
    for p in pieces:
        place = canvas[rows[p["dy"]], columns[p["dx"]]]
        place[:] = np.frombuffer(p["block"], "<f8").reshape(place.shape)
    beyond = ((radius - top, radius - bottom), (radius - left, radius - right))
    return np.pad(canvas, beyond, mode="reflect") if reflect else np.pad(canvas, beyond, constant_values=np.nan)


def mapped(tiles: DataFrame, kernel: Callable[[np.ndarray, int], np.ndarray], radius: int, *, edge: int = 256, reflect: bool = True) -> DataFrame:
    """``kernel(block with its halo, radius)`` of every tile, which gives the block without the halo."""
    if radius > edge:
        raise ValueError("a halo comes from the next tile only: the edge has to be at least the radius")
    importable(tiles.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _PIECE.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                found = list(_pieces(row, edge, radius)) if radius else [row | {"dy": 0, "dx": 0}]
                yield _batch(_PIECE, {name: [p[name] for p in found] for name in names})

    def meet(group: pa.Table) -> pa.Table:
        pieces = group.to_pylist()  # nine at most
        own = next(p for p in pieces if not (p["dy"] or p["dx"]))
        with np.errstate(all="ignore"):
            block = kernel(_assembled(pieces, edge, radius, reflect), radius)
        return pa.Table.from_batches([_batch(_TILE, {name: [own[name]] for name in (*_KEY, "h", "w")} | {"block": [np.ascontiguousarray(block, "<f8").tobytes()]})])

    return tiles.mapInArrow(send, _PIECE).groupBy(*_KEY).applyInArrow(meet, _TILE)


def _sums(a: np.ndarray, radius: int) -> np.ndarray:
    k = 2 * radius + 1
    return np.lib.stride_tricks.sliding_window_view(np.lib.stride_tricks.sliding_window_view(a, k, axis=1).sum(-1), k, axis=0).sum(-1)


def mean_kernel(a: np.ndarray, radius: int) -> np.ndarray:
    """Box mean; missing pixels count as nothing in the sum, a box of none but them is missing."""
    there = ~np.isnan(a)
    out = _sums(np.where(there, a, 0.0), radius) / (2 * radius + 1) ** 2
    return out if there.all() else np.where(_sums(there.astype(np.float64), radius) > 0, out, np.nan)


def _inner(a: np.ndarray, radius: int) -> np.ndarray:
    return a[radius : a.shape[0] - radius, radius : a.shape[1] - radius]


def lee_kernel(a: np.ndarray, radius: int, cu: float = LEE_CU) -> np.ndarray:
    m, s = mean_kernel(a, radius), mean_kernel(a * a, radius)
    ci2 = np.maximum(s - m * m, 0.0) / np.maximum(m * m, EPS)
    weight = np.clip(1.0 - cu * cu / np.maximum(ci2, EPS), 0.0, 1.0)
    return m + weight * (_inner(a, radius) - m)


def texture_kernel(a: np.ndarray, radius: int) -> np.ndarray:
    m = mean_kernel(a, radius)
    return np.sqrt(np.maximum(mean_kernel(a * a, radius) - m * m, 0.0))


def box_means(tiles: DataFrame, radius: int, *, edge: int = 256) -> DataFrame:
    return mapped(tiles, mean_kernel, radius, edge=edge)


def lee(tiles: DataFrame, radius: int = 2, *, edge: int = 256) -> DataFrame:
    return mapped(tiles, lee_kernel, radius, edge=edge)


def texture(tiles: DataFrame, radius: int = 2, *, edge: int = 256) -> DataFrame:
    return mapped(tiles, texture_kernel, radius, edge=edge)


def morphology(mask: DataFrame, steps: Sequence[tuple[str, int]], *, edge: int = 256) -> DataFrame:
    """Squares' erosions (``erode``) and dilations (``dilate``) of given radii, one after the other, by one halo exchange.

    A mask is 1 where on, 0 where off; frames end at the border.
    """
    names = {"erode", "dilate"}
    if bad := [s for s, _ in steps if s not in names]:
        raise ValueError(f"unknown steps: {bad}")

    def kernel(a: np.ndarray, radius: int) -> np.ndarray:
        outside = np.isnan(a)
        for step, r in steps:
            fill, pick = (np.inf, np.min) if step == "erode" else (-np.inf, np.max)
            wide = np.pad(np.where(outside, fill, a), r, constant_values=fill)
            view = np.lib.stride_tricks.sliding_window_view
            a = np.where(outside, np.nan, pick(view(pick(view(wide, 2 * r + 1, axis=1), axis=-1), 2 * r + 1, axis=0), axis=-1))
        return _inner(a, radius)

    return mapped(mask, kernel, sum(r for _, r in steps), edge=edge, reflect=False)


def opened(mask: DataFrame, radius: int = 1, *, edge: int = 256) -> DataFrame:
    return morphology(mask, (("erode", radius), ("dilate", radius)), edge=edge)


def closed(mask: DataFrame, radius: int = 1, *, edge: int = 256) -> DataFrame:
    return morphology(mask, (("dilate", radius), ("erode", radius)), edge=edge)


# ---- components --------------------------------------------------------------------------------


def label_block(on: np.ndarray, y0: int, x0: int, width: int) -> np.ndarray:
    """For each cell the least y * width + x that is 4-connected with it inside the block; -1 where off."""
    out = np.full(on.shape, -1, np.int64)
    wide = np.zeros((on.shape[0], on.shape[1] + 2), np.int8)
    wide[:, 1:-1] = on
    turns = np.diff(wide, axis=1)
    row, low = np.nonzero(turns == 1)
    high = np.nonzero(turns == -1)[1]
    if not len(row):
        return out
    # Runs of one row and the next that share a column: places in the sorted ends of all runs.
    step = on.shape[1] + 2
    first = np.searchsorted(row * step + high, (row + 1) * step + low, side="right")
    count = np.maximum(np.searchsorted(row * step + low, (row + 1) * step + high, side="left") - first, 0)
    a = np.repeat(np.arange(len(row)), count)
    b = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    root = np.arange(len(row))
    while True:
        least = np.minimum(root[a], root[b])
        after = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(after, at, least)
        after = after[after]
        if (after == root).all():
            break
        root = after
    ids = (y0 + row) * width + x0 + low
    sizes = high - low
    ys = np.repeat(row, sizes)
    xs = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[ys, xs] = np.repeat(ids[root], sizes)  # runs are in the order of their cells, so the least root is the least cell
    return out


def components(mask: DataFrame, *, edge: int = 256, max_rounds: int = 64) -> DataFrame:
    """Tiles whose blocks (64-bit numbers) hold each cell's component: the least y * w + x 4-connected with it; -1 where off.

    Cells are joined inside their tiles first; only labels that touch a tile's border are nodes
    of the graph that is settled in rounds, so rows and rounds fall with the tile's size.
    """
    importable(mask.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                labels = label_block(_block(row, edge) == 1, row["ty"] * edge, row["tx"] * edge, row["w"])
                yield _batch(_TILE, {k: [v] for k, v in row.items()} | {"block": [labels.astype("<i8").tobytes()]})

    local = written(mask.select(*_KEY, "h", "w", "block").mapInArrow(label, _TILE), "labels")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row, edge, "<i8")
                y0, x0 = row["ty"] * edge, row["tx"] * edge
                lines = [(0, y0, x0, block[0]), (1, x0, y0, block[:, 0]), (0, y0 + block.shape[0], x0, block[-1]), (1, x0 + block.shape[1], y0, block[:, -1])]
                for n, (across, line, start, labels) in enumerate(lines):
                    at = np.flatnonzero(labels >= 0)
                    if 0 < line < (row["w"] if across else row["h"]) and len(at):
                        yield _batch(_BORDER, {"scene": [row["scene"]] * len(at), "band": [row["band"]] * len(at), "w": [row["w"]] * len(at), "across": [across] * len(at), "line": [line] * len(at), "place": (at + start).tolist(), "before": [int(n > 1)] * len(at), "label": labels[at].tolist()})

    sides = local.mapInArrow(borders, _BORDER)
    met = sides.groupBy(*PLANE, "w", "across", "line", "place").agg(F.min(F.when(F.col("before") == 1, F.col("label"))).alias("u"), F.min(F.when(F.col("before") == 0, F.col("label"))).alias("v"))
    links = met.where("u is not null and v is not null").select(*PLANE, "w", "u", "v").distinct()
    both = checkpointed(links.unionAll(links.select(*PLANE, "w", F.col("v").alias("u"), F.col("u").alias("v"))))
    nodes = both.select(*PLANE, F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    roots = G.settled(nodes, both.select(*PLANE, "u", "v"), PLANE, max_rounds)
    widths = both.select(*PLANE, "w").distinct()  # a row per plane
    told = roots.join(widths, list(PLANE)).where("label <> node").select(*PLANE, F.expr(f"(node div w) div {edge}").alias("ty"), F.expr(f"(node % w) div {edge}").alias("tx"), "node", "label")

    def rename(tile: pa.Table, names: pa.Table) -> pa.Table:
        if not names.num_rows or not tile.num_rows:
            return tile
        row = tile.to_pylist()[0]
        labels = _block(row, edge, "<i8").copy()
        old, new = names.column("node").to_numpy(), names.column("label").to_numpy()
        order = np.argsort(old)
        at = np.searchsorted(old[order], labels.ravel()).clip(0, len(old) - 1)
        known = old[order][at] == labels.ravel()
        labels.ravel()[known] = new[order][at][known]
        return pa.Table.from_batches([_batch(_TILE, {k: [v] for k, v in row.items()} | {"block": [labels.tobytes()]})])

    return local.groupBy(*_KEY).cogroup(told.groupBy(*_KEY)).applyInArrow(rename, _TILE)


_BORDER = "scene string, band int, w long, across int, line long, place long, before int, label long"
_STATS = "scene string, band int, label long, w long, cells long, x0 long, y0 long, x1 long, y1 long, sum_y long, sum_x long"


def component_boxes(labelled: DataFrame, *, edge: int = 256) -> DataFrame:
    """``label_y, label_x, cells``, box (x1 and y1 beyond the last) and centroid of every component; a row a tile and component is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _block(row, edge, "<i8")
                ys, xs = np.nonzero(block >= 0)
                labels, of = np.unique(block[ys, xs], return_inverse=True)
                if not len(labels):
                    continue
                ys, xs, n = ys + row["ty"] * edge, xs + row["tx"] * edge, len(labels)
                ends = []
                for values in (xs, ys):
                    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                    np.minimum.at(low, of, values)
                    np.maximum.at(high, of, values)
                    ends.append((low.tolist(), (high + 1).tolist()))
                total = lambda values: np.bincount(of, values, n).astype(np.int64).tolist()  # noqa: B023, E731
                yield _batch(_STATS, {"scene": [row["scene"]] * n, "band": [row["band"]] * n, "label": labels.tolist(), "w": [row["w"]] * n, "cells": np.bincount(of, minlength=n).tolist(), "x0": ends[0][0], "y0": ends[1][0], "x1": ends[0][1], "y1": ends[1][1], "sum_y": total(ys), "sum_x": total(xs)})

    parts = labelled.mapInArrow(count, _STATS).groupBy(*PLANE, "label", "w")
    whole = parts.agg(F.sum("cells").alias("cells"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("sum_y").alias("sum_y"), F.sum("sum_x").alias("sum_x"))
    return whole.select(*PLANE, F.expr("label div w").alias("label_y"), F.expr("label % w").alias("label_x"), "cells", "x0", "y0", "x1", "y1", (F.col("sum_y") / F.col("cells")).alias("cy"), (F.col("sum_x") / F.col("cells")).alias("cx"))
