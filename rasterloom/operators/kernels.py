"""Arrow kernels: whole planes in numpy, behind the same relation as ``grid``.

One plane is one group: right for scenes that fit a worker.  Larger ones go through the
window forms of ``grid``, which have no such limit.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .grid import EPS, LEE_CU, PLANE


def box_mean(a: np.ndarray, radius: int) -> np.ndarray:
    """Reflected mean from sliding sums, columns then rows."""
    if radius < 1:
        return a
    k = 2 * radius + 1
    wide = np.lib.stride_tricks.sliding_window_view(np.pad(a, radius, mode="reflect"), k, axis=1).sum(-1)
    return np.lib.stride_tricks.sliding_window_view(wide, k, axis=0).sum(-1) / (k * k)


def lee(a: np.ndarray, radius: int = 2, cu: float = LEE_CU) -> np.ndarray:
    mean = box_mean(a, radius)
    var = np.maximum(box_mean(a * a, radius) - mean * mean, 0)
    weight = np.clip(1 - cu * cu / np.maximum(var / np.maximum(mean * mean, EPS), EPS), 0, 1)
    return mean + weight * (a - mean)


def plane_kernel(pixels: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``kernel`` over every (scene, band) plane; missing pixels are NaN inside and null outside."""

    def run(group: pa.Table) -> pa.Table:
        y, x = group.column("y").to_numpy(), group.column("x").to_numpy()
        plane = np.full((int(y.max()) + 1, int(x.max()) + 1), np.nan)
        plane[y, x] = group.column("v").to_numpy()
        out = kernel(plane)
        return pa.table({"scene": group.column("scene"), "band": group.column("band"), "y": group.column("y"), "x": group.column("x"), "v": pa.array(out[y, x], pa.float64(), from_pandas=True)})

    return pixels.select(*PLANE, "y", "x", "v").groupBy(*PLANE).applyInArrow(run, "scene string, band int, y long, x long, v double")


def predict(requests: DataFrame, predictor: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """The predictor contract: Arrow batches of images and prompts in, answers out."""

    def run(batches):
        yield from map(predictor, batches)

    return requests.mapInArrow(run, schema)


def predict_from_table(requests: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """The default predictor: answers that were made before, by key; null where there is none."""
    return requests.join(predictions, key, "left")
