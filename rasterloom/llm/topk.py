"""Exact top-k by inner product with a pivot table.

Vectors become whole numbers floor(256 * x).  The index is a written table that holds, for
each vector, its numbers and its distances to ``pivots`` fixed vectors.  The distances of x to
all pivots, with its norm, tell its inner products with them, so the part of x that lies in the
pivots' span; only the length of the rest stays unknown.  For query q the greatest inner
product that all distances together allow is

    <q', x'> + |q - q'| |x - x'|         (q', x' the parts in the span)

which is the greatest lower bound on |q - x| that the table gives, never above what a single
pivot's triangle inequality gives.  Vectors are evaluated in the order of these bounds until none
reaches the k-th score, so the result is exact.  A query's own block already gives it k scores
to start from.

Pivots are picked by greatest remainder on a bounded sample of ``pivot_sample`` rows (their
choice moves speed only).  Queries are a table of blocks of ``query_block`` that meet packs of the
index's rows (``blocks``); a task returns k rows for each query of a block that it has met.

A vector that is null, holds null or non-finite components, or overflows a double when scaled,
takes no part.  Vectors of different lengths count as filled up with zeros; an empty one is all
zeros.  Scores are exact at any size; one beyond a long is written as the nearest long.  Ties go
to the smaller id.  A repeated vec_id is a candidate per row and a query per row; rows of the
query's own id are left out.  Rows without an id take no part.  An empty table gives no rows.
Only the id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import prepare, staged

_SCHEMA = "query_row long, query_id long, vec_id long, score long"
#: Pivots are no longer than this; rows of a pack; what a task holds of queries before it hands on what it has found.
_PIVOT_WIDTH, _PACK_ROWS, _HELD_BYTES = 4096, 4096, 64 << 20
_EXACT = float(1 << 53)


def _usable(column: Column) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * 256) == float("inf")))
    return column.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantise(values: np.ndarray) -> np.ndarray:
    """Whole numbers as doubles; scaling by a power of two and rounding down lose nothing."""
    return np.floor(256.0 * values.astype(np.float64))


def packed(row: np.ndarray) -> bytes:
    """32-bit numbers where all fit, else doubles, told apart by the first byte."""
    return b"\0" + row.astype("<i4").tobytes() if not len(row) or np.abs(row).max() < 1 << 31 else b"\1" + row.astype("<f8").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f8" if raw[0] else "<i4", offset=1).astype(np.float64)


def _by_length(rows: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the rows of each length."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.concatenate([rows[i] for i in at]).reshape(len(at), size)


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each is the vector that the ones before explain least; none that they explain wholly."""
    norms = np.sqrt((sample**2).sum(1)) if len(sample) else np.zeros(0)
    plain = np.isfinite(norms) & (norms > 0)
    if not plain.any():
        return sample[:0]
    plain &= norms <= 16 * np.median(norms[plain])  # beside a far longer one, distances say little
    sample = sample[plain]
    rest, chosen = sample.copy(), []
    while len(chosen) < min(count, *sample.shape):
        left = (rest**2).sum(1)
        at = int(np.argmax(left))
        if left[at] < 1e-4 * (sample[at] ** 2).sum():
            break
        chosen.append(at)
        way = rest[at] / np.sqrt(left[at])
        rest -= np.outer(rest @ way, way)
    return sample[chosen]


class Pivots:
    """Fixed vectors, and the coordinates in their span that distances to them tell."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norms = vectors, (vectors**2).sum(1)
        self.root = np.linalg.inv(np.linalg.cholesky(vectors @ vectors.T)) if len(vectors) else np.zeros((0, 0))

    def distances(self, rows: np.ndarray) -> np.ndarray:
        size = min(rows.shape[1], self.vectors.shape[1]) if len(self.vectors) else 0
        squared = (rows**2).sum(1)[:, None] + self.norms[None, :] - 2 * rows[:, :size] @ self.vectors[:, :size].T
        return np.sqrt(np.maximum(squared, 0))

    def coordinates(self, squared: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates in an orthonormal basis of the span, and the length of what lies outside."""
        inner = (squared[:, None] + self.norms[None, :] - far**2) / 2
        own = inner @ self.root.T
        return own, np.sqrt(np.maximum(squared - (own**2).sum(1), 0))


class PivotIndex:
    """The written table and the pivots that it was made with."""

    def __init__(self, table: DataFrame, pivots: Pivots):
        self.table, self.pivots = table, pivots


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 56, pivot_sample: int = 2_000) -> PivotIndex:
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    sample = [quantise(np.array(r.v)) for r in rows.select(F.slice("v", 1, _PIVOT_WIDTH).alias("v")).limit(pivot_sample).collect()]  # bounded by both
    known = np.zeros((len(sample), max(map(len, sample), default=0)))
    for row, v in zip(known, sample, strict=True):
        row[: len(v)] = v
    with np.errstate(over="ignore"):
        chosen = Pivots(pick_pivots(known, pivots))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            flat, ends = quantise(lists.flatten().to_numpy()), np.cumsum(lists.value_lengths().to_numpy())
            ints = np.split(flat, ends[:-1])
            far = np.zeros((len(ints), len(chosen.vectors)))
            with np.errstate(over="ignore", invalid="ignore"):
                for at, part in _by_length(ints):
                    far[at] = chosen.distances(part)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "size": pa.array(list(map(len, ints)), pa.int32()), "ints": pa.array(list(map(packed, ints)), pa.binary()), "far": pa.array([x.tobytes() for x in far], pa.binary())})

    return PivotIndex(staged(rows.mapInArrow(measure, "vec_id long, size int, ints binary, far binary"), "pivots"), chosen)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises and can't overflow
    return scores[order], ids[order]


def exact_scores(vectors: np.ndarray, query: np.ndarray, norms: np.ndarray, norm: float) -> np.ndarray:
    """Inner products as longs; in doubles where these are exact, else in whole numbers."""
    size = min(vectors.shape[1], len(query))
    with np.errstate(over="ignore", invalid="ignore"):
        large = ~(np.sqrt(norms) * np.sqrt(norm) < _EXACT)
        out = np.where(large, 0.0, vectors[:, :size] @ query[:size]).astype(np.int64)
    for i in np.flatnonzero(large):
        whole = sum(int(a) * int(b) for a, b in zip(vectors[i, :size].tolist(), query[:size].tolist(), strict=True))
        out[i] = min(max(whole, -(1 << 63)), (1 << 63) - 1)
    return out


class Search:
    """Running top-k of one task for a block of queries."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], pivots: Pivots, k: int, row: np.ndarray | None = None):
        self.ids, self.k, self.pivots = np.array([r[0] for r in rows], np.int64), k, pivots
        self.row = np.arange(len(rows)) if row is None else row
        ints = [unpacked(r[1]) for r in rows]
        self.ints = np.zeros((len(ints), max(map(len, ints), default=0)))
        for row, v in zip(self.ints, ints, strict=True):
            row[: len(v)] = v
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = (self.ints**2).sum(1)
            self.own, self.rest = pivots.coordinates(self.norms, np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1))
        self.scores = [np.zeros(0, np.int64) for _ in rows]
        self.found = [np.zeros(0, np.int64) for _ in rows]
        self.start = np.full(len(rows), -np.inf)  # the block's own scores: no k-th score can be lower
        self.evaluated = 0

    def begin(self, strip: int = 256) -> Search:
        """What the queries of the block score against each other."""
        if (np.sqrt(self.norms.max(initial=0)) ** 2 < _EXACT) and len(self.ids) > self.k:
            for at in range(0, len(self.ids), strip):
                scores = self.ints[at : at + strip] @ self.ints.T
                scores[self.ids[at : at + strip, None] == self.ids[None, :]] = -np.inf
                self.start[at : at + strip] = np.partition(scores, -self.k, axis=1)[:, -self.k]
        return self

    def take(self, ids: np.ndarray, ints: list[np.ndarray], far: np.ndarray, strip: int = 128) -> None:
        for at, vectors in _by_length(ints):
            with np.errstate(over="ignore", invalid="ignore"):
                norms = (vectors**2).sum(1)
                own, rest = self.pivots.coordinates(norms, far[at])
                for first in range(0, len(self.ids), strip):
                    part = slice(first, first + strip)
                    bound = self.own[part] @ own.T + self.rest[part, None] * rest[None, :]
                    # Scores are whole; what rounding can take from a bound is given back.
                    bound += 0.5 + 1e-7 * np.sqrt(self.norms[part, None]) * np.sqrt(norms)[None, :]
                    bound[np.isnan(bound)] = np.inf
                    bound[self.ids[part, None] == ids[at][None, :]] = -np.inf
                    for n in range(first, min(first + strip, len(self.ids))):
                        self._evaluate(n, ids[at], vectors, norms, bound[n - first])

    def _reach(self, n: int) -> float:
        return max(self.start[n], float(self.scores[n][-1])) if len(self.scores[n]) == self.k else self.start[n]

    def _evaluate(self, n: int, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, bound: np.ndarray) -> None:
        reach, step, at = self._reach(n), 32, 0
        left = np.flatnonzero((bound > -np.inf) & (bound >= reach))
        left = left[np.argsort(-bound[left], kind="stable")]
        while at < len(left) and bound[left[at]] >= reach:
            part = left[at : at + step]
            got = exact_scores(vectors[part], self.ints[n], norms[part], self.norms[n])
            self.evaluated += len(part)
            self.scores[n], self.found[n] = _best(np.concatenate((self.scores[n], got)), np.concatenate((self.found[n], ids[part])), self.k)
            reach = self._reach(n)
            at, step = at + step, min(step * 4, 4096)

    def found_rows(self) -> pa.RecordBatch:
        sizes, none = [len(x) for x in self.found], np.zeros(0, np.int64)
        return pa.RecordBatch.from_pydict({
            "query_row": pa.array(np.repeat(self.row, sizes), pa.int64()), "query_id": pa.array(np.repeat(self.ids, sizes), pa.int64()),
            "vec_id": pa.array(np.concatenate([*self.found, none]), pa.int64()), "score": pa.array(np.concatenate([*self.scores, none]), pa.int64()),
        })


def _packed(table: DataFrame) -> DataFrame:
    """The index's rows a batch at a time: ids, and the numbers and distances of each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _PACK_ROWS):
                part = batch.slice(first, _PACK_ROWS)
                yield pa.RecordBatch.from_pydict({
                    "ids": pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()), "rows": pa.array([part.column(1).to_pylist()], pa.list_(pa.binary())), "fars": pa.array([b"".join(part.column(2).to_pylist())], pa.binary()),
                })

    return table.select("vec_id", "ints", "far").mapInArrow(pack, "ids binary, rows array<binary>, fars binary")


def search(index: PivotIndex, queries: DataFrame, *, k: int = 5, query_block: int = 4_096, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best for every row of ``queries`` (rows of the index's table)."""
    pivots = index.pivots
    asked = staged(queries.select("size", "vec_id", "ints", "far").withColumn("row", F.monotonically_increasing_id()), "queries")
    joined = blocks.meet(_packed(index.table), asked, "ids", ["row", "vec_id", "ints", "far"], 8 * len(pivots.vectors) + 100, query_block, broadcast_bytes)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, Search] = {}
        size = 0
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                name = row.column(0)[0].as_py()
                if name not in states:
                    if size > _HELD_BYTES:  # a task of many blocks hands on what it has found for the former ones
                        yield from (s.found_rows() for s in states.values())
                        states, size = {}, 0
                    block = row.column(4)[0].values
                    of = list(zip(block.field("vec_id").to_pylist(), block.field("ints").to_pylist(), block.field("far").to_pylist(), strict=True))
                    states[name] = Search(of, pivots, k, block.field("row").to_numpy()).begin()
                    size += states[name].ints.nbytes + 64 * k * len(of)
                ids = np.frombuffer(row.column(1)[0].as_py(), "<i8")
                far = np.frombuffer(row.column(3)[0].as_py(), np.float64).reshape(len(ids), -1)
                states[name].take(ids, list(map(unpacked, row.column(2)[0].as_py())), far)
        yield from (s.found_rows() for s in states.values())

    found = joined.select("block", "ids", "rows", "fars", "queries").mapInArrow(look, _SCHEMA)
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
