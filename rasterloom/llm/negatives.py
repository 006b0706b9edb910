"""Hard negatives by product quantisation with stored residual norms.

Vectors become whole numbers floor(256 * x).  The index is a written table of packs: rows of one
length, each cut into subspaces of two dimensions, a subspace coded by the nearest of 256
centroids, and beside every code the length of what the centroid leaves over, rounded up.  An
anchor q looks the inner products of its parts with all centroids up in a table; their sum is off
the true score of row x by at most

    sum over subspaces of |q_s| |x_s - c_s|

so table score minus and plus this bound enclose the score.  Positives are the best ``positives``
rows of the anchor's label: a row whose upper end lies below the k-th lower end can't be one.  A
positive of score p opens the window [low * p, high * p]; in it a row of another label whose upper
end lies below the third lower end of rows that are surely inside can't be among the first three.
What is left is scored by whole numbers, and these decide; the codes never do.

The centroids are fitted on a bounded sample (``sample_rows``, by a hash of the id); they move
speed only.  Every row is indexed and every anchor meets every pack: a stated set of anchors
against all rows, in blocks.  Anchors are a table of blocks of at most about ``block_rows``.  If
all of them fit ``broadcast_bytes`` (checked by count and width), packs stay where they lie;
beyond it packs and blocks meet in a join on block and part, a part being a share of the packs.
A task keeps the best few rows of each anchor and window, so nothing grows with a label's rows,
with copies of a vector or with ties.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.
Vectors of different lengths count as filled up with zeros.  Rows of the anchor's own id are
neither its positives nor its negatives; a repeated id is a row each, as anchor and as candidate.
Ties go to the smaller id.  Scores are exact at any size; one beyond a long counts as the nearest
long.  Fewer rows than asked give what there is; an empty table, no anchors or a single label
give no rows.  Only the id, vector and label columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .common import prepare, staged
from .topk import _EXACT, _by_length, _usable, quantise

_PACK = "vec_ids binary, labels binary, size int, ints binary, codes binary, rests binary"
#: Dimensions of a subspace, centroids of each, rows of a pack, anchors looked up together; dimensions beyond _WIDTH are one rest.
_SUB, _CENTROIDS, _PACK_ROWS, _STRIP, _WIDTH = 2, 256, 4096, 128, 4096
#: What a task holds of anchors before it hands on what it has found for them.
_HELD_BYTES = 64 << 20
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


# ---- quantiser -------------------------------------------------------------------------------


class Quantiser:
    """Centroids of each subspace: subspace x centroid x 2."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.squares = (centroids**2).sum(2)

    @classmethod
    def fit(cls, sample: np.ndarray, rounds: int = 5) -> Quantiser:
        n, width = sample.shape
        parts = np.zeros((n, -(-width // _SUB) * _SUB))
        parts[:, :width] = sample
        norms = np.sqrt((parts**2).sum(1))
        usable = np.isfinite(norms) & (norms <= 16 * np.median(norms)) if n else norms > 0  # a far longer one would take a centroid for itself
        if not (width and usable.any()):
            return cls(np.zeros((0, 1, _SUB)))
        parts = parts[usable].reshape(int(usable.sum()), -1, _SUB).transpose(1, 0, 2)
        found = np.zeros((len(parts), _CENTROIDS, _SUB))
        for s, rows in enumerate(parts):
            start = np.unique(rows, axis=0)
            centres = start[np.linspace(0, len(start) - 1, _CENTROIDS).astype(int)].copy()
            for _ in range(rounds):
                near = np.argmin((centres**2).sum(1) - 2 * rows @ centres.T, axis=1)
                count = np.bincount(near, minlength=_CENTROIDS)
                for d in range(_SUB):
                    total = np.bincount(near, rows[:, d], _CENTROIDS)
                    centres[:, d] = np.where(count > 0, total / np.maximum(count, 1), centres[:, d])
            found[s] = centres
        return cls(found)

    def parts(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The coded dimensions as subspace x row x 2, and the squared length of the dimensions beyond."""
        width = len(self.centroids) * _SUB
        out = np.zeros((len(rows), width))
        out[:, : min(width, rows.shape[1])] = rows[:, :width]
        return out.reshape(len(rows), -1, _SUB).transpose(1, 0, 2), (rows[:, width:] ** 2).sum(1)

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and lengths of what they leave over (the last: beyond the coded dimensions), rounded up."""
        parts, beyond = self.parts(rows)
        codes = np.zeros((len(rows), len(parts)), np.uint8)
        rests = np.zeros((len(rows), len(parts) + 1))
        for s, own in enumerate(parts):
            codes[:, s] = np.argmin(self.squares[s] - 2 * own @ self.centroids[s].T, axis=1)
            rests[:, s] = np.sqrt(((own - self.centroids[s][codes[:, s]]) ** 2).sum(1))
        rests[:, -1] = np.sqrt(beyond)
        return codes, np.nextafter((rests * (1 + 1e-6)).astype(np.float32), np.float32(np.inf))


class Index:
    """The written packs and the quantiser that coded them."""

    def __init__(self, packs: DataFrame, quantiser: Quantiser):
        self.packs, self.quantiser = packs, quantiser

    def rows(self) -> DataFrame:
        """``vec_id, label, size, ints`` of every row, ``ints`` as 64-bit floats."""

        def open_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.to_pylist():
                    pack = Pack(raw)
                    ints = [x.tobytes() for x in pack.rows]
                    yield pa.RecordBatch.from_pydict({"vec_id": pa.array(pack.ids), "label": pa.array(pack.labels), "size": pa.array([raw["size"]] * len(ints), pa.int32()), "ints": pa.array(ints, pa.binary())})

        return self.packs.mapInArrow(open_packs, "vec_id long, label long, size int, ints binary")


class Pack:
    def __init__(self, raw: dict):
        self.ids, self.labels = np.frombuffer(raw["vec_ids"], "<i8"), np.frombuffer(raw["labels"], "<i8")
        n = len(self.ids)
        small = len(raw["ints"]) == 4 * n * raw["size"]
        self.rows = np.frombuffer(raw["ints"], "<i4" if small else "<f8").reshape(n, raw["size"]).astype(np.float64)
        self.codes = np.frombuffer(raw["codes"], np.uint8).reshape(n, -1 if raw["codes"] else 0)
        self.rests = np.frombuffer(raw["rests"], "<f4").reshape(n, -1).astype(np.float64)
        self.norms = np.sqrt((self.rows**2).sum(1))


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample_rows: int = 4_096) -> Index:
    prepare(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("v")))
    drawn = rows.select("vec_id", F.slice("v", 1, _WIDTH).alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).collect()  # bounded by both
    sample = np.zeros((len(drawn), max((len(r.v) for r in drawn), default=0)))
    for row, r in zip(sample, drawn, strict=True):
        row[: len(r.v)] = quantise(np.array(r.v, np.float64))
    with np.errstate(all="ignore"):
        quantiser = Quantiser.fit(sample)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            flat, ends = quantise(lists.flatten().to_numpy()), np.cumsum(lists.value_lengths().to_numpy())
            for at, matrix in _by_length(np.split(flat, ends[:-1])):
                for first in range(0, len(at), _PACK_ROWS):
                    part, own = at[first : first + _PACK_ROWS], matrix[first : first + _PACK_ROWS]
                    with np.errstate(all="ignore"):
                        codes, rests = quantiser.encode(own)
                    small = np.abs(own).max(initial=0) < 1 << 31
                    yield pa.RecordBatch.from_pylist([{
                        "vec_ids": ids[part].astype("<i8").tobytes(), "labels": labels[part].astype("<i8").tobytes(), "size": matrix.shape[1],
                        "ints": own.astype("<i4" if small else "<f8").tobytes(), "codes": codes.tobytes(), "rests": rests.astype("<f4").tobytes(),
                    }], schema=_PACK_SCHEMA)

    return Index(staged(rows.mapInArrow(code, _PACK), "codes"), quantiser)


_PACK_SCHEMA = pa.schema([("vec_ids", pa.binary()), ("labels", pa.binary()), ("size", pa.int32()), ("ints", pa.binary()), ("codes", pa.binary()), ("rests", pa.binary())])


# ---- what a task does with a pack and a block of anchors --------------------------------------


def exact_pairs(rows: np.ndarray, norms: np.ndarray, anchors: np.ndarray, anchor_norms: np.ndarray, i: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Inner products of row ``i[n]`` and anchor ``a[n]`` as longs; in doubles where these are exact, else in whole numbers."""
    size, out = min(rows.shape[1], anchors.shape[1]), np.zeros(len(i), np.int64)
    step = max(1, (1 << 21) // max(size, 1))
    with np.errstate(all="ignore"):
        plain = norms[i] * anchor_norms[a] < _EXACT
        for at in range(0, len(i), step):
            own = slice(at, at + step)
            scores = np.einsum("nd,nd->n", rows[i[own], :size], anchors[a[own], :size])
            out[own] = np.where(plain[own], scores, 0.0).astype(np.int64)
    for n in np.flatnonzero(~plain):
        whole = sum(int(x) * int(y) for x, y in zip(rows[i[n], :size].tolist(), anchors[a[n], :size].tolist(), strict=True))
        out[n] = min(max(whole, _LEAST), _MOST)
    return out


class Best:
    """The ``k`` best rows of each slot so far: higher score, then smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.reach = k, np.full(slots, -np.inf)
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.concatenate((self.slot, slot)), np.concatenate((self.score, score)), np.concatenate((self.id, ids))
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x rises and can't overflow
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        place = np.arange(len(slot)) - np.repeat(starts, np.diff(np.r_[starts, len(slot)]))
        kept = place < self.k
        self.slot, self.score, self.id = slot[kept], score[kept], ids[kept]
        full = place[kept] == self.k - 1
        self.reach[self.slot[full]] = self.score[full]


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each column; minus infinity where there are fewer."""
    if len(values) < k:
        return np.full(values.shape[1], -np.inf)
    return np.partition(values.T, len(values) - k, axis=1)[:, len(values) - k]


class Anchors:
    """A block of anchors of one length, and what its task has found for them."""

    def __init__(self, struct: pa.StructArray, quantiser: Quantiser, k: int, windows: int):
        self.row, self.ids, self.labels = (struct.field(name).to_numpy() for name in ("row", "vec_id", "label"))
        ints = struct.field("ints").to_pylist()
        self.rows = np.frombuffer(b"".join(ints), "<f8").reshape(len(ints), -1 if ints and ints[0] else 0)
        self.quantiser, self.k, self.windows, self.evaluated = quantiser, k, windows, 0
        with np.errstate(all="ignore"):
            self.norms = np.sqrt((self.rows**2).sum(1))
            parts, beyond = quantiser.parts(self.rows)
            self.parts, self.part_norms = parts, np.concatenate((np.sqrt((parts**2).sum(2)).T, np.sqrt(beyond)[:, None]), axis=1)
        if windows:
            self.low, self.high = (np.array([x + [fill] * (windows - len(x)) for x in struct.field(name).to_pylist()]).reshape(len(ints), windows) for name, fill in (("lows", _MOST), ("highs", _LEAST)))
        self.best = Best(len(ints) * max(windows, 1), k)

    def _enclosed(self, pack: Pack) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Lower and upper ends of the scores, row x anchor, for one strip of anchors after the other."""
        tables, subs = self.quantiser, pack.codes.shape[1]
        lengths = np.sqrt(sum((tables.squares[s][pack.codes[:, s]] for s in range(subs)), np.zeros(len(pack.ids))))
        for at in range(0, len(self.ids), _STRIP):
            part = slice(at, at + _STRIP)
            norms = self.norms[part]
            total = np.zeros((len(pack.ids), len(norms)), np.float32)
            for s in range(subs):
                table = (tables.centroids[s] @ self.parts[s][part].T).astype(np.float32)
                total += np.take(table, pack.codes[:, s], axis=0)
            # Half a point, and what rounding of 32-bit sums and of the bound can take, is given back.
            off = pack.rests @ self.part_norms[part].T * (1 + 1e-6) + 0.5 + (subs + 4) * 2.0**-22 * lengths[:, None] * norms[None, :]
            low, high = total - off, total + off
            if lengths.max(initial=0) * norms.max(initial=0) > 2.0**61:  # scores end at a long's ends
                low, high = np.clip(low, float(_LEAST), float(_MOST)), np.clip(high, float(_LEAST), float(_MOST))
            bad = ~(np.isfinite(low) & np.isfinite(high))
            if bad.any():
                low[bad], high[bad] = -np.inf, np.inf
            yield part, low, high

    def _score(self, pack: Pack, at: slice, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, a = np.nonzero(wanted)
        a = a + at.start
        self.evaluated += len(i)
        return i, a, exact_pairs(pack.rows, pack.norms, self.rows, self.norms, i, a)

    def meet(self, pack: Pack) -> None:
        with np.errstate(all="ignore"):
            for part, low, high in self._enclosed(pack):
                same = pack.labels[:, None] == self.labels[None, part]
                other = pack.ids[:, None] != self.ids[None, part]
                if self.windows:
                    self._negatives(pack, part, low, high, other & ~same)
                else:
                    self._positives(pack, part, low, high, other & same)

    def _positives(self, pack: Pack, part: slice, low: np.ndarray, high: np.ndarray, fit: np.ndarray) -> None:
        reach = np.maximum(self.best.reach[part], _kth(np.where(fit, low, -np.inf), self.k))
        i, a, scores = self._score(pack, part, fit & (high >= reach))
        self.best.add(a, scores, pack.ids[i])

    def _negatives(self, pack: Pack, part: slice, low: np.ndarray, high: np.ndarray, fit: np.ndarray) -> None:
        wanted = np.zeros(fit.shape, bool)
        for w in range(self.windows):
            least, most = self.low[part, w].astype(np.float64), self.high[part, w].astype(np.float64)
            sure = fit & (low >= least + 1) & (high <= most - 1)
            reach = np.maximum(self.best.reach.reshape(-1, self.windows)[part, w], _kth(np.where(sure, low, -np.inf), self.k))
            # A long as a double may be off where scores are beyond 2**53: there a margin, the whole numbers decide.
            slack = np.where(np.abs(least) + np.abs(most) < _EXACT, 0.0, 4096.0)
            wanted |= fit & (least <= most) & (high >= least - slack) & (low <= most + slack) & (high >= reach)
        i, a, scores = self._score(pack, part, wanted)
        for w in range(self.windows):
            inside = (scores >= self.low[a, w]) & (scores <= self.high[a, w])
            self.best.add(a[inside] * self.windows + w, scores[inside], pack.ids[i[inside]])

    def found(self) -> pa.RecordBatch:
        best, windows = self.best, max(self.windows, 1)
        return pa.RecordBatch.from_pydict({"row": pa.array(self.row[best.slot // windows]), "window": pa.array(best.slot % windows), "vec_id": pa.array(best.id), "score": pa.array(best.score)})


# ---- the plan ----------------------------------------------------------------------------------


def _met(index: Index, anchors: DataFrame, k: int, windows: int, block_rows: int, broadcast_bytes: int) -> DataFrame:
    """``row, window, vec_id, score``: the ``k`` best rows of each window (or anchor), a share from each task."""
    quantiser = index.quantiser
    joined = blocks.meet(index.packs, anchors, "vec_ids", [c for c in anchors.columns if c != "size"], 100 + 16 * windows, block_rows, broadcast_bytes)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, Anchors] = {}
        size = 0
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                name = row.column("block")[0].as_py()
                if name not in states:
                    if size > _HELD_BYTES:  # a task of many blocks hands on what it has found for the former ones
                        yield from (s.found() for s in states.values())
                        states, size = {}, 0
                    states[name] = Anchors(row.column("queries")[0].values, quantiser, k, windows)
                    size += states[name].rows.nbytes + 64 * k * max(windows, 1) * len(states[name].ids)
                states[name].meet(Pack(row.select(_PACK_SCHEMA.names).to_pylist()[0]))
        yield from (s.found() for s in states.values())

    return joined.select("block", *_PACK_SCHEMA.names, "queries").mapInArrow(meet, "row long, window long, vec_id long, score long")


def whole_bound(share: Fraction, up: bool) -> Column:
    """Least whole number from share * score on, or the greatest up to it; whole numbers that can't overflow."""
    a, b = share.numerator, share.denominator
    whole = F.expr(f"positive_score div {b}L - if(positive_score % {b}L < 0, 1L, 0L)")
    part = F.pmod("positive_score", F.lit(b)) * a / b
    return whole * a + (F.ceil(part) if up else F.floor(part)).cast("long")


def mine(
    index: Index, anchor: Column, *, positives: int = 5, negatives: int = 3, low: Fraction = Fraction(1, 2), high: Fraction = Fraction(19, 20), block_rows: int = 4_096, broadcast_bytes: int = 32 << 20
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchor`` says by ``vec_id`` and ``label`` which rows are anchors.  A negative's score lies
    within ``low`` and ``high`` times the positive's, as exact fractions.
    """
    anchors = staged(index.rows().where(anchor).withColumn("row", F.monotonically_increasing_id()), "anchors")
    near = _met(index, anchors.select("row", "vec_id", "label", "size", "ints"), positives, 0, block_rows, broadcast_bytes)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    near = near.withColumn("window", F.row_number().over(best) - 1).where(F.col("window") < positives)
    near = staged(near.select("row", "window", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("window", whole_bound(low, True).alias("low"), whole_bound(high, False).alias("high")))).alias("w"))  # ``positives`` each
    opened = anchors.join(windows, "row").select("row", "vec_id", "label", "size", "ints", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    far = _met(index, staged(opened, "windows"), negatives, positives, block_rows, broadcast_bytes)
    best = Window.partitionBy("row", "window").orderBy(F.desc("score"), F.asc("vec_id"))
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["row", "window"]).join(named, "row").select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
