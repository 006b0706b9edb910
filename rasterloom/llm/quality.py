"""Quality classifier by positive-unlabelled learning (non-negative unbiased risk).

Trusted positives are training rows marked 1; the unlabelled set is web text as it
comes.  With class prior ``pi`` the risk  pi*R_P(+) + max(0, R_U(-) - pi*R_P(-))  is
minimised by a one-hidden-layer network over statistics of the whole text.  ``pi`` is
estimated from P and U alone: the share of U over the share of P above a threshold of
a first P-against-U score is never below ``pi`` and meets it where negatives run out.

Features come from one pass over the bytes of the text (a 256-bin count) and one over
its words, map-only.  Fitting reads a bounded sample, ``fit_rows`` of each kind, chosen
by a hash of the id; scoring reads every row where it lies.

Null or empty texts have all-zero features and get the model's score for those.  Very long
texts are read whole, in one pass over bytes and one over words.  Equal texts have equal scores,
so repeated rows are scored alike, and ties at the threshold count as good.  Without positives (or
without rows) the model is the constant 0.5, so nothing is predicted good; an empty table gives no
rows.  Other columns are never read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_text, prepare

#: Bytes that get a share of their own.
_MARKS = b"!%*#$&|.,;:\"'-/<>=@_{}\\~^"
N_FEATURES = 16 + len(_MARKS)


def features(text: str | None) -> np.ndarray:
    """Shares and lengths of the whole text; zeros for null, empty or blank ones."""
    out = np.zeros(N_FEATURES)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    if not words:
        return out
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, k = len(raw), len(words)
    distinct = len(set(words))
    lines = raw.split(b"\n")
    upper, lower = count[65:91].sum(), count[97:123].sum()
    high = count[128:].sum()
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, k)
    letters = upper + lower + high
    out[:16] = (
        np.log1p(k) / 10,
        upper / max(letters, 1),
        high / n,
        count[48:58].sum() / n,
        count[32] / n,
        count[10] / n,
        (n - letters - count[48:58].sum() - count[9:14].sum() - count[32]) / n,
        repeats / k,
        distinct / k,
        np.log(distinct) / np.log(k + 1),
        len(set(lines)) / len(lines),
        lengths.mean() / 20,
        lengths.std() / 20,
        (lengths > 20).mean(),
        (lengths == 1).mean(),
        (count[:9].sum() + count[14:32].sum()) / n,
    )
    out[16:] = count[np.frombuffer(_MARKS, np.uint8)] / k
    return out


def feature_matrix(texts: pa.Array) -> np.ndarray:
    rows = [features(t.as_py()) for t in texts]
    return np.stack(rows) if rows else np.zeros((0, N_FEATURES))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    """tanh network; ``scale`` standardises signed roots of the features."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    prior: float = 0.5

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((np.sqrt(np.abs(x)) - self.mean) / self.scale, -6, 6)

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return _sigmoid(np.tanh(self.inputs(x) @ self.w1 + self.b1) @ self.w2 + self.b2)


def _start(x: np.ndarray, hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    roots = np.sqrt(np.abs(x))
    return Model(roots.mean(0), roots.std(0) + 0.02, rng.normal(0, 0.3, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden), 0.0)


def _descend(model: Model, p: np.ndarray, u: np.ndarray, slopes, steps: int, rate: float, decay: float) -> Model:
    """Adam on full batches; ``slopes(zp, zu)`` gives the risk's derivative at each logit."""
    xs = np.vstack([model.inputs(p), model.inputs(u)])
    theta = [model.w1, model.b1, model.w2, np.array([model.b2])]
    m = [np.zeros_like(t) for t in theta]
    v = [np.zeros_like(t) for t in theta]
    for step in range(1, steps + 1):
        h = np.tanh(xs @ theta[0] + theta[1])
        z = h @ theta[2] + theta[3][0]
        d = np.concatenate(slopes(z[: len(p)], z[len(p) :]))
        back = np.outer(d, theta[2]) * (1 - h * h)
        grads = [xs.T @ back + decay * theta[0], back.sum(0), h.T @ d + decay * theta[2], np.array([d.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            theta[i] = theta[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return Model(model.mean, model.scale, theta[0], theta[1], theta[2], float(theta[3][0]), model.prior)


def estimate_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """Least share of U over share of P above the thresholds that keep 50 to 97 % of P."""
    cuts = np.quantile(p_scores, np.linspace(0.03, 0.5, 48))
    ratio = [(u_scores >= c).mean() / max((p_scores >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def _prior(p: np.ndarray, u: np.ndarray, hidden: int, steps: int, rate: float, seed: int) -> float:
    """Contrast P with U on one half of each, estimate on the other, and the other way round."""

    def contrast(zp: np.ndarray, zu: np.ndarray):
        return -_sigmoid(-zp) / len(zp) / 2, _sigmoid(zu) / len(zu) / 2

    found = []
    for side in (0, 1):
        near, far = (p[side::2], u[side::2]), (p[1 - side :: 2], u[1 - side :: 2])
        if min(map(len, (*near, *far))) == 0:
            return estimate_prior(np.ones(1), np.ones(1))
        model = _descend(_start(np.vstack(near), hidden, seed), *near, contrast, steps, rate, 1e-3)
        found.append(estimate_prior(model.scores(far[0]), model.scores(far[1])))
    return float(np.mean(found))


def fit(p: np.ndarray, u: np.ndarray, *, hidden: int = 12, steps: int = 400, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Model:
    """nnPU network from feature rows of positives and of unlabelled text."""
    if not len(p) or not len(u):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), 0.0)

    pi = _prior(p, u, hidden, steps // 4, rate, seed)

    def nnpu(zp: np.ndarray, zu: np.ndarray):
        negative = _softplus(zu).mean() - pi * _softplus(zp).mean()
        if negative < 0:  # the estimate went below zero: step back up, as the non-negative risk does
            return pi * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)
        return (-pi * _sigmoid(-zp) - pi * _sigmoid(zp)) / len(zp), _sigmoid(zu) / len(zu)

    model = _descend(_start(np.vstack([p, u]), hidden, seed), p, u, nnpu, steps, rate, decay)
    model.prior = pi
    return model


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("long").cast("string")) % 4 == 2, F.lit(False))


def _hashed_below(id_column: Column, rows: int, total: int) -> Column:
    """About ``rows`` of ``total`` rows, by a hash of the id."""
    if total <= rows:
        return F.lit(True)
    return F.pmod(F.xxhash64(id_column, F.lit("fit")), F.lit(1_000_003)) < int(1_000_003 * rows / total)


def _sample(texts: DataFrame, bound: int) -> np.ndarray:
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = feature_matrix(batch.column(0))
            yield pa.RecordBatch.from_pydict({"f": pa.array([r.tobytes() for r in rows], pa.binary())})

    got = texts.select("text").mapInArrow(vectors, "f binary").limit(bound).collect()  # at most bound rows of N_FEATURES doubles
    return np.array(sorted(bytes(r.f) for r in got), dtype=object) if not got else np.stack([np.frombuffer(f, np.float64) for f in sorted(bytes(r.f) for r in got)])


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", fit_rows: int = 8_000, **options) -> Model:
    """Fit on at most ``fit_rows`` positives and as many unlabelled rows, none of them held out."""
    prepare(documents.sparkSession)
    texts = as_text(documents, id_col, text_col).where(~held_out(F.col("doc_id")))
    trusted = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("labelled_id"), F.col(f"`{label_col}`").alias("mark"))
    trusted = trusted.where((F.col("mark") == 1) & F.col("labelled_id").isNotNull() & ~held_out(F.col("labelled_id"))).select("labelled_id")
    few = trusted.where(_hashed_below(F.col("labelled_id"), fit_rows, trusted.count())).limit(2 * fit_rows).distinct()
    positives = texts.join(F.broadcast(few), F.col("doc_id") == F.col("labelled_id"), "left_semi")  # at most 2 * fit_rows ids
    p = _sample(positives, fit_rows)
    u = _sample(texts.where(_hashed_below(F.col("doc_id"), fit_rows, max(1, documents.count() * 3 // 4))), fit_rows)
    return fit(p, u, **options)


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, map-only."""
    prepare(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.scores(feature_matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = as_text(documents, id_col, text_col).mapInArrow(judge, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: Model, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows scored at ``threshold`` or more, with the columns they came with, map-only."""
    prepare(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(feature_matrix(batch.column(at))) >= threshold, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
