"""Hard negatives beside a plain loop over all pairs."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import negatives


def plain(rows, every=50, positives=5, count=3):
    """Whole-number scores of all pairs; rows of the anchor's own id are left out."""
    usable = [(i, y, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v, y in rows if None not in (i, v, y) and all(x is not None and np.isfinite(x) and abs(x) < 1e300 for x in v)]
    score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)  # noqa: B905, E731
    out = []
    for q, label, a in usable:
        if q % every:
            continue
        scored = sorted((-score(a, b), i, y) for i, y, b in usable if i != q)
        for p, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fit = [(s, i) for s, i, y in scored if y != label and 50 * -p <= 100 * -s <= 95 * -p][:count]
            out += [(q, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(i, v, y, "x") for i, v, y in rows], "vec_id long, embedding array<double>, label int, row string")
    found = negatives.mine(negatives.build_index(table, sample_rows=options.pop("sample_rows", 4096)), F.col("vec_id") % 50 == 0, **options)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("options", [{}, {"block_rows": 2}, {"broadcast_bytes": 0, "block_rows": 3}, {"sample_rows": 5}])
def test_mined(spark, options):
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(0, 0.2, 8).round(3).tolist(), int(rng.integers(0, 3))) for i in range(420)]
    rows += [(1000 + i, rows[3][1], i % 3) for i in range(12)]  # many ties, of all labels
    rows += [(2000, None, 1), (2050, [], 1), (2100, [None] + [0.1] * 7, 0), (2150, [float("nan")] * 8, 0), (2200, [float("inf")] * 8, 2), (None, rows[0][1], 1), (2250, rows[5][1], None), (2300, [0.0] * 8, 1)]
    rows += [(7, rows[9][1], 2), (50, rows[9][1], 0)]  # repeated ids: of a candidate and of an anchor
    assert mined(spark, rows, **options) == plain(rows)


def test_lengths_and_large_values(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, int(rng.integers(0, 7))).tolist(), i % 2) for i in range(150)]
    rows += [(150, [1e7, -3.5], 0), (151, [1.0, 2.0], 1), (200, [2e13, 1.0, 7.0], 0), (201, [1.9e13, 1.0], 1), (202, [2e13, 3.0], 0), (250, [0.0] * 4, 1), (300, [1e30], 0), (301, [5e-324, 3.0], 1), (302, [1e31], 0), (303, [1e29], 1)]
    assert mined(spark, rows) == plain(rows)


def test_few_rows(spark):
    one = [(0, [1.0, 0.5], 1)]
    assert mined(spark, one) == [] == mined(spark, [(0, [1.0], 1), (1, [1.0], 1)])
    two = [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (3, [0.4], 2)]
    assert mined(spark, two) == plain(two) == [(0, 1, 1, 2, 65536, 58880)]
    table = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert negatives.mine(negatives.build_index(table), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_enclose_and_filter():
    """Every score lies between its ends, and few pairs are scored."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 1, (4000, 64))
    rows = np.floor(256 * vectors / np.sqrt((vectors**2).sum(1))[:, None])
    quantiser = negatives.Quantiser.fit(rows[:2000])
    codes, rests = quantiser.encode(rows)
    labels = rng.integers(0, 10, 4000)
    pack = negatives.Pack({"vec_ids": np.arange(4000).astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "size": 64, "ints": rows.astype("<i4").tobytes(), "codes": codes.tobytes(), "rests": rests.tobytes()})
    import pyarrow as pa

    at = np.arange(0, 4000, 50)
    block = pa.StructArray.from_arrays([pa.array(at), pa.array(at), pa.array(labels[at]), pa.array([rows[i].tobytes() for i in at])], names=["row", "vec_id", "label", "ints"])
    state = negatives.Anchors(block, quantiser, 5, 0)
    for part, low, high in state._enclosed(pack):
        true = rows @ state.rows[part].T
        assert (low <= true).all() and (true <= high).all() and (high - low).mean() < 0.25 * 65536
    state.meet(pack)
    assert state.evaluated < 0.05 * len(at) * 4000
    order = [sorted(((-int(rows[q] @ rows[i]), i) for i in range(4000) if i != q and labels[i] == labels[q]))[:5] for q in at]
    assert [(int(s), int(i)) for s, i in zip(state.best.score, state.best.id, strict=True)] == [(-s, i) for x in order for s, i in x]


def test_window_ends_are_exact(spark):
    scores = [-41, -40, -1, 0, 1, 19, 20, 21, 2**63 - 1, -(2**63)]
    table = spark.createDataFrame([(s,) for s in scores], "positive_score long")
    for share in (Fraction(1, 2), Fraction(19, 20)):
        up, down = (negatives.whole_bound(share, up) for up in (True, False))
        got = {r[0]: (r[1], r[2]) for r in table.select("positive_score", up, down).collect()}
        assert got == {s: (-(-s * share.numerator // share.denominator), s * share.numerator // share.denominator) for s in scores}
