"""Near copies of the pipeline's stage, against brute force over pairs."""

import itertools
import re

import numpy as np

import corpus_pipeline
from rasterloom.llm import near_copies


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    sets, up = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * either and up[i] != up[j]:
            a, b = sorted((up[i], up[j]))
            up = [a if u == b else u for u in up]
    return sorted(min(rows[i][0] for i in range(len(rows)) if up[i] == u) for u in set(up))


def variants():
    """Near copies from 0.7 to 0.95, chains of them, a class of many, and a passage that all share."""
    rng, rows = np.random.default_rng(4), [None, "", " \n", "One two", "ONE two", "a b c d e", "a b c d e f", LINE]
    word = lambda: f"w{int(rng.integers(0, 3000))}"
    for n in (12, 30, 80, 200, 400):
        for swaps in range(1, 9):
            base = [word() for _ in range(n)]
            rows.append(" ".join(base))
            for _ in range(2):
                for at in rng.choice(n, max(1, swaps * n // 220), replace=False):
                    base[int(at)] = word()
                rows.append(" ".join(base))
    base = [word() for _ in range(150)]
    for _ in range(60):
        own = list(base)
        own[int(rng.integers(0, 150))] = word()
        rows.append(" ".join(own))
    rows += [LINE + " " + " ".join(word() for _ in range(int(rng.integers(1, 20)))) for _ in range(60)]
    return rows


LINE = " ".join(f"line{i}" for i in range(40))


def test_stage_drops_every_near_copy(spark, sf_dir):
    rows = list(enumerate(variants()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = plain_kept(rows)
    got = corpus_pipeline.simhash_stage(spark, docs, sf_dir)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want


def test_rows_are_judged_by_their_own_text(spark):
    rows = [(1, "some words of a text here"), (7, "some words of a text here"), (7, "quite another text of other words"), (7, "quite another text of other words"), (None, "lonely words are in this row"), (None, "further lonely words in that row")]
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in [rows[0], rows[2], rows[4], rows[5]])


def test_large_groups_are_split(spark, monkeypatch):
    """One class of many near copies beside texts that share half of it: whole in parts of a few rows."""
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(260):
        own = list(base)
        for at in rng.choice(120, 2 if i < 200 else 5, replace=False):
            own[int(at)] = f"x{int(rng.integers(0, 10**6))}"
        rows.append((i, " ".join(own)))
    real = near_copies._parts_of_runs
    monkeypatch.setattr(near_copies, "_parts_of_runs", lambda runs: real(runs, block=16))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_band_and_signature_bounds():
    """The least equal bytes and the bands hold for pairs at the threshold."""
    assert near_copies.least_equal(4, 5) == 148
    rng = np.random.default_rng(9)
    for n in (40, 400, 4000):
        for _ in range(40):
            both = rng.integers(0, 1 << 63, n, np.uint64)
            left, right = (np.unique(np.concatenate((both, rng.integers(0, 1 << 63, n // 8, np.uint64)))) for _ in range(2))
            a, b = near_copies.minima_of(left), near_copies.minima_of(right)
            marks = [np.frombuffer(near_copies.signature_of(m), np.uint8) for m in (a, b)]
            assert (marks[0] == marks[1]).sum() >= 148 and (near_copies.bands_of(a) == near_copies.bands_of(b)).any()
