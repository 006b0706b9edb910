"""Each row is judged alone, whatever its id and the number of benchmark blocks."""

import hashlib
import random
import time

import pytest

from rasterloom.llm import decontaminate


@pytest.mark.parametrize("block_words", [1, 2_000_000])
def test_repeated_and_null_ids(spark, block_words):
    first, second = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(None, first), (None, "clean text"), (7, second), (7, "another clean text"), (8, first + " " + second)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench, block_words=block_words).collect()
    order = lambda t: (t[0] or 0, t[1:])
    want = [(None, 20, 20, 1, True), (None, 2, 0, 0, False), (7, 20, 20, 1, True), (7, 3, 0, 0, False), (8, 40, 40, 2, True)]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in got), key=order) == sorted(want, key=order)
    kept = decontaminate.keep_clean(docs, bench, block_words=block_words).collect()
    assert sorted(r.text for r in kept) == ["another clean text", "clean text"]


def plain(text, items, width=13):
    """Spans and items by comparing every window at every place."""
    words, hit, found = decontaminate.words_of(text), set(), set()
    for item_id, item in items:
        own = decontaminate.words_of(item)
        size = min(width, len(own))
        for window in {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else ():
            for start in range(len(words) - size + 1):
                if tuple(words[start : start + size]) == window:
                    hit |= set(range(start, start + size))
                    found.add(str(item_id))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("options", [{"block_words": 1}, {"block_words": 1, "bloom_bytes": 1}, {}])
def test_few_words_in_many_orders(spark, options):
    """Texts of two words: every window has the same prefix word, and windows overlap everywhere."""
    draw = random.Random(10)
    some = lambda n: " ".join(draw.choice("ab") for _ in range(n))
    items = [(n, some(draw.randrange(1, 30))) for n in range(40)] + [(77, "a " * 40), (78, "a " * 40), (79, "a")]
    texts = [some(draw.randrange(0, 120)) for _ in range(30)] + ["a " * 60, "c " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(docs, bench, **options).collect()}
    assert got == {n: plain(t, items) for n, t in enumerate(texts)}


def test_repeats_take_linear_time():
    began = time.process_time()
    index = decontaminate.WindowIndex([(1, "a " * 100_000)], 13, {b"a": 100_000})
    spans, found = index.find(decontaminate.words_of("a " * 100_000))
    assert decontaminate.merged(spans) == [(0, 100_000)] and found == {"1"}
    index = decontaminate.WindowIndex([(n, "true") for n in range(4_000)], 13, {})
    assert len(index.find([b"true"] * 4_000)[1]) == 4_000
    draw = random.Random(1)
    index = decontaminate.WindowIndex([(1, " ".join(draw.choice("ab") for _ in range(50_000)))], 13, {})
    index.find([draw.choice([b"a", b"b"]) for _ in range(50_000)])
    assert time.process_time() - began < 6
