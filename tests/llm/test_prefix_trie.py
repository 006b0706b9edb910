"""The prefix trie beside plain dictionaries of whole paths."""

import hashlib
import random
import re
import zlib

import pytest

from rasterloom.llm import catalog, prefix_trie
from rasterloom.llm.prefix_trie import Graft


def plain(rows, graft=None):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).digest()[:16], text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        if graft:
            base, h = c - (abs(c) % graft.every) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % graft.heads
            turns = own.get(base, [])[:h] + turns[h:]
        paths[c] = tuple(turns)
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)

    def below(path):
        yield path
        for kid in kids.get(path, []):
            yield from below(kid)

    out = []
    for path, convs in members.items():
        under = list(below(path))
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in under if p)
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == path)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids.get(path, [])), sum(p not in kids for p in under), saved, hashlib.sha256(ends.encode()).hexdigest(), path[-1] if path else (None, None)))
    return sorted(out, key=repr)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def built(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, `key` string")
    nodes = prefix_trie.with_turns(prefix_trie.build(table, **options), table)
    return sorted(((*(r[n] for n in NAMES), (r.role, r.text)) for r in nodes.collect()), key=repr)


def some_rows(seed, ids, longest=6):
    draw, rows = random.Random(seed), []
    for c in ids:
        for t in range(draw.randrange(1, longest)):
            rows.append((c, draw.choice([t, t, t, None, 2]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a b", "a b", "c\td e", "", None, "é"])))
    draw.shuffle(rows)
    return rows


@pytest.fixture
def many_tasks(spark):
    """No partitions are put together, so that there is more than one round of merges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("graft", [None, Graft(), Graft(5, 3)])
@pytest.mark.parametrize("options", [{}, {"held_nodes": 7, "fan": 2}])
def test_trie(spark, many_tasks, graft, options):
    rows = some_rows(13, [*range(-45, 130), *range(1000, 1500, 7)]) + [(None, 1, "user", "lost"), (3, None, None, None), (10**15, 0, "user", "far")]
    assert built(spark, rows, graft=graft, **options) == plain(rows, graft)


def test_copies_and_a_long_conversation(spark, many_tasks, monkeypatch):
    """A third of all conversations are equal, one has 700 turns, and end lists travel in small pieces."""
    monkeypatch.setattr(prefix_trie, "_ENDS_BYTES", 40)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 2) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(1, 400, 2)] + [(999, t, "user", f"word {t % 7}") for t in range(700)]
    for options in ({}, {"held_nodes": 50, "fan": 2}):
        assert built(spark, rows, **options) == plain(rows)


def test_very_long_text_and_empty_table(spark):
    rows = [(20, 0, "user", "word " * 300_000), (21, 0, "user", "word " * 300_000), (40, 0, "user", "u"), (59, 0, "user", "only"), (59, 0, "user", "only")]
    assert built(spark, rows, graft=Graft()) == plain(rows, Graft())
    assert built(spark, []) == []


def test_turnless(spark):
    """All own turns are left out and the base is absent: it ends at the root."""
    conv = next(c for c in range(61, 80) if Graft().taken(c) == 3)
    rows = [(conv, 0, "user", "a"), (conv, 1, "user", "b")]
    got = built(spark, rows, graft=Graft())
    assert got == plain(rows, Graft()) and len(got) == 1 and got[0][:5] == (conv, 0, None, 1, 0)


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in catalog.op13_prefix_trie(spark, sf_dir).select(*NAMES).collect()), key=repr)
    assert got == sorted((x[:-1] for x in plain(rows, Graft())), key=repr)
