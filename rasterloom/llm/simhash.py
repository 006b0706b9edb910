"""SimHash near-duplicates found with Golay-code fuzzy hashing.

A fingerprint is cut into segments of 22, 21 and 21 bits, each padded to a 23-bit word.
The binary [23,12] Golay code is perfect: every word is within 3 bits of exactly one
codeword.  A word's keys are the indices of the codewords that it and its 23 one-bit
neighbours decode to (1 key if it lies within 2 bits of a codeword, else 6).  Two words
up to 2 bits apart have a common neighbour (or are neighbours or equal), so they share
a key.  With at most 4 differing bits over three segments, at least two segments differ
in at most 2 bits (two segments with 3 or more would make 6), so every link shares a key
in both members of one of the three segment pairs: joining on 24-bit pair keys loses no
link.  Candidates are then verified on all 64 bits.

Scale: texts are fingerprinted where they lie; equal fingerprints collapse with map-side
combining; keys are numbers of a few bytes.  Keys are dealt by hash and sorted, and a
worker streams over the runs of equal keys, verifying in vectorised blocks and keeping
a spanning forest of each run (``n - 1`` links at most, never all pairs).  A run of over
``block`` fingerprints is not handled by one task: its rows go on, numbered by blocks,
to a second step where each pair of blocks is a group of its own.

Null or wordless texts have fingerprint zero and are linked like any other; very long ones
are read whole, a task holding one batch of texts.  Repeated rows share a class.  Tied bits
(set in exactly half of the hashes) are 0.  An empty table gives an empty one.  Only the id
and text columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, prepare, shuffle_partitions, spread_join, staged
from .components import connected_components

#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the binary Golay code.
_GENERATOR = 0b101011100011
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
_PAIRS = ((0, 1), (0, 2), (1, 2))


def _remainders(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        left ^= ((left >> np.uint32(bit)) & np.uint32(1)) * np.uint32(_GENERATOR << (bit - 11))
    return left


class Golay:
    """Codeword indices (the 12 message bits) of 23-bit words."""

    def __init__(self):
        weights = [0] + [1 << i for i in range(23)]
        weights += [1 << i | 1 << j for i in range(23) for j in range(i)]
        weights += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
        errors = np.array(weights, np.uint32)  # the 2048 patterns of up to 3 bits, one for each syndrome
        self.error = np.zeros(2048, np.uint32)
        self.error[_remainders(errors)] = errors

    def index(self, words: np.ndarray) -> np.ndarray:
        words = words.astype(np.uint32)
        return ((words ^ self.error[_remainders(words)]) >> np.uint32(11)).astype(np.uint16)

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n, 6) codeword indices; places without a key of their own repeat the first one."""
        words = words.astype(np.uint32)
        flips = np.array([0] + [1 << i for i in range(23)], np.uint32)
        every = np.sort(self.index(words[:, None] ^ flips[None, :]), axis=1)
        fresh = np.ones(every.shape, bool)
        fresh[:, 1:] = every[:, 1:] != every[:, :-1]
        rank = np.cumsum(fresh, axis=1) - 1
        out = np.repeat(every[:, :1], 6, axis=1)
        row, col = np.nonzero(fresh)
        out[row, rank[row, col]] = every[row, col]
        return out


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    raw = text.encode("utf-8", "surrogatepass").lower() if text else b""
    words = raw.split()  # bytes.split and bytes.lower know ASCII only: 0x20, 0x09-0x0D and A-Z
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), seed)]
    else:
        joined = b" ".join(words)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], stops[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (stops[shingle - 1 :] - 1).tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row, map-only."""
    prepare(documents.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return as_text(documents, id_col, text_col).mapInArrow(hashed, "doc_id long, fp long")


def pair_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All (key, row) of the fingerprints: the pair of segments above two codeword indices."""
    values = fps.view(np.uint64)
    parts = [golay.keys((values >> np.uint64(at)) & np.uint64((1 << size) - 1)) for at, size in _SEGMENTS]
    keys, rows = [], []
    for n, (a, b) in enumerate(_PAIRS):
        both = (np.int64(n) << 24) | (parts[a].astype(np.int64)[:, :, None] << 12) | parts[b].astype(np.int64)[:, None, :]
        both = np.sort(both.reshape(len(values), -1), axis=1)
        own = np.ones(both.shape, bool)
        own[:, 1:] = both[:, 1:] != both[:, :-1]
        row, col = np.nonzero(own)
        keys.append(both[row, col])
        rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


class Sets:
    """Union-find over places 0..n-1, kept only while one run or pair of blocks is handled."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(left: np.ndarray, right: np.ndarray | None, distance: int, strip: int = 256) -> list[tuple[int, int]]:
    """Spanning links within ``left``, or between ``left`` and ``right``, at most ``distance`` bits apart."""
    whole = left if right is None else np.concatenate([left, right])
    first = 0 if right is None else len(left)
    values, sets, out = whole.view(np.uint64), Sets(len(whole)), []
    for at in range(0, len(left), strip):
        rows = values[at : at + strip]
        start = at if right is None else first
        near = np.bitwise_count(rows[:, None] ^ values[None, start:]) <= distance
        for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            if at + i != start + j and sets.join(at + i, start + j):
                out.append((int(whole[at + i]), int(whole[start + j])))
    return out


_LINKS = pa.schema([("kind", pa.int32()), ("src", pa.int64()), ("dst", pa.int64()), ("part", pa.int64())])


def _links_of_runs(distance: int, block: int):
    """Rows sorted by key in, links out (kind 0).  Long runs: rows (1: key, fp, block) and a total (2: key, blocks)."""

    def emit(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _LINKS, strict=True)], schema=_LINKS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        seen: set[tuple[int, int]] = set()
        key, held, blocks = None, np.zeros(0, np.int64), 0

        def close() -> None:
            nonlocal blocks, held
            if blocks:
                out.extend((1, key, int(f), blocks) for f in held)
                out.append((2, key, 0, blocks + 1))
            elif len(held) > 1:
                for a, b in forest(held, None, distance):
                    link = (min(a, b), max(a, b))
                    if link not in seen:
                        seen.add(link)
                        out.append((0, *link, 0))
            blocks, held = 0, held[:0]

        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            starts, stops = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
            # Runs of one row inside the batch have no partner: only the first and last can go on.
            todo = np.flatnonzero(stops - starts > 1)
            todo = np.unique(np.concatenate((todo, [0, len(starts) - 1])))
            for n in todo.tolist():
                a, b = starts[n], stops[n]
                if key != keys[a]:
                    close()
                    key = int(keys[a])
                held = np.concatenate((held, fps[a:b]))
                while len(held) > block:
                    out.extend((1, key, int(f), blocks) for f in held[:block])
                    held, blocks = held[block:], blocks + 1
            if len(seen) > 500_000:
                seen.clear()
            if len(out) > 20_000:
                yield emit(out)
                out.clear()
        close()
        yield emit(out)

    return stream


def _links_of_blocks(distance: int):
    """One group: two blocks of a long run (or one block with itself)."""

    def pair(group: pa.Table) -> pa.Table:
        fps, part = group.column("fp").to_numpy(), group.column("part").to_numpy()
        low = part == part.min()
        left, right = fps[low], fps[~low]
        single = group.column("lo")[0].as_py() == group.column("hi")[0].as_py()
        found = forest(left, None, distance) if single else forest(left, right, distance) if len(right) else []
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return pair


def links(distinct: DataFrame, *, distance: int = 4, block: int = 4096) -> DataFrame:
    """``src, dst``: links that connect the same fingerprints as all pairs within ``distance`` do."""
    if distance > 4:
        raise ValueError("the keys cover at most 4 differing bits")
    spark = distinct.sparkSession
    prepare(spark)
    golay = Golay()

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys, rows = pair_keys(part, golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(part[rows], pa.int64())], names=["key", "fp"])

    keys = distinct.select("fp").mapInArrow(keyed, "key long, fp long").select(F.col("key").cast("int").alias("key"), "fp")
    dealt = keys.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    found = staged(dealt.mapInArrow(_links_of_runs(distance, block), "kind int, src long, dst long, part long"), "links")
    near = found.where("kind = 0").select("src", "dst")
    if found.where("kind = 2").isEmpty():
        return near
    long_rows = found.where("kind = 1").select(F.col("src").alias("key"), F.col("dst").alias("fp"), "part")
    totals = found.where("kind = 2").select(F.col("src").alias("total_key"), F.col("part").alias("blocks"))
    with_total = long_rows.join(totals, F.col("key") == F.col("total_key"))
    pairs = with_total.select("key", "fp", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pairs = pairs.select("key", "fp", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    more = pairs.groupBy("key", "lo", "hi").applyInArrow(_links_of_blocks(distance), "src long, dst long")
    return near.unionAll(staged(more, "links"))


def classes(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row.

    Joins on a fingerprint or class that many rows have (wordless texts, one huge group of
    copies) are spread.  A class whose ids are all null has a null component_id.
    """
    printed = staged(fingerprints(documents, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed), "fingerprints")
    distinct = staged(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links(distinct, distance=distance, block=block))
    grouped = staged(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "grouped")
    least = grouped.groupBy(F.col("root").alias("class")).agg(F.min("least").alias("component_id"))
    of_print = staged(spread_join(grouped, least, "root", "class", "fp").select(F.col("fp").alias("class_fp"), "component_id"), "classes")
    joined = spread_join(printed, of_print, "fp", "class_fp", "doc_id")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
