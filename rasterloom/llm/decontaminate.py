"""Benchmark decontamination: a prefix-filtered set join over item-sized windows.

Every run of ``width`` consecutive item words is a window (a shorter item, if it has
words, is one window); equal windows are one, with the ids of all their items.  For exact
containment the necessary prefix of a window under a rarest-first order is its single rarest
word, so a document can hold a window only where it holds that word.  The rarity order comes
from counts over the whole corpus.  Each document word that is some window's prefix word is met
with the places and sizes that windows have around that word (positional and length bounds) and
looked up as a whole, so a place costs a lookup for each of these few, however many windows
share the word.

A benchmark of at most ``block_words`` words travels as one index (some 300 bytes a window in a
worker): two scans of the corpus, no shuffle of texts; the first sends one count per benchmark
word and task, the second is map-only.  A larger one stays a table: a Bloom filter of all its
windows, ``bloom_bytes`` at most, goes to the documents' scan, which keeps the windows that may
occur; these are joined with the benchmark's on the window's words, windows that many documents
share being spread.  Both forms give the same rows.

Null or wordless texts: no words, no hits, ``contaminated`` false.  Items without words have
no windows; one without an id counts under the empty string.  Repeated items or rows are kept
as they are; ties in rarity go to the smaller word, then the earlier offset.  Each row is judged
by its own whole text, however long, so repeated and null ids stay as they are.  Without
documents there are no rows, without items no hits.  Other columns may have any name:
``decontaminate`` reads ids and texts only, ``keep_clean`` leaves the others as they are.
"""

from __future__ import annotations

import hashlib
from collections import Counter, deque
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_text, hot_among, prepare, spread_join, staged, unused_name

#: A-Z to a-z; every ASCII byte that isn't a digit or a letter separates words.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def _rarest(ranks: list[tuple[int, bytes]], size: int) -> Iterator[int]:
    """The place of the least rank in each run of ``size``; of equals the earliest."""
    held: deque[int] = deque()
    for at, rank in enumerate(ranks):
        while held and ranks[held[-1]] > rank:
            held.pop()
        held.append(at)
        if held[0] <= at - size:
            held.popleft()
        if at >= size - 1:
            yield held[0]


def windows_of(words: list[bytes], size: int) -> Iterator[bytes]:
    """Each run of ``size`` words, joined by spaces, which no word holds."""
    return (b" ".join(words[start : start + size]) for start in range(len(words) - size + 1))


class WindowIndex:
    """Different windows with their items, and around each prefix word the places and sizes that they have."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int, rarity: dict[bytes, int]):
        self.ids: list[str] = []
        self.items: dict[bytes, list[int]] = {}
        around: dict[bytes, set[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            size, own = min(width, len(words)), len(self.ids)
            prefixes = _rarest([(rarity.get(w, 0), w) for w in words], size)
            for start, (window, at) in enumerate(zip(windows_of(words, size), prefixes, strict=True)):
                of = self.items.get(window)
                if of is None:
                    self.items[window] = [own]
                    around.setdefault(words[at], set()).add((at - start, size))
                elif of[-1] != own:
                    of.append(own)
            self.ids.append("" if item_id is None else str(item_id))
        self.around = {word: sorted(places) for word, places in around.items()}

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """[start, end) of the occurring windows, and the items that they are of."""
        around, known, n = self.around, self.items, len(words)
        spans, found = [], set()
        for pos in [i for i, w in enumerate(words) if w in around]:
            for before, size in around[words[pos]]:
                start = pos - before
                if start >= 0 and start + size <= n and (window := b" ".join(words[start : start + size])) in known:
                    spans.append((start, start + size))
                    found.add(window)
        return spans, {self.ids[i] for i in {i for window in found for i in known[window]}}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _verdict(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> dict:
    n_hit = sum(b - a for a, b in spans)
    listed = ",".join(sorted(items))
    return {
        "n_words": n_words,
        "n_hit": n_hit,
        "n_items": len(items),
        "items_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "contaminated": n_hit > 0 and 20 * n_hit >= n_words,
    }


def _rarity(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences of each benchmark word over all documents; a row a word and task at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update([w for w in words_of(text.as_py()) if w in vocabulary])
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counts = texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counts.toLocalIterator()}  # at most the block's vocabulary


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    block_words: int = 1_000_000,
    bloom_bytes: int = 64 << 20,
) -> DataFrame:
    """``doc_id`` and the verdict columns of ``RESULT`` for every document row."""
    prepare(documents.sparkSession)
    texts = as_text(documents, id_col, text_col)
    items = as_text(benchmark, item_col, item_text_col)
    index = _index(texts, items, width, block_words)
    if index is None:
        judged, _ = _joined(texts, "text", items, width, bloom_bytes)
        return judged.select("doc_id", *(c.split()[0] for c in RESULT.split(", ")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            rows = [_judged(text.as_py(), index.value) for text in batch.column(1)]
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist([{"doc_id": d} | r for d, r in zip(ids, rows, strict=True)], schema=schema)

    return texts.mapInArrow(scan, f"doc_id long, {RESULT}")


def _index(texts: DataFrame, items: DataFrame, width: int, block_words: int) -> Broadcast | None:
    """The broadcast index of all items, if they have ``block_words`` words at most (a text of n bytes has (n + 1) / 2)."""
    words = items.agg(F.sum(F.floor((F.octet_length("text") + 1) / 2))).first()[0] or 0
    if words > block_words:
        return None
    rows = [(r.doc_id, r.text) for r in items.collect()]  # bounded by block_words
    return texts.sparkSession.sparkContext.broadcast(WindowIndex(rows, width, _rarity(texts, {w for _, t in rows for w in words_of(t)})))


def _judged(text: str | None, index: WindowIndex) -> dict:
    words = words_of(text)
    spans, items = index.find(words)
    return _verdict(len(words), merged(spans), items)


def _arrow_schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


# ---- a benchmark that stays a table ------------------------------------------------------------


def _hashes(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in windows), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1] | np.uint64(1)


def _probe(bits: np.ndarray, windows: list[bytes], probes: int = 7) -> np.ndarray:
    a, b = _hashes(windows)
    found = np.ones(len(windows), bool)
    for n in range(probes):
        at = (a + np.uint64(n) * b) % np.uint64(8 * len(bits))
        found &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def _item_windows(items: DataFrame, width: int) -> DataFrame:
    """``window, size, item``: every window of every item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                size = min(width, len(words))
                own = sorted(set(windows_of(words, size))) if words else []
                for at in range(0, len(own), _ROWS):
                    part = own[at : at + _ROWS]
                    yield pa.RecordBatch.from_pydict({"window": pa.array(part, pa.binary()), "size": pa.array([size] * len(part), pa.int32()), "item": ["" if item is None else str(item)] * len(part)})

    return items.mapInArrow(cut, "window binary, size int, item string")


_ROWS = 10_000


def _bloom(windows: DataFrame, bloom_bytes: int, probes: int = 7) -> np.ndarray:
    """Filter bits of all windows: each task sends the bytes that it sets, as rows of 64 KB combined by their place."""
    n = windows.count()
    size = max(1 << 10, min(bloom_bytes, 2 * n))
    page = 1 << 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for batch in batches:
            a, b = _hashes(batch.column(0).to_pylist())
            for n in range(probes):
                at = (a + np.uint64(n) * b) % np.uint64(8 * size)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
        yield from _pages({at // page: bits[at : at + page] for at in range(0, size, page)})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(raw, np.uint8)
                held[at] = held[at] | own if at in held else own
        yield from _pages(held)

    sent = windows.select("window").mapInArrow(fill, "page int, bits binary").repartition("page").mapInArrow(unite, "page int, bits binary")
    out = np.zeros(size, np.uint8)
    for row in sent.toLocalIterator():  # bloom_bytes in all
        out[row.page * page : row.page * page + len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _pages(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for at, bits in held.items():
        if bits.any():
            yield pa.RecordBatch.from_pydict({"page": pa.array([at], pa.int32()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _joined(rows: DataFrame, text_col: str, items: DataFrame, width: int, bloom_bytes: int) -> tuple[DataFrame, str]:
    """``rows`` with the verdict columns, judged by a join on windows; the name of the row key that they have got."""
    spark = rows.sparkSession
    windows = staged(_item_windows(items, width), "windows")
    sizes = [r.size for r in windows.select("size").distinct().collect()]  # width at most
    bits = spark.sparkContext.broadcast(_bloom(windows, bloom_bytes))
    at = rows.columns.index(text_col)
    n_words, maybe, key = unused_name(rows, "n_words"), unused_name(rows, "maybe"), unused_name(rows, "row_key")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes_, found = [], []
            for text in batch.column(at):
                words = words_of(text.as_py())
                places = ((start, size, w) for size in sizes for start, w in enumerate(windows_of(words, size)))
                held = []
                while part := list(islice(places, _ROWS)):
                    held += [p for p, ok in zip(part, _probe(bits.value, [w for *_, w in part]), strict=True) if ok]
                sizes_.append(len(words))
                found.append([{"start": s, "size": n, "window": w} for s, n, w in held])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("window", pa.binary())]))
            yield batch.append_column(n_words, pa.array(sizes_, pa.int64())).append_column(maybe, pa.array(found, kind))

    schema = StructType([*rows.schema, *StructType.fromDDL(f"{n_words} long, {maybe} array<struct<start: long, size: long, window: binary>>")])
    held = staged(rows.mapInArrow(look, schema).withColumn(key, F.monotonically_increasing_id()), "maybe")
    places = held.select(F.col(key).alias("row"), F.explode(maybe).alias("p")).select("row", "p.*")
    # First what occurs, once for each window; then its items.
    counts = windows.groupBy("window").count()
    known = counts.select(F.col("window").alias("held"))
    hits = staged(spread_join(places, known, "window", "held", "row", hot=hot_among(places.groupBy("window").count(), "window")).drop("held"), "hits")
    # Spans in order: each adds what lies beyond the furthest end before it.
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop"))))  # one a word and size at most
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(s["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["stop"]).alias("end"))
    covered = hits.groupBy("row").agg(F.aggregate(spans, start, step, lambda acc: acc["n"]).alias("n_hit"))
    of = hits.select("row", "window").distinct()
    listed = spread_join(windows.select(F.col("window").alias("held"), "item"), of, "held", "window", "item", hot=hot_among(counts.select(F.col("window").alias("held"), "count"), "held"))
    named = listed.select("row", "item").distinct().groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_list("item"))), 256).alias("items_sha256"))
    facts = covered.join(named, "row").select(F.col("row").alias("_row"), F.col("n_hit").alias("_hit"), F.col("n_items").alias("_items"), F.col("items_sha256").alias("_listed"))
    n = F.coalesce("_hit", F.lit(0).cast("long"))
    judged = held.join(facts, F.col(key) == F.col("_row"), "left")
    verdict = [F.col(n_words).alias("n_words"), n.alias("n_hit"), F.coalesce("_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("_listed", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n > 0) & (20 * n >= F.col(n_words))).alias("contaminated")]
    return judged.select(*(F.col(f"`{c}`") for c in rows.columns), *verdict), key


def keep_clean(
    documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13, block_words: int = 1_000_000, bloom_bytes: int = 64 << 20
) -> DataFrame:
    """The rows of ``documents`` that aren't contaminated, with the columns they came with.

    Each row is judged where it lies, whatever its id and the benchmark's size; with an index no join, no shuffle.
    """
    prepare(documents.sparkSession)
    items = as_text(benchmark, item_col, item_text_col)
    index = _index(as_text(documents, id_col, text_col), items, width, block_words)
    at = documents.columns.index(text_col)
    if index is None:
        plain = documents.toDF(*(f"c{n}" for n in range(len(documents.columns))))
        judged, _ = _joined(plain, f"c{at}", items, width, bloom_bytes)
        return judged.where("not contaminated").select(*plain.columns).toDF(*documents.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not _judged(text.as_py(), index.value)["contaminated"] for text in batch.column(at)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return documents.mapInArrow(keep, documents.schema)
