"""SentencePiece encoding and decoding with exact N-best segmentation.

The model file gives pieces and additive scores.  All pieces that occur in a text form a
lattice.  A forward Viterbi pass gives every position its best score from the start;
searching backward from the end, that score is an exact heuristic, so A-star pops whole
segmentations in the order of their scores.

Scores are the file's own if they are log-probabilities (unigram files).  A merge file has
only ranks (0, -1, -2, ...), whose sums would favour many early merges; ranks become
log-probabilities by the Zipf-Mandelbrot rule, p ~ 1 / (rank + 2.7).  Nothing is fitted.
``scores="file"`` takes the ranks as they are.

No piece holds a word mark after another character, so a text's lattice is a chain of the
lattices of its words, and the forward pass of a word can be kept and used again.  For the
N-best of a whole text, each word has a gap: the loss of its best alternative, read off the
forward pass along the best path.  Only the ``n - 1`` words of the smallest gaps can differ
from the best path in the N-best (changing one of them at a time already gives ``n - 1``
better texts), so the backward search runs on these words alone.  The best segmentation comes
whole, the others as what they change in it (``expanded`` makes them whole).

Map-only.  A worker keeps a bounded number of words.  Characters that are no piece become an
unknown node (the least score of any piece, less 10) and are written as their UTF-8 bytes.
Null and empty texts have no pieces, score 0 and one (empty) segmentation.  Very long texts and
words are taken whole: a word of n letters takes time and memory in proportion to n.  Decoding
gives the text back exactly, save that U+2581, the word mark itself, comes back as a space.
Ties go to the search: the longer last piece first, deterministic on every machine.  Repeated
rows give equal rows, an empty table an empty one; only the id and text columns are read, so
others may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import as_text, prepare

MARK = "▁"
#: Word parts that a worker keeps for each five words that it keeps.
_PARTS_PER_WORD = 0.2
#: Longer words are not kept.
_KEPT_LENGTH = 48
_FAR = 1e30
_ZIPF = 2.7
_LETTERS = r"[^\W\d_" + MARK


def _fields(raw: bytes) -> dict[int, object]:
    """The last value of each field of a serial message: bytes, or the number of a varint."""

    def number(at: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[at] & 0x7F) << shift
            shift += 7
            at += 1
            if raw[at - 1] < 0x80:
                return n, at

    out, at = {}, 0
    while at < len(raw):
        tag, at = number(at)
        if tag & 7 == 0:
            out[tag >> 3], at = number(at)
            continue
        size, at = number(at) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], at)
        out[tag >> 3], at = raw[at : at + size], at + size
    return out


def marks_spaces_only(model: bytes) -> bool:
    """Whether the model's rule for normalising is: a mark before the text and for each space, and nothing else."""
    rule = _fields(_fields(model).get(3, b""))  # the normaliser's specification
    charsmap, prefix, squeeze, escape = rule.get(2, b""), rule.get(3, 1), rule.get(4, 1), rule.get(5, 1)
    suffix = _fields(_fields(model).get(2, b"")).get(24, 0)  # the trainer's: marks after words
    return charsmap == b"" and bool(prefix) and not squeeze and bool(escape) and not suffix


class _Words(dict):
    """Word to its packed best path, made on demand; two generations of at most ``kept``.

    Packed: the gap as a double, then the ids as 32-bit numbers, in one bytes object.
    """

    def __init__(self, make, kept: int):
        super().__init__()
        self.make, self.kept, self.older = make, kept, {}

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
            if len(word) > _KEPT_LENGTH:
                return found
        if len(self) >= self.kept:
            self.older = dict(self)
            self.clear()
        self[word] = found
        return found


_GAP = struct.Struct("<d")


class Segmenter:
    def __init__(self, model: bytes, scores: str = "log", kept_words: int = 220_000):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.sp, size = sp, sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        plain = [i for i in range(size) if not special[i] and not sp.is_byte(i)]
        output = [b"" if special[i] else names[i].replace(MARK, " ").encode() for i in range(size)]
        for b, i in self.byte_ids.items():
            output[i] = bytes([b])
        self.buffer = np.frombuffer(b"".join(output), np.uint8)
        self.lengths = np.array(list(map(len, output)), np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.names = names
        value = _scores([sp.get_score(i) for i in range(size)], plain, scores)
        #: Characters to (next characters, id or -1, score): a step a character.
        self.trie: dict[str, list] = {}
        self.longest = max(len(names[i]) for i in plain)
        for i in plain:
            kids = self.trie
            for c in names[i]:
                node = kids.setdefault(c, [{}, -1, 0.0])
                kids = node[0]
            node[1:] = i, value[i]
        self.unknown_score = min(value[i] for i in plain if value[i] > -1e8) - 10.0
        # Where the lattice falls apart: before a mark that follows something else, and
        # between a letter and what is none, as long as no piece goes across.
        self.by_words = not any(MARK in names[i].lstrip(MARK) for i in plain)
        letter = re.compile(_LETTERS + "]")
        odd = {a for i in plain for a, b in zip(names[i], names[i][1:], strict=False) if letter.match(a) and not letter.match(b)}
        while more := {a for i in plain for a, b in zip(names[i], names[i][1:], strict=False) if letter.match(a) and a not in odd and b in odd}:
            odd |= more
        kept, other = _LETTERS + re.escape("".join(sorted(odd))) + "]", r"[\W\d_" + re.escape("".join(sorted(odd))) + "]"
        self.cut = re.compile(f"{MARK}*(?:(?!{MARK}){other})*{kept}+|{MARK}*(?:(?!{MARK}){other})+|{MARK}+", re.S)
        self.runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S)
        # Ids tell their score; an unknown character's is told by the first byte of its UTF-8 form.
        self.scores = np.zeros(size)
        self.scores[plain] = [value[i] for i in plain]
        self.scores[[i for b, i in self.byte_ids.items() if not 0x80 <= b < 0xC0] or [self.unknown_id]] = self.unknown_score
        self.plain_form = marks_spaces_only(self.sp.serialized_model_proto())
        self.chunks = _Words(self._path, int(kept_words * _PARTS_PER_WORD))
        self.words = _Words(lambda word: self._joined(self.cut.findall(MARK + word)), kept_words)

    def _normal(self, text: str) -> str:
        return self.sp.normalize(text)

    def normalised(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if self.plain_form else self._normal(text)

    def _ids(self, piece: int) -> tuple[int, ...]:
        if piece >= 0:
            return (piece,)
        if not self.byte_ids:
            return (self.unknown_id,)
        return tuple(self.byte_ids[b] for b in chr(-1 - piece).encode("utf-8", "surrogatepass"))

    def _path(self, chunk: str) -> bytes:
        """Forward Viterbi: the best path, packed with its gap to the next best."""
        n, longest, trie = len(chunk), self.longest, self.trie
        best, gap, came, arc = [-_FAR] * (n + 1), [_FAR] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for start in range(n):
            base, node, end = best[start], trie.get(chunk[start]), start + 1
            if node is None or node[1] < 0:
                lead = base + self.unknown_score - best[end]
                if lead > 0:
                    best[end], gap[end], came[end], arc[end] = base + self.unknown_score, lead, start, -1 - ord(chunk[start])
                elif -lead < gap[end]:
                    gap[end] = -lead
                if node is None:
                    continue
            kids, piece, score = node
            if piece >= 0:
                lead = base + score - best[end]
                if lead > 0:
                    best[end], gap[end], came[end], arc[end] = base + score, lead, start, piece
                elif -lead < gap[end]:
                    gap[end] = -lead
            for c in chunk[end : start + longest]:
                node = kids.get(c)
                if node is None:
                    break
                kids, piece, score = node
                end += 1
                if piece >= 0:
                    lead = base + score - best[end]
                    if lead > 0:
                        best[end], gap[end], came[end], arc[end] = base + score, lead, start, piece
                    elif -lead < gap[end]:
                        gap[end] = -lead
        at, least, ids = n, _FAR, []
        while at:
            if gap[at] < least:
                least = gap[at]
            if arc[at] >= 0:
                ids.append(arc[at])
            else:
                ids.extend(reversed(self._ids(arc[at])))
            at = came[at]
        ids.reverse()
        return _GAP.pack(least) + array("I", ids).tobytes()

    def _joined(self, chunks: list[str]) -> bytes:
        if len(chunks) == 1:
            return self._path(chunks[0])
        parts = [self.chunks[c] for c in chunks]
        return min(parts, key=_GAP.unpack_from)[:8] + b"".join([p[8:] for p in parts])

    def _lattice(self, chunk: str) -> tuple[list[float], list[list[tuple[float, int, int]]]]:
        """Forward Viterbi over the lattice: the best score up to each position, and the arcs into
        it, the best first: (loss to the best one, start, id or -1 - code point if unknown)."""
        n, longest, trie = len(chunk), self.longest, self.trie
        best, into = [0.0] + [-_FAR] * n, [[] for _ in range(n + 1)]
        for start in range(n):
            base, kids, end = best[start], trie, start
            first = trie.get(chunk[start])
            if first is None or first[1] < 0:
                into[start + 1].append((base + self.unknown_score, start, -1 - ord(chunk[start])))
            for c in chunk[start : start + longest]:
                node = kids.get(c)
                if node is None:
                    break
                kids, piece, score = node
                end += 1
                if piece >= 0:
                    into[end].append((base + score, start, piece))
            # All arcs into the next position are known now.
            arcs = into[start + 1]
            top = best[start + 1] = max(arcs)[0] if arcs else -_FAR
            into[start + 1] = sorted((top - value, at, piece) for value, at, piece in arcs if value > -_FAR / 2)
        return best, into

    def search(self, chunk: str, n: int) -> list[tuple[float, bytes]]:
        """The ``n`` best segmentations of a chunk: A-star backward from its end.

        A state is a position and which of the arcs into it comes next; its cost is the loss so far,
        since what lies before it can be had at its best score.  Of equal states the one nearest to
        the start is taken, so ties cost no breadth, and no position is entered more than ``n`` times.
        """
        size = len(chunk)
        best, into = self._lattice(chunk)
        agenda, pushed, out, entered = [(0.0, size, 0, 0, 0.0, ())], 0, [], [0] * (size + 1)
        while agenda and len(out) < n:
            loss, at, _, arc, came, path = heapq.heappop(agenda)
            arcs = into[at]
            if arc + 1 < len(arcs):
                pushed += 1
                heapq.heappush(agenda, (came + arcs[arc + 1][0], at, pushed, arc + 1, came, path))
            _, start, piece = arcs[arc]
            path = (piece, path)
            if start == 0:
                ids = []
                while path:
                    ids.extend((path[0],) if path[0] >= 0 else self._ids(path[0]))
                    path = path[1]
                out.append((best[size] - loss, array("I", ids).tobytes()))
            elif entered[start] < n:
                entered[start] += 1
                pushed += 1
                heapq.heappush(agenda, (loss, start, pushed, 0, loss, path))
        return out

    def _split(self, text: str) -> tuple[list[str], list[bytes], bool]:
        """Words (or runs with their marks), their packed paths, and whether the marks were left out."""
        if self.by_words and self.plain_form and "  " not in text and text[0] != " " and MARK not in text:
            words = text.split(" ")
            return words, list(map(self.words.__getitem__, words)), True
        whole = self.normalised(text)
        chunks = self.runs.findall(whole) if self.by_words else [whole]
        return chunks, [self._joined(self.cut.findall(c)) if self.by_words else self._path(c) for c in chunks], False

    def _paths(self, text: str) -> tuple[list[str], bool, np.ndarray, np.ndarray, np.ndarray]:
        """Words, whether bare, the ids of the whole best path, where each word's begin, and the gaps."""
        words, packed, bare = self._split(text)
        raw = np.frombuffer(b"".join(packed), "<u4")
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        heads = np.cumsum(sizes) - sizes
        ids = np.ones(len(raw), bool)
        ids[heads] = ids[heads + 1] = False
        gaps = np.stack([raw[heads], raw[heads + 1]], axis=1).view("<f8")[:, 0]
        return words, bare, raw[ids], heads - 2 * np.arange(len(heads)), gaps

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the best segmentation."""
        return self._paths(text)[2] if text else np.zeros(0, "<u4")

    def nbest(self, text: str | None, n: int) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, int, bytes]]]]]:
        """Ids and score of the best segmentation, then (score, changes) of the ``n`` best, best first.

        A change is (start, stop, ids): these take the place of the best one's ids from start to stop.
        """
        if not text:
            return np.zeros(0, "<u4"), 0.0, [(0.0, [])]
        words, bare, best, starts, gaps = self._paths(text)
        total = float(self.scores[best].sum())
        few = [int(i) for i in _smallest(gaps, min(n - 1, len(gaps))) if gaps[i] < _FAR / 2]
        found: list[tuple[float, tuple]] = [(0.0, ())]  # loss, ((place, ids), ...) in the order of places
        for place in sorted(few):
            (top, _), *others = self.search(MARK + words[place] if bare else words[place], n)
            more = [(loss + top - score, change + ((place, ids),)) for loss, change in found for score, ids in others]
            found = heapq.nsmallest(n, found + more, key=lambda c: c[0])
        stop = {place: int(starts[place + 1]) if place + 1 < len(starts) else len(best) for place in few}
        return best, total, [(total - loss, [(int(starts[place]), stop[place], ids) for place, ids in change]) for loss, change in found]

    def decode(self, ids: np.ndarray) -> str:
        """Every piece's bytes, gathered from one buffer."""
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return ""
        places = np.repeat(self.offsets[ids] - ends + sizes, sizes) + np.arange(ends[-1])
        raw = self.buffer[places].tobytes().decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


def expanded(ids: np.ndarray, changes) -> np.ndarray:
    """The whole ids of a segmentation that is told by its changes to ``ids``."""
    parts, at = [], 0
    for start, stop, new in changes:
        parts += [ids[at:start], np.frombuffer(new, "<u4") if isinstance(new, bytes) else np.array(new, "<u4")]
        at = stop
    return np.concatenate([*parts, ids[at:]]).astype("<u4")


def _scores(own: list[float], plain: list[int], scores: str) -> list[float]:
    """The additive score of every piece; ranks (distinct whole numbers) become log-probabilities.

    Pieces that the file puts behind all ranks (below -1e8: runs of spaces) get the last rank.
    """
    ranked = [own[i] for i in plain if own[i] > -1e8]
    if scores == "file" or len(set(ranked)) < len(ranked) or any(s > 0 or s != int(s) for s in ranked):
        return own
    last = min(ranked) - 1
    whole = float(np.log(sum(1 / (_ZIPF - max(own[i], last)) for i in plain)))
    return [float(-np.log(_ZIPF - min(max(s, last), 0.0))) - whole for s in own]


def _smallest(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least values, ties to the earlier place."""
    if k <= 0:
        return np.zeros(0, np.int64)
    limit = np.partition(values, k - 1)[k - 1]
    sure = np.flatnonzero(values < limit)
    return np.concatenate((sure, np.flatnonzero(values == limit)[: k - len(sure)]))


_LOADED: dict[tuple[str, str, int], Segmenter] = {}


def segmenter(model: bytes, scores: str = "log", kept_words: int = 220_000) -> Segmenter:
    """One per worker process, model and options."""
    key = hashlib.sha256(model).hexdigest(), scores, kept_words
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Segmenter(model, scores, kept_words)
    return _LOADED[key]


_CHANGE = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_BEST = pa.struct([("score", pa.float64()), ("changes", pa.list_(_CHANGE))])
_ENCODED = "doc_id long, n_pieces long, ids array<int>, score double, nbest array<struct<score:double,changes:array<struct<start:int,stop:int,ids:array<int>>>>>, ids_sha256 string, round_trip boolean"


def _offsets(sizes: list[int]) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(np.array(sizes, np.int64)))), pa.int32())


def _ids_column(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
    return pa.ListArray.from_arrays(_offsets(list(map(len, parts))), pa.array(flat.astype(np.int32)))


def _nbest_column(rows: list[list]) -> pa.Array:
    best = [b for row in rows for b in row]
    changes = [c for _, each in best for c in each]
    flat = pa.StructArray.from_arrays([pa.array([c[0] for c in changes], pa.int32()), pa.array([c[1] for c in changes], pa.int32()), _ids_column([np.frombuffer(c[2], "<u4") for c in changes])], fields=list(_CHANGE))
    each = pa.ListArray.from_arrays(_offsets([len(c) for _, c in best]), flat)
    whole = pa.StructArray.from_arrays([pa.array([s for s, _ in best], pa.float64()), each], fields=list(_BEST))
    return pa.ListArray.from_arrays(_offsets(list(map(len, rows))), whole)


def encode(documents: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, scores: str = "log", kept_words: int = 220_000) -> DataFrame:
    """A row per document: ids and score of the best segmentation, scores and changes of the ``n`` best,
    and whether decoding the ids gives the text back.

    A worker keeps at most ``kept_words`` words in each of two generations, some 250 bytes a word.
    """
    spark = documents.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(Path(model_file).read_bytes())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(model.value, scores, kept_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # ids take several times the room of a text
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                found = [own.nbest(text, n) for text in texts]
                every = [ids for ids, _, _ in found]
                columns = [
                    part.column(0), pa.array(list(map(len, every)), pa.int64()), _ids_column(every), pa.array([s for _, s, _ in found], pa.float64()), _nbest_column([b for _, _, b in found]),
                    pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids in every]), pa.array([own.decode(ids) == (text or "") for ids, text in zip(every, texts, strict=True)]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pieces", "ids", "score", "nbest", "ids_sha256", "round_trip"])

    return as_text(documents, id_col, text_col).mapInArrow(encoded, _ENCODED)


def decode(encoded: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of an ``array<int>`` column; null for null."""
    spark = encoded.sparkSession
    prepare(spark)
    model = spark.sparkContext.broadcast(Path(model_file).read_bytes())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(model.value)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array(ids, np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{ids_col}` as ids").mapInArrow(decoded, "doc_id long, text string")
