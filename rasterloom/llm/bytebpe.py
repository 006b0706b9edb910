"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

``model_of`` serialises a BPE model whose piece ``i`` is the vocabulary's token of rank ``i``,
its bytes mapped one by one to printable characters, its score the negative rank, with identity
normalisation: no prefix, no white space handling.  Merging the best-scored pair first, the
leftmost of equals, is then merging the pair of the lowest rank first, so each pre-token gets
the ids that the rank file's own library gives it.  As there, a pre-token that is a token as a
whole gets its one id, whether merges reach it or not.  Ranks that a file leaves free become
unused pieces; the piece after the last rank stands for unknown and never occurs, as all 256
bytes are tokens.

Pre-tokens are the matches of a pattern.  Two libraries may know different Unicode versions:
``Splitter`` asks the rank library once which characters it counts as letters, numbers and white
space, and splits by these sets.

Decoding is the inverse: id to piece, piece to bytes, joined.

Everything is map-only: no shuffle, no state but a bounded cache of pre-tokens in a worker, so a
lost executor costs its tasks only.  A null or empty text has no ids and decodes to no bytes.
Very long texts are cut into matches piece by piece and never held as a whole list.  Repeated
rows, repeated and null ids give a row each; no order or tie matters; an empty table gives no
rows.  Bytes that aren't UTF-8 count as replacement characters.  Only the id and text columns are
read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache
from itertools import islice
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import prepare

#: Printable bytes stand for themselves, the others for the characters from 256 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in set(_PLAIN)]
CHARACTER_OF = {b: b for b in _PLAIN} | {b: 256 + n for n, b in enumerate(_OTHER)}
_BYTE_OF = {c: b for b, c in CHARACTER_OF.items()}
#: Piece types and the model type of sentencepiece's format.
_NORMAL, _UNKNOWN, _UNUSED, _BPE = 1, 2, 5, 2
#: Texts beyond this many characters are matched in slices of as many matches.
_LONG = 1 << 22
#: Characters of the texts whose pre-tokens are looked up together.
_GROUP = 1 << 20


def ranks_of(rank_file: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(rank_file).read_bytes().splitlines())}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(CHARACTER_OF)


def unmapped(piece: str) -> bytes:
    return piece.translate(_BYTE_OF).encode("latin-1")


# ---- the model's serial form: tagged fields, lengths before bytes ----------------------------


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n & 0xFFFFFFFFFFFFFFFF)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(raw)) + raw


def _piece(text: str, score: float, kind: int) -> bytes:
    return _bytes(1, _bytes(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + (b"" if kind == _NORMAL else _number(3, kind)))


def model_of(ranks: dict[bytes, int]) -> bytes:
    """The serial model of a vocabulary; its ids are the ranks."""
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"a byte-level vocabulary has all 256 bytes; it lacks {missing[:5]}")
    size, tokens = max(ranks.values()) + 1, {rank: token for token, rank in ranks.items()}
    if len(tokens) < len(ranks) or size >= 1 << 24:
        raise ValueError("ranks must differ and fit a float exactly")
    pieces = [_piece(mapped(tokens[i]), -float(i), _NORMAL) if i in tokens else _piece(f"<free {i}>", -float(i), _UNUSED) for i in range(size)]
    trainer = _number(3, _BPE) + _number(4, size + 1) + _number(40, size) + b"".join(_number(field, -1) for field in (41, 42, 43))
    plain = _bytes(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return b"".join([*pieces, _piece("<unknown>", 0.0, _UNKNOWN), _bytes(2, trainer), _bytes(3, plain)])


# ---- pre-tokens ------------------------------------------------------------------------------

_CLASSES = (r"\p{L}", r"\p{N}", r"\s")


def _ranges(codes: list[int]) -> str:
    runs: list[list[int]] = []
    for c in codes:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def exact_class(name: str, sets: dict[str, tuple[str, str]]) -> str:
    more, less = sets[name]
    return f"[[{name}{more}]--[{less}]]" if less else f"[{name}{more}]"


@cache
def differing() -> dict[str, tuple[str, str]]:
    """For each class: ranges that only the rank library counts in, and that only the pattern library does."""
    everything, one = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), {bytes([b]): b for b in range(256)}
    out = {}
    for name in _CLASSES:
        library = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=one, special_tokens={})
        theirs, ours = set(library.decode(library.encode_ordinary(everything))), set(regex.findall(name, everything))
        out[name] = (_ranges(sorted(map(ord, theirs - ours))), _ranges(sorted(map(ord, ours - theirs))))
    return out


#: Texts of characters below this one are split by plain ranges, which the standard library matches faster.
_COMMON = 0x500


class Splitter:
    """Matches of ``pattern``, with the rank library's letters, numbers and white space."""

    def __init__(self, pattern: str):
        self.pattern, self.sets = pattern, differing()
        self._compile()

    def __getstate__(self) -> tuple:
        return self.pattern, self.sets

    def __setstate__(self, state: tuple) -> None:
        self.pattern, self.sets = state
        self._compile()

    def _compile(self) -> None:
        exact = common = self.pattern
        for name, differs in self.sets.items():
            exact = exact.replace(name, exact_class(name, self.sets) if any(differs) else name)
        self.exact = regex.compile(exact, regex.V1)
        for name in self.sets:
            low = _ranges([c for c in range(_COMMON) if regex.fullmatch(exact_class(name, self.sets), chr(c), regex.V1)])
            common = re.sub(r"(\[[^]]*)?" + re.escape(name), lambda m, low=low: m[1] + low if m[1] else f"[{low}]", common)  # noqa: B023
        self.common = re.compile(common)
        self.below = bytes(range(chr(_COMMON).encode()[0]))  # a character from _COMMON on has another byte

    def slices(self, text: str) -> Iterator[list[str]]:
        use = self.common if text.isascii() or not text.encode().translate(None, self.below) else self.exact
        if len(text) <= _LONG:
            yield use.findall(text)
            return
        found = use.finditer(text)
        while part := [m.group() for m in islice(found, _LONG)]:
            yield part


# ---- encoding and decoding -------------------------------------------------------------------


class Codec:
    """Encoder and decoder of one vocabulary; travels as the model's bytes."""

    def __init__(self, rank_file: str, pattern: str, *, kept_words: int = 300_000):
        self.model, self.splitter, self.kept_words = model_of(ranks_of(rank_file)), Splitter(pattern), kept_words
        self.digest = hashlib.sha256(self.model).hexdigest()

    def ready(self) -> Worker:
        """The worker's own, loaded once in a process."""
        return _WORKERS.get(self.digest) or _WORKERS.setdefault(self.digest, Worker(self))


class Worker:
    def __init__(self, codec: Codec):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=codec.model)
        self.splitter, self.most = codec.splitter, codec.kept_words
        self.tokens = [unmapped(p) if not self.model.is_unused(i) else b"" for i in range(self.model.get_piece_size() - 1) for p in (self.model.id_to_piece(i),)]
        self.whole = {t: struct.pack("<I", i) for i, t in enumerate(self.tokens) if t}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Afterwards all of ``words`` are known; what else is, stays while there is room."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, words
        words = list(new)
        raws = [w.encode() for w in words]
        merged = [(w, raw) for w, raw in zip(words, raws, strict=True) if raw not in self.whole]
        self.known.update((w, self.whole[raw]) for w, raw in zip(words, raws, strict=True) if raw in self.whole)
        ids = self.model.encode([mapped(raw) for _, raw in merged], out_type=int, num_threads=1) if merged else []
        self.known.update((w, struct.pack(f"<{len(x)}I", *x)) for (w, _), x in zip(merged, ids, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers.

        Texts go in groups of some million characters, as a call of the model has a fixed cost.
        """
        out, group, size = [], [], 0
        for text in texts:
            if size + len(text) > _GROUP:
                out += self._group(group)
                group, size = [], 0
            group, size = [*group, text], size + len(text)
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(texts) == 1:
            return [b"".join(self._ids(words) for words in self.splitter.slices(texts[0]))]
        lists = [next(self.splitter.slices(text)) for text in texts]  # none is longer than a group
        self._learn(set().union(*lists))
        return [b"".join(map(self.known.__getitem__, words)) for words in lists]

    def _ids(self, words: list[str]) -> bytes:
        self._learn(set(words))
        return b"".join(map(self.known.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_WORKERS: dict[str, Worker] = {}


def encode(documents: DataFrame, codec: Codec, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids``: a row per document, ids as little-endian unsigned 32-bit numbers."""
    spark = documents.sparkSession
    prepare(spark)
    rows = documents.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("raw"))
    sent = spark.sparkContext.broadcast(codec)  # one vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = sent.value.ready()
        for batch in batches:
            ids = worker.encode([(raw.as_py() or b"").decode("utf-8", "replace") for raw in batch.column(1)])
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, codec: Codec) -> DataFrame:
    """The rows of ``encoded`` with their bytes in a further column ``decoded``."""
    spark = encoded.sparkSession
    prepare(spark)
    sent, at = spark.sparkContext.broadcast(codec), encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = sent.value.ready()
        for batch in batches:
            raws = [worker.decode(ids.as_py() or b"") for ids in batch.column(at)]
            yield batch.append_column("decoded", pa.array(raws, pa.binary()))

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField("decoded", BinaryType())]))


def as_numbers(ids: Column | str) -> Column:
    """The binary ids as an array of longs."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    digits, places = F.hex(ids), F.sequence(F.lit(0), (F.octet_length(ids) / 4).cast("int") - 1)
    at = lambda k, place: F.substring(digits, k * 8 + place, F.lit(2))
    numbers = F.transform(places, lambda k: F.conv(F.concat(*(at(k, place) for place in (7, 5, 3, 1))), 16, 10).cast("long"))
    return F.when(F.octet_length(ids) > 0, numbers).otherwise(F.array().cast("array<long>"))
