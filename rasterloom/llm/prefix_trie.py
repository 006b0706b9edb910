"""Prefix trie of conversations from mergeable partial tries.

A turn is a digest of its role and text and a count of words, made where the row is read, so
texts are never shuffled.  Conversations are dealt by ranges of their ids; a task reads its own
in order and keeps a partial trie: a table of nodes keyed by the digest chained along the path,
with members, smallest member and the ids that end there.  It hands the table on whenever it
holds ``held_nodes`` nodes, so memory doesn't grow with a partition, a copied conversation or a
long one.  Partial tables are merged in rounds keyed by node and group of ``fan`` tasks, then by
node alone: members add up, end lists join in the order of their ids (in pieces of bounded size;
the digest of a list that a third of all rows share is fed piece by piece).

Sums over subtrees are rolled up from the bottom along conversations: a node's value lies with
its smallest member, the values below a turn of that conversation are running sums from its last
turn up, and a node's total is the sum over its members of what they carry at its depth.  These
are rows of turns, never pairs of nodes, and they are combined before the shuffle, so the root
and a first turn that many share are no hot keys.  Joins on the parent, which many share, are
spread.

``Graft(every, heads)`` rebuilds conversation c before: the first h turns of c - c % every (all if
fewer, none if absent), then c's own turns after its first h; h is the CRC-32 of c in decimal,
modulo ``heads``.  Conversations of one base are dealt together.

Turns are in the order of ``turn`` (null first), equal ones by role, then by the digest of the text.
Null roles and texts are empty; rows without a conversation take no part; repeated rows are turns
each.  A conversation that is left without turns ends at the root.  Keys have 128 bits.  Texts are
digested whole however long; an empty table has no nodes, not even a root.  Only the four columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_among, prepare, spread_join, staged

_ROOT = bytes(16)
_PIECE = "key binary, parent binary, depth long, words long, n_convs long, conv_id long, from_conv long, from_place long, first long, ends binary"
_LOCAL = f"part long, is_node boolean, {_PIECE}"
#: Bytes of an end list that travel as one row before the last merge.
_ENDS_BYTES = 64 << 10


@dataclass(frozen=True)
class Graft:
    every: int = 20
    heads: int = 4

    def taken(self, conv: int) -> int:
        return crc32(str(conv).encode()) % self.heads


class Node:
    __slots__ = ("parent", "depth", "words", "n", "conv", "origin", "ends")

    def __init__(self, parent: bytes | None, depth: int, words: int):
        self.parent, self.depth, self.words = parent, depth, words
        self.n, self.conv, self.origin, self.ends = 0, None, (None, None), []


class PartialTrie:
    """The nodes that a task has seen since it last handed them on, and the turns of its conversations."""

    def __init__(self, part: int, graft: Graft | None):
        self.part, self.graft = part, graft
        self.nodes: dict[bytes, Node] = {}
        self.turns: list[tuple[int, int, bytes]] = []
        self.base = self.conv = None
        self.head: list[tuple[bytes, int]] = []
        self.late = None  # the end of a base, kept until smaller ids of its group have had theirs

    # -- reading turns in order

    def turn(self, base: int, conv: int, digest: bytes, words: int) -> None:
        if conv != self.conv:
            self.close(base)
            self._open(base, conv)
        if self.own < len(self.head) or self.own >= self.skip:
            if conv == base and self.graft and len(self.head) < self.graft.heads - 1:
                self.head.append((digest, words))
        if self.own >= self.skip:
            self._step(digest, words, conv, self.own)
        self.own += 1

    def _open(self, base: int, conv: int) -> None:
        if base != self.base:
            self.base, self.head = base, []
        self.conv, self.own, self.skip = conv, 0, 0
        if self.late and conv > self.late[0]:
            self._end(*self.late)
            self.late = None
        self.at = (_ROOT, None, 0, 0)
        self._visit(None, None)
        if self.graft and conv != base:
            self.skip = self.graft.taken(conv)
            for place, (digest, words) in enumerate(self.head[: self.skip]):
                self._step(digest, words, base, place)

    def close(self, base: int | None = None) -> None:
        """The last conversation ends where it stands."""
        if self.conv is not None:
            if self.graft and self.conv == self.base:
                self.late = (self.conv, self.at)
            else:
                self._end(self.conv, self.at)
        if self.late and base != self.base:
            self._end(*self.late)
            self.late = None
        self.conv = None

    def _node(self, at: tuple) -> Node:
        key, parent, depth, words = at
        return self.nodes.get(key) or self.nodes.setdefault(key, Node(parent, depth, words))

    def _end(self, conv: int, at: tuple) -> None:
        self._node(at).ends.append(conv)

    def _step(self, digest: bytes, words: int, source: int, place: int) -> None:
        key, _, depth, _ = self.at
        self.at = (hashlib.sha256(key + digest).digest()[:16], key, depth + 1, words)
        self._visit(source, place)

    def _visit(self, source: int | None, place: int | None) -> None:
        node = self._node(self.at)
        node.n += 1
        if node.conv is None or self.conv < node.conv:
            node.conv, node.origin = self.conv, (source, place)
        self.turns.append((self.conv, self.at[2], self.at[0]))

    # -- handing on

    def rows(self) -> Iterator[pa.RecordBatch]:
        turns, nodes = self.turns, self.nodes
        self.turns, self.nodes = [], {}
        if turns:
            convs, depths, keys = zip(*turns, strict=True)
            yield _local(self.part, False, len(turns), key=keys, depth=depths, conv_id=convs)
        if nodes:
            found = list(nodes.values())
            yield _local(
                self.part, True, len(found), key=list(nodes), parent=[x.parent for x in found], depth=[x.depth for x in found], words=[x.words for x in found], n_convs=[x.n for x in found], conv_id=[x.conv for x in found],
                from_conv=[x.origin[0] for x in found], from_place=[x.origin[1] for x in found], first=[x.ends[0] if x.ends else None for x in found], ends=[",".join(map(str, x.ends)).encode() for x in found],
            )


_TYPES = {name: pa.binary() if kind == "binary" else pa.int64() for name, kind in (x.split() for x in _PIECE.split(", "))}


def _local(part: int, is_node: bool, n: int, **columns: list) -> pa.RecordBatch:
    filled = {name: pa.array(columns[name], kind) if name in columns else pa.nulls(n, kind) for name, kind in _TYPES.items()}
    return pa.RecordBatch.from_pydict({"part": pa.array([part] * n, pa.int64()), "is_node": pa.array([is_node] * n, pa.bool_())} | filled)


def _ordered(conversations: DataFrame, columns: tuple[str, str, str, str], graft: Graft | None) -> DataFrame:
    """``base, conv_id, turn, role, digest, words``: digests instead of texts."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in columns)
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(
        conv.cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), F.unhex(F.substring(said, 1, 32)).alias("digest"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("tie"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    return rows.where("conv_id is not null").withColumn("base", F.expr(f"conv_id - conv_id % {graft.every}") if graft else F.col("conv_id"))


def _partial(turns: DataFrame, graft: Graft | None, held_nodes: int) -> DataFrame:
    dealt = turns.repartitionByRange("base").sortWithinPartitions("base", F.expr("conv_id <> base"), "conv_id", F.asc_nulls_first("turn"), "role", "tie")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PartialTrie(TaskContext.get().partitionId(), graft)
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                trie.turn(*row)
                if len(trie.turns) >= held_nodes:
                    yield from trie.rows()
        trie.close()
        yield from trie.rows()

    return dealt.select("base", "conv_id", "digest", "words").mapInArrow(read, _LOCAL)


# ---- merging -----------------------------------------------------------------------------------


class Merge:
    """Pieces of nodes in the order of key and first end; a row per node, or per bounded end list."""

    def __init__(self, last: bool):
        self.last, self.key, self.out = last, None, []

    def piece(self, key: bytes, parent: bytes | None, depth: int, words: int, n: int, conv: int | None, source: int | None, place: int | None, first: int | None, ends: bytes) -> None:
        if key != self.key:
            self.close()
            self.key, self.fixed, self.n, self.conv, self.origin, self.first, self.ends, self.size = key, (parent, depth, words), 0, None, (None, None), None, [], 0
            self.digest = hashlib.sha256() if self.last else None
            self.any = False
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv, self.origin = conv, (source, place)
        if not ends:
            return
        if self.last:
            self.digest.update(b"," + ends if self.any else ends)
            self.any = True
            return
        self.first = first if self.first is None else self.first
        self.ends.append(ends)
        self.size += len(ends)
        if self.size >= _ENDS_BYTES:
            self._put()
            self.n, self.conv, self.origin, self.first, self.ends, self.size = 0, None, (None, None), None, [], 0

    def _put(self) -> None:
        self.out.append((self.key, *self.fixed, self.n, self.conv, *self.origin, self.first, self.digest.hexdigest().encode() if self.last else b",".join(self.ends)))

    def close(self) -> None:
        if self.key is not None and (self.n or self.ends or self.last):
            self._put()
        self.key = None

    def taken(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(_TYPES), _TYPES.values(), strict=True)], names=list(_TYPES))


def _merged(pieces: DataFrame, group: Column | None) -> DataFrame:
    """One merge; ``group`` is the group of tasks whose pieces meet, none in the last merge."""
    by = ["key"] if group is None else ["part", "key"]
    if group is not None:
        pieces = pieces.withColumn("part", group)
    dealt, last = pieces.repartition(*by).sortWithinPartitions(*by, "first"), group is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, part = Merge(last), None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != part and not last:
                    merge.close()
                    if merge.out:
                        yield with_part(merge.taken(), part)
                    part = row[0]
                merge.piece(*row[1:])
            if merge.out:
                yield with_part(merge.taken(), part)
        merge.close()
        yield with_part(merge.taken(), part)

    def with_part(found: pa.RecordBatch, part: int | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * found.num_rows, pa.int64()), *found.columns], names=["part", *_TYPES])

    return dealt.select("part", *_TYPES).mapInArrow(run, f"part long, {_PIECE}")


# ---- the trie ----------------------------------------------------------------------------------


def build(
    conversations: DataFrame, *, graft: Graft | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", fan: int = 64, held_nodes: int = 100_000
) -> DataFrame:
    """A row per node: ``key, parent_key`` (hex), ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256`` and, of its last turn, ``words`` and where it comes from
    (``from_conv, from_place``: the place among that conversation's own turns, from 0)."""
    prepare(conversations.sparkSession)
    local = staged(_partial(_ordered(conversations, (conv_col, turn_col, role_col, text_col), graft), graft, held_nodes), "partial-tries")
    pieces, width = local.where("is_node").drop("is_node"), (local.agg(F.max("part")).first()[0] or 0) + 1
    while width > fan:
        pieces, width = _merged(pieces, F.expr(f"part div {fan}L")), -(-width // fan)
    nodes = staged(_merged(pieces, None).drop("part", "first").withColumn("ends_sha256", F.decode("ends", "utf-8")).drop("ends"), "tries")
    kids = staged(nodes.where("parent is not null").groupBy("parent").count(), "kids")
    heads = kids.select(F.col("parent").alias("head"), F.col("count").alias("n_children"))
    faced = staged(nodes.join(heads, F.col("key") == F.col("head"), "left").drop("head").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "faced")

    own = faced.select("conv_id", "depth", F.lit(None).cast("binary").alias("key"), F.expr("(n_convs - 1) * words").alias("saved"), F.expr("bigint(n_children = 0)").alias("leaves"))
    turns = local.where("not is_node").select("conv_id", "depth", "key", F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("leaves"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"))  # rows of the same depth are peers, so a turn sees its own node
    carried = turns.unionAll(own.where("saved <> 0 or leaves <> 0")).select("key", F.sum("saved").over(up).alias("saved"), F.sum("leaves").over(up).alias("leaves"))
    rolled = carried.where("key is not null and (saved <> 0 or leaves <> 0)").groupBy(F.col("key").alias("at")).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    summed = faced.join(rolled, F.col("key") == F.col("at")).drop("at")  # every node has a leaf below it or is one
    over = faced.where("n_children > 0").select(F.col("key").alias("head"), F.col("conv_id").alias("parent_conv_id"))
    whole = spread_join(summed, over, "parent", "head", "key", hot=hot_among(kids, "parent"), how="left")
    hexed = lambda c: F.lower(F.hex(c))
    return whole.select(
        hexed("key").alias("key"), hexed("parent").alias("parent_key"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "words", "from_conv", "from_place",
    )


def with_turns(nodes: DataFrame, conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The nodes with ``role`` and ``text`` of their last turns (null at the root)."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    said = conversations.select(conv.cast("long").alias("_conv"), turn.alias("_turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    tie = F.unhex(F.substring(F.sha2("text", 256), 1, 32))
    placed = said.withColumn("_place", F.row_number().over(Window.partitionBy("_conv").orderBy(F.asc_nulls_first("_turn"), "role", tie)) - 1).drop("_turn")
    return nodes.join(placed, (F.col("from_conv") == F.col("_conv")) & (F.col("from_place") == F.col("_place")), "left").drop("_conv", "_place")
