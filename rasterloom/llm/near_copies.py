"""Near copies for a corpus: Jaccard similarity of word shingles, found by SimHash and by MinHash bands.

Two texts are linked if the sets of their ``shingle``-word runs (words as in ``simhash``) have
a Jaccard similarity of at least ``num / den``; every link is verified on whole sets.

1. One pass over the texts gives each its set's digest, SimHash, ``BANDS`` band keys and signature.
2. The Golay keys of ``simhash`` give the pairs within 4 of 64 bits.  At a similarity of 0.8 some ten
   bits differ, more than Golay keys reach, so SimHash alone would lose most of those links.
3. For these, a band key joins ``ROWS`` independent minima of the set.  A pair at 0.8 has none of the
   48 band keys in common with a probability of (1 - 0.8^5)^48, 5e-9, and less the nearer it is.
4. A run of equal keys first gives each member with a hub of the run, and these are verified.  Then only members of different classes that still
   share a run are left; they meet in parts of a bounded size and are verified there, and no pair
   but a link leaves its task.
5. Signatures rule out candidates of well below the wanted similarity (a pair at 0.8 has at least
   148 of 240 equal bytes but for a probability of 1e-9) before whole sets are fetched.

Sets are of 64-bit hashes, and equal sets (one 64-bit digest) are one node.  A text of fewer
words has one shingle; null or wordless texts have the empty set and are copies of each other.
Very long texts are read whole.  Texts themselves are shuffled only where they are candidates;
the rows that stay are found by the id and a hash of the text.  Extra columns stay as they are,
whatever their names.  An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import as_text, hot_among, hot_keys, prepare, shuffle_partitions, spread_join, staged, unused_name
from .components import connected_components

BANDS, ROWS = 48, 5
#: Bits of the map of wanted texts: 8 MB at most are sent, however many texts are wanted.
_MAP_BITS = 1 << 26
_PAGE_BITS = 32_768
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 30_000:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 42)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


_RNG = np.random.default_rng(17)
_FACTORS = (_RNG.integers(0, 1 << 31, BANDS * ROWS) * 2 + 1).astype(np.uint32)[:, None]
_SHIFTS = _RNG.integers(0, 1 << 32, BANDS * ROWS).astype(np.uint32)[:, None]
_NUMBERS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles_of(text: str | None, hashes: dict[bytes, int], size: int) -> np.ndarray:
    """The sorted set of 64-bit hashes of the runs of ``size`` words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    runs = len(words) - size + 1
    total = np.full(runs, size, np.uint64)
    for j in range(size):
        total = total + each[j : j + runs] * _ODD[j % 8]
    return np.unique(_mixed(total))


def node_of(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def minima_of(shingles: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the ``BANDS * ROWS`` orders (32 bits a value)."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(folded), 512):
        values = folded[None, at : at + 512] ^ _SHIFTS
        values *= _FACTORS
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands_of(minima: np.ndarray) -> np.ndarray:
    total, each = _NUMBERS.copy(), minima.reshape(BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        total = _mixed(total + each[:, j] * _ODD[j])
    return total.view(np.int64)


def signature_of(minima: np.ndarray) -> bytes:
    return (minima * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def print_of(shingles: np.ndarray) -> int:
    """The SimHash of a set, as a signed 64-bit number."""
    if not len(shingles):
        return 0
    bits = np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(shingles)).tobytes(), "big", signed=True)


def least_equal(num: int, den: int) -> int:
    """How many bytes of two signatures are equal at least if the sets reach ``num / den``, but for 1e-9:
    the largest count whose Chernoff bound, exp(-orders * divergence), is below that."""
    orders, share = BANDS * ROWS, num / den
    for count in range(int(orders * share), 0, -1):
        x = count / orders
        if x < share and orders * (x * np.log(x / share) + (1 - x) * np.log((1 - x) / (1 - share + 1e-12))) > np.log(1e9):
            return count
    return 0


_PRINTED = "doc_id long, text_key long, node long, n long, fp long, bands array<long>, signature binary"


def _printed(shingle: int):
    """Each row's id, text hash and digest of its set; what is known of the set goes once a task."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _WordHashes(), set()
        for batch in batches:
            nodes, sizes, prints, bands, marks = [], [], [], [], []
            for text in batch.column(2):
                own = shingles_of(text.as_py(), hashes, shingle)
                nodes.append(node_of(own))
                sizes.append(len(own))
                if nodes[-1] in seen:
                    for column in (prints, bands, marks):
                        column.append(None)
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(nodes[-1])
                minima = minima_of(own)
                for column, value in ((prints, print_of(own)), (bands, bands_of(minima)), (marks, signature_of(minima))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "text_key", "node", "n", "fp", "bands", "signature"],
            )

    return measured


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The runs of equal first columns in sorted rows, across batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if held and held[0].column(0)[0].as_py() != keys[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _possible_pairs(run: pa.Table, least: int, strip: int = 16_384) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different classes, each in the first band that both have, if signatures
    allow it; the likeliest of a strip first.  A run is a part of the members and a part of the others."""
    side, key, nodes, roots, hub_roots = (run.column(i).to_numpy() for i in range(1, 6))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(left) or not len(right):
        return
    bands = run.column(6).combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
    marks = np.frombuffer(b"".join(run.column(7).to_pylist()), np.uint8).reshape(len(bands), -1)
    other = roots != hub_roots
    step = max(1, strip // len(right))
    for at in range(0, len(left), step):
        x, y = left[at : at + step, None], right[None, :]
        # Two of the others meet twice: the smaller one stands left.
        i, j = np.nonzero((roots[x] != roots[y]) & (~other[x] | (nodes[x] < nodes[y])))
        x, y = left[at + i], right[j]
        near = (marks[x] == marks[y]).sum(axis=1)
        good = near >= least
        x, y, near = x[good], y[good], near[good]
        if len(x):
            first = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key[0]
            order = np.argsort(-near[first], kind="stable")
            yield x[first][order], y[first][order]


def _members_with_pairs(least: int):
    """The rows of a part that are in a possible pair, without what was told of their sets."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            places = [np.concatenate(pair) for pair in _possible_pairs(run, least)]
            if places:
                yield from run.take(pa.array(np.unique(np.concatenate(places)))).select(range(6)).to_batches()

    return stream


def _linked_across(least: int, num: int, den: int):
    """Links between the classes of a part, verified on whole sets; none between classes linked already."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches):
            nodes, roots = run.column(3).to_pylist(), run.column(4).to_pylist()
            sets = [np.frombuffer(raw, np.int64) for raw in run.column(8).to_pylist()]
            number = {root: i for i, root in enumerate(dict.fromkeys(roots))}
            classes, out = simhash.Sets(len(number)), []
            for x, y in _possible_pairs(run, least):
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    a, b = number[roots[i]], number[roots[j]]
                    if classes.root(a) != classes.root(b):
                        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        if shared * (num + den) >= (len(sets[i]) + len(sets[j])) * num:
                            classes.join(a, b)
                            out.append((nodes[i], nodes[j]))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["src", "dst"])

    return stream


def _map_of(keys: DataFrame, column: str, count: int) -> np.ndarray:
    """A bit for each hashed key, one to sixteen bits a key, ``_MAP_BITS`` at most."""
    pages = 1
    while pages * _PAGE_BITS < min(_MAP_BITS, 16 * count):
        pages *= 2
    at = F.pmod(F.col(column), F.lit(pages * _PAGE_BITS))
    made = keys.select(F.floor(at / _PAGE_BITS).cast("int").alias("page"), (at % _PAGE_BITS).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((pages, _PAGE_BITS // 8), np.uint8)
    for row in made.toLocalIterator():  # at most _MAP_BITS / _PAGE_BITS rows of 4 KB
        out[row.page] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def _sets_of(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``node, own``: the whole sets of the wanted nodes, from the texts whose hash is on a bounded map."""
    need = staged(nodes.join(wanted.select(F.col("node").alias("need")).distinct(), F.col("node") == F.col("need")).select("need", "text_key"), "need")
    sent = texts.sparkSession.sparkContext.broadcast(_map_of(need, "text_key", need.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, wanted_bits = _WordHashes(), sent.value
        seen: set[int] = set()
        for batch in batches:
            at = batch.column(0).to_numpy() % (8 * len(wanted_bits))
            rows = np.flatnonzero(wanted_bits[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for i in range(0, len(rows), 128):
                found = []
                for text in batch.column(1).take(pa.array(rows[i : i + 128])):
                    own = shingles_of(text.as_py(), hashes, size)
                    if (node := node_of(own)) not in seen:
                        seen.add(node)
                        found.append((node, own.view(np.int64)))
                if len(seen) > 100_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["node", "own"])

    every = texts.select(_text_key(F.col("text")).alias("text_key"), "text").mapInArrow(sets, "node long, own array<long>")
    return staged(every.join(need, F.col("node") == F.col("need"), "left_semi").dropDuplicates(["node"]), "sets")


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``src, dst``: the pairs whose whole sets are similar enough."""
    least = least_equal(num, den)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((left == right).sum(axis=1) >= least, pa.bool_()))

    met = staged(pairs.distinct(), "met")
    side = lambda x: nodes.select(F.col("node").alias(f"{x}_node"), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"{x}_mark"))
    marked = spread_join(met, side("a"), "a", "a_node", "b")
    marked = spread_join(marked, side("b"), "b", "b_node", "a", hot=hot_keys(met, "b"))
    fits = F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num
    pairs = staged(marked.where(fits).select("a", "b", "a_mark", "b_mark").mapInArrow(possible, "a long, b long"), "candidates")
    if pairs.isEmpty():
        return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    own = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), texts, nodes, size)
    both = spread_join(pairs, own.select(F.col("node").alias("a_node"), F.col("own").alias("left")), "a", "a_node", "b", salts=16)
    both = spread_join(both, own.select(F.col("node").alias("b_node"), F.col("own").alias("right")), "b", "b_node", "a", hot=hot_keys(pairs, "b"), salts=16)
    shared = F.size(F.array_intersect("left", "right"))
    return staged(both.where(shared * (num + den) >= (F.size("left") + F.size("right")) * num).select(F.col("a").alias("src"), F.col("b").alias("dst")), "similar")


def _across(runs: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``src, dst``: links between the classes that are left in runs.  No pair leaves its task unverified:
    first the members that are in any possible pair are told, then these are met with their whole sets."""
    tasks, least = shuffle_partitions(texts.sparkSession), least_equal(num, den)
    told = nodes.select(F.col("node").alias("of"), "bands", "signature")
    dealt = lambda parts: parts.repartition(tasks, "part").sortWithinPartitions("part")
    parts = _parts_of_runs(runs).join(told, F.col("node") == F.col("of")).drop("of")
    left = staged(dealt(parts).mapInArrow(_members_with_pairs(least), "part long, side int, key long, node long, root long, hub_root long"), "members")
    if left.isEmpty():
        return left.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    own = _sets_of(left, texts, nodes, size)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.values.to_numpy().tobytes() for x in batch.column(1)], pa.binary())], names=["own_node", "own"])

    whole = left.join(told, F.col("node") == F.col("of")).drop("of").join(own.mapInArrow(raw, "own_node long, own binary"), F.col("node") == F.col("own_node")).drop("own_node")
    return staged(dealt(whole).mapInArrow(_linked_across(least, num, den), "src long, dst long"), "similar")


def links(texts: DataFrame, nodes: DataFrame, *, shingle: int, num: int, den: int, hub_bands: int = 8, hubs: int = 4) -> DataFrame:
    """``src, dst``: links that connect the same nodes as all pairs of the wanted similarity do.

    ``nodes`` has a row per different set: node, n, text_key, fp, bands, signature.
    """
    spark = texts.sparkSession
    prints = staged(nodes.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = simhash.links(prints.select("fp"))
    ends = near.join(prints.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(prints.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst")
    same = spread_join(nodes.select("node", "fp"), prints.select(F.col("fp").alias("own_fp"), "first"), "fp", "own_fp", "node").where("node <> first")
    start = ends.select("a", "b").unionAll(same.select(F.col("first").alias("a"), F.col("node").alias("b")))
    known = _verified(start.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, nodes, shingle, num, den)

    def current(links: DataFrame) -> DataFrame:
        return connected_components(links).select(F.col("node").alias("of"), F.col("root").alias("now"))

    def rows(count: int) -> DataFrame:
        """key, node, root of the first ``count`` bands, with the classes so far."""
        with_root = nodes.select("node", "bands").join(current(known), F.col("node") == F.col("of"), "left")
        return with_root.select(F.explode(F.slice("bands", 1, count)).alias("key"), "node", F.coalesce("now", "node").alias("root"))

    total = nodes.count()
    runs = _open_runs(rows(hub_bands), hubs, hub_bands * total)
    pairs = runs.where("root <> hub_root").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    known = known.unionAll(_verified(pairs, texts, nodes, shingle, num, den))
    runs = _open_runs(rows(BANDS), hubs, BANDS * total)
    return known if runs.isEmpty() else known.unionAll(_across(runs, texts, nodes, shingle, num, den))


def _open_runs(rows: DataFrame, hubs: int, total: int) -> DataFrame:
    """Rows of the runs (equal keys) that hold several classes: key, node, root, n, hub, hub_root, others.

    One hub for all runs of the same members, so that bands give the same pairs.
    """
    rank = F.xxhash64("node", F.pmod("key", F.lit(hubs)))
    known = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", rank).alias("hub"), F.min_by("root", rank).alias("hub_root"), F.min("root").alias("low"), F.max("root").alias("high"))
    known = staged(known.where("low <> high").select(F.col("key").alias("run"), "n", "hub", "hub_root"), "open")
    hot = hot_among(known.select("run", F.col("n").alias("count")), "run", total)
    return staged(spread_join(rows, known, "key", "run", "node", hot=hot).drop("run"), "runs")


def _parts_of_runs(runs: DataFrame, block: int = 512) -> DataFrame:
    """Each run's members against its others (those not of the hub's class), in parts of about
    ``block`` by ``block``: part, side, key, node, root, hub_root."""
    others = runs.where("root <> hub_root").groupBy(F.col("key").alias("run")).agg(F.count("*").alias("others"))
    counted = spread_join(runs, others, "key", "run", "node").drop("run")
    wide = counted.withColumns({"members": F.ceil(F.col("n") / block).cast("int"), "few": F.ceil(F.col("others") / block).cast("int")})
    place = lambda size: F.pmod(F.xxhash64("node"), size).cast("int")
    upto = lambda size: F.explode(F.sequence(F.lit(0), size - 1))
    left = wide.withColumns({"side": F.lit(0), "i": place(F.col("members"))}).withColumn("j", upto(F.col("few")))
    right = wide.where("root <> hub_root").withColumns({"side": F.lit(1), "j": place(F.col("few"))}).withColumn("i", upto(F.col("members")))
    return left.unionByName(right).select(F.xxhash64("key", "i", "j").alias("part"), "side", "key", "node", "root", "hub_root")


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each class, that of the smallest id, with the columns it came with.

    Each row is judged by its own text.  Of equal rows of id and text, one stays; a class whose
    ids are all null keeps one row.
    """
    spark = documents.sparkSession
    prepare(spark)
    texts = as_text(documents, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = texts.select("doc_id", _text_key(F.col("text")).alias("text_key"), "text")
    printed = staged(rows.mapInArrow(_printed(shingle), _PRINTED), "prints")
    first = printed.where("signature is not null").groupBy("node").agg(F.min("n").alias("n"), F.min("text_key").alias("text_key"), F.min("fp").alias("fp"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    nodes = staged(first, "nodes")
    roots = connected_components(links(texts, nodes, shingle=shingle, num=num, den=den)).select(F.col("node").alias("of"), "root")
    # Null ids come last: a class keeps one only if it has no other.
    own = printed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("own"))
    won = own.join(roots, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("own").alias("least"))
    id_key, text_key, mark = (unused_name(documents, n) for n in ("kept_id", "kept_text", "own_text"))
    kept = staged(won.select(F.col("least.doc_id").alias(id_key), F.col("least.text_key").alias(text_key)), "kept")
    marked = documents.withColumn(mark, _text_key(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    same = (F.col(mark) == F.col(text_key)) & F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_key))
    # One plan at every size: texts are dealt once and met by the rows that stay.
    out = marked.join(kept.hint("shuffle_hash"), same, "left_semi")
    repeated = printed.groupBy("doc_id", "text_key").count().where("count > 1")
    if not repeated.isEmpty():
        out = out.dropDuplicates([id_col, mark])
    return out.drop(mark)
