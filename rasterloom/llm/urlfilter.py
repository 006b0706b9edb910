"""URL filter: a Bloom filter cascade, exact over the corpus's keys, native and join-free.

The keys are every host of the corpus and every parent domain of it.  Level 1 is a
Bloom filter of the listed keys.  Level 2 holds the other keys that pass level 1, level 3
the listed keys that pass level 2, and so on, each smaller than the last, until no key is
wrong.  A key is listed if the first level that it doesn't pass is an even one (or if it
passes all of an odd number of levels), which over the complete key universe is exact
membership; a host is blocked if it or a parent is listed.

Level 1 lets pass about ``listed / (1.41 * others)`` of the other keys and each later level
half, which makes the sum of all levels small.  A level is blocked into buckets of at most 32768
bits: a hash picks the bucket, others the bits in it.  Buckets are made by
``bitmap_construct_agg`` (combined before the shuffle) and put into the plan as binary literals,
so probing is a column expression on the scan: no join of pages, no Python.  What a plan sends
is bounded: above ``max_filter_bytes`` for all levels the keys are split by hash into several
cascades, each within the bound, and each is probed by a scan of its own over (id, host, path).
The list is a table (or a few names); only its keys that the corpus has are encoded, by a join
of distinct keys while the filter is built.

Explicit rules (host suffix plus path prefix, longest wins) take precedence.

Null urls or urls without ``://``: host and path are empty, no rule fits, and the empty
key is never listed, so they are allowed.  Repeated urls are judged alike.  Very long urls are
read whole; a host of n labels has n keys.  Without pages there are no rows; null or repeated
names on the list count for nothing or once.  Only the id and url columns are read, so others
may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

_BUCKET_BITS = 32768
_BUCKET_BYTES = _BUCKET_BITS // 8


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and ``/ ? #`` or the end; from there to ``?``, ``#`` or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def suffixes(host: Column) -> Column:
    """The host and its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(F.length(host) > 0, every).otherwise(F.array().cast("array<string>"))


def _bucket(key: Column, level: int, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(f"bucket {level}")), F.lit(buckets)).cast("int")


def _bits(key: Column, level: int, hashes: int, width: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(f"bit {level} {i}")), F.lit(width)).cast("int") for i in range(hashes)]


class Level:
    """One Bloom filter, as a literal of ``buckets`` times ``width / 8`` bytes."""

    def __init__(self, number: int, keys: DataFrame, count: int, hashes: int, bits_per_key: float):
        self.number, self.hashes = number, hashes
        bits = max(8, ceil(count * bits_per_key))
        self.buckets = -(-bits // _BUCKET_BITS)
        self.width = _BUCKET_BITS if self.buckets > 1 else -(-bits // 8) * 8
        places = keys.select(_bucket(F.col("key"), number, self.buckets).alias("bucket"), F.explode(F.array(*_bits(F.col("key"), number, hashes, self.width))).alias("bit"))
        made = places.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
        # The empty buckets, too; then all in order, as one value.
        empty = keys.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(bytes(_BUCKET_BYTES)).alias("bits"))
        whole = made.unionAll(empty).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        ordered = F.array_sort(F.collect_list(F.struct("bucket", F.substring("bits", 1, self.width // 8).alias("bits"))))
        one = whole.agg(F.aggregate(ordered, F.lit(b""), lambda done, x: F.concat(done, x["bits"])).alias("bits"))
        self.bits = bytes(one.first().bits)  # bounded by max_filter_bytes

    def passes(self, key: Column) -> Column:
        start = _bucket(key, self.number, self.buckets) * (self.width // 8)
        value, out = F.lit(self.bits), F.lit(True)
        for bit in _bits(key, self.number, self.hashes, self.width):
            byte = F.conv(F.hex(F.substring(value, start + F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, bit % 8) == 1)
        return out


class Cascade:
    """Exact membership in ``listed`` for every key of the universe that it was built over."""

    def __init__(self, levels: list[Level], shard: int = 0, shards: int = 1):
        self.levels, self.shard, self.shards = levels, shard, shards

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.passes(key), out).otherwise(F.lit(level.number % 2 == 0))
        return out & (_shard(key, self.shards) == self.shard) if self.shards > 1 else out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards))


def build(universe: DataFrame, *, hashes: int | None = None, bits_per_key: float | None = None, max_filter_bytes: int = 8 << 20, max_levels: int = 64) -> list[Cascade]:
    """Cascades over ``universe(key string, listed boolean)``, one row a key.

    ``hashes`` and ``bits_per_key`` are those of level 1; by default they follow from the counts.
    """
    keys = staged(universe.select("key", "listed"), "keys")
    sizes = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    listed, others = sizes.get(True, 0), sizes.get(False, 0)
    doublings = max(1.0, log2(sqrt(2) * max(others, 1) / max(listed, 1)))  # log2 of 1 / wrong passes of level 1
    hashes = hashes or max(1, round(doublings))
    bits_per_key = bits_per_key or doublings / log(2)
    # The later levels take 2.04 bits a key for wrong passes and 1.44 for listed keys in all; four cover them.
    shards = max(1, ceil(listed * (bits_per_key + 4) / 8 / max_filter_bytes))
    return [_build_one(keys.where(_shard(F.col("key"), shards) == s) if shards > 1 else keys, s, shards, hashes, bits_per_key, max_levels) for s in range(shards)]


def _build_one(keys: DataFrame, shard: int, shards: int, hashes: int, bits_per_key: float, max_levels: int) -> Cascade:
    levels: list[Level] = []
    inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
    count = inside.count()
    while count:
        if len(levels) == max_levels:
            raise RuntimeError(f"{count} keys still wrong after {max_levels} levels")
        levels.append(Level(len(levels) + 1, inside, count, 1 if levels else hashes, 1 / log(2) if levels else bits_per_key))
        # Keys of this level stand against those of the other side that pass it.
        inside, outside = staged(outside.where(levels[-1].passes(F.col("key"))), "wrong"), inside
        count = inside.count()
    return Cascade(levels, shard, shards)


def universe_of(hosts: Column, corpus: DataFrame, listed: DataFrame | Sequence[str]) -> DataFrame:
    """Every key of the corpus, once, marked if it is on the list (the first column of a table, or names)."""
    keys = corpus.select(hosts.alias("host")).distinct().select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()
    if not isinstance(listed, DataFrame):
        listed = corpus.sparkSession.createDataFrame([(name,) for name in listed], "name string")
    names = listed.select(F.col(f"`{listed.columns[0]}`").cast("string").alias("name")).where("name is not null").distinct()
    return keys.join(names, F.col("key") == F.col("name"), "left").select("key", F.col("name").isNotNull().alias("listed"))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; a rule is (verdict, ``host/path``)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first: it is wrapped last
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame | Sequence[str], rules: Sequence[tuple[str, str]], *, id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """page_id, host, path, rule, verdict and ``listed`` (the cascade's answer) for every row."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    cascades = build(universe_of(host, pages, listed), **options)
    marked = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), F.lit(False).alias("listed"))
    for n, cascade in enumerate(cascades):
        held = F.col("listed") | F.exists(suffixes(F.col("host")), cascade.holds)
        marked = marked.withColumn("listed", held)
        if n + 1 < len(cascades):
            marked = staged(marked, "marked")  # one plan never holds two shards
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "listed")
