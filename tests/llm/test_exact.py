"""Operators with an exact definition, against brute force over small and awkward tables."""

import base64
import gzip
import hashlib
import itertools
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm import components, decontaminate, simhash, topk, urlfilter, warc
from rasterloom.llm.catalog import LISTED, ORACLES, QUERIES, RULES

LONG = "word " * 30_000
SCHEMA = "doc_id long, text string, score string, fp string, words int"


def docs(spark, texts, first=0):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i + first, t, None, "x", 1) for i, t in enumerate(texts)], SCHEMA)


# ---- SimHash ------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = sorted((root(i), root(j)))
            up[b] = a
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "a B c", "a b c d", "A b c d e f g a b c d e", "é\u00a0x ü\u2003y " * 9, LONG])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_golay_keys_meet_up_to_two_errors():
    golay, rng = simhash.Golay(), np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 400).astype(np.uint32)
    for size in (0, 1, 2):
        for places in itertools.islice(itertools.combinations(range(23), size), 0, None, 17):
            moved = words ^ np.uint32(sum(1 << p for p in places))
            for a, b in zip(golay.keys(words).tolist(), golay.keys(moved).tolist(), strict=True):
                assert set(a) & set(b)


@pytest.mark.parametrize("block", [3, 4096])
def test_links_lose_nothing(spark, block):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    fps = set(seeds.tolist()) | {0, (1 << 64) - 1}
    for s in seeds[:12].tolist():  # chains and balls around some
        at = s
        for _ in range(14):
            for b in rng.choice(64, int(rng.integers(1, 6)), replace=False):
                at ^= 1 << int(b)
            fps.add(at)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = [(np.int64(r.src).view(np.uint64), np.int64(r.dst).view(np.uint64)) for r in simhash.links(table, block=block).collect()]
    assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in edges)
    place, want = {f: i for i, f in enumerate(fps)}, plain_classes(fps)
    up = list(range(len(fps)))
    for a, b in edges:
        x, y = up[place[int(a)]], up[place[int(b)]]
        up = [min(x, y) if u in (x, y) else u for u in up]
    assert up == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (150, 170), (300, 299), (299, 300), (None, 5)] + [(1000, 1001 + i) for i in range(50)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[200] == got[170] == 150 and got[300] == 299 and got[100] == 100 and got[1050] == 1000
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_classes(spark):
    base = "the quick brown fox jumps over the lazy dog while many other words follow in this rather long line of text " * 6
    texts = [base, base, base + "end", None, "", "solo words here", LONG, LONG + "x", base.upper()]
    rows = docs(spark, texts, 10).unionAll(docs(spark, [base], 10))  # one row twice
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_classes(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(rows).collect()}
    assert got == {10 + i: (f"{f:016x}", 10 + w) for i, (f, w) in enumerate(zip(fps, want, strict=True))}
    assert simhash.classes(docs(spark, [])).count() == 0


def test_repeated_and_null_ids_have_the_class_of_their_own_text(spark):
    rows = spark.createDataFrame([(3, "T t T"), (5, "T t T"), (5, "another text altogether, with words"), (None, "T t T"), (None, "alone")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in simhash.classes(rows).collect())
    fp = lambda t: f"{plain_fingerprint(t):016x}"
    assert got == sorted([(3, fp("T t T"), 3), (5, fp("T t T"), 3), (5, fp("another text altogether, with words"), 5), (-1, fp("T t T"), 3), (-1, fp("alone"), -1)])


def test_hot_fingerprints_and_hubs_are_spread(spark):
    """One class of nearly all rows: the salted joins must lose and repeat nothing."""
    rows = spark.range(3000).selectExpr("id as doc_id", "case when id % 10 < 8 then 'the same few words' else concat('x', id, ' y') end as text")
    got = simhash.classes(rows).where("doc_id % 10 < 8").groupBy("component_id").count().collect()
    assert [(r.component_id, r["count"]) for r in got] == [(0, 2400)] and simhash.classes(rows).count() == 3000
    star = spark.range(1, 2000).selectExpr("0 as src", "id as dst")
    assert components.connected_components(star).groupBy("root").count().collect()[0]["count"] == 2000


def test_op6_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    want = {ids[k]: (f"{fps[k]:016x}", ids[w]) for k, w in enumerate(plain_classes(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, sf_dir).collect()} == want


# ---- decontamination ------------------------------------------------------------------------


def plain_contamination(text, items, width=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, found = fold(text), set(), set()
    for item_id, item in items:
        own = fold(item)
        size = min(width, len(own))
        for w in [own[i : i + size] for i in range(len(own) - size + 1)] if own else []:
            for at in range(len(words) - size + 1):
                if words[at : at + size] == w:
                    hit |= set(range(at, at + size))
                    found.add(item_id)
    listed = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(words), len(hit), len(found), listed, bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [1, 2_000_000])
def test_decontamination(spark, block_words):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (12, passage.upper()), (2, "short item"), (3, None), (4, "?!"), (5, "a a a a a a a a a a a a a a a"), (9, " ".join(f"w{i}" for i in range(20, 40)))]
    texts = [None, "", "...", passage, "x " + passage[:60] + " y", "a " * 14, "Short, ITEM! " + "z " * 60, "z " * 400 + passage, LONG, "w0-w1_w2 " + passage, " ".join(passage.split()[:12]), "é" + passage]
    rows, table = docs(spark, texts), spark.createDataFrame([(i, t, True) for i, t in items], "item_id long, text string, contaminated boolean")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(rows, table, block_words=block_words).collect()}
    assert got == {i: plain_contamination(t, items) for i, t in enumerate(texts)}
    kept = decontaminate.keep_clean(rows, table, block_words=block_words)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, g in got.items() if not g[-1])
    unnamed = spark.createDataFrame([(None, passage), (None, "short item"), (8, passage)], "item_id long, text string")
    listed = {r.doc_id: (r.n_items, r.items_sha256) for r in decontaminate.decontaminate(rows, unnamed, block_words=block_words).collect()}
    assert listed[3] == (2, hashlib.sha256(b",8").hexdigest())
    none = table.limit(0)
    assert decontaminate.decontaminate(rows, none).where("contaminated").count() == 0 and decontaminate.keep_clean(rows, none).count() == len(texts)
    assert decontaminate.decontaminate(docs(spark, []), table, block_words=block_words).count() == 0


# ---- top-k ----------------------------------------------------------------------------------


def plain_topk(rows, k):
    """Whole-number scores; vectors of other lengths are filled up with zeros."""
    usable = [(i, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(256 * np.float64(x)) for x in v)]
    out = []
    for q, a in usable:
        if q % 50 == 0:
            score = lambda b: min(max(sum(x * y for x, y in zip(a, b)), -(2**63)), 2**63 - 1)  # noqa: B023, B905, E731
            scored = sorted((-score(b), i) for i, b in usable if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def topk_rows(table, **options):
    index = topk.build_index(table, pivots=options.pop("pivots", 6))
    return sorted(map(tuple, topk.search(index, index.table.where("vec_id % 50 = 0"), k=5, **options).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("query_block", [2, 4096])
def test_topk(spark, query_block):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 8).round(3).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[3][1]) for i in range(9)]  # many ties
    rows += [(2000, None), (2050, []), (2100, [None] + [0.1] * 7), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (None, rows[0][1]), (2250, [1e308] * 8)]
    rows += [(7, rows[9][1]), (50, rows[9][1])]  # repeated ids: of a candidate and of a query
    table = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert topk_rows(table, query_block=query_block) == plain_topk(rows, 5)
    few = topk.build_index(table.where("vec_id in (0, 1, 2)"))
    assert topk.search(few, few.table.where("vec_id = 0"), k=5).count() == 2
    none = topk.build_index(table.limit(0))
    assert topk.search(none, none.table, k=5).count() == 0


def test_topk_of_other_lengths_and_large_values(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, int(rng.integers(0, 7))).tolist()) for i in range(120)]
    rows += [(150, [1e7, -3.5]), (151, [1.0, 2.0]), (152, [1e7, 1.0]), (200, [2e13, 1.0, 7.0]), (201, [-2e13, 1.0]), (250, [0.0] * 4), (300, [1e300]), (301, [5e-324, 3.0]), (302, [2.0**45, 1.0, 2.0**-8])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk_rows(table, pivots=3) == plain_topk(rows, 5) == topk_rows(table, pivots=3, query_block=2)


@pytest.mark.parametrize("clustered", [True, False])
def test_bounds_prune(clustered):
    """Few candidates are evaluated: in clusters by far, on random directions thanks to many pivots."""
    rng = np.random.default_rng(4)
    ints = np.floor(np.concatenate([c + rng.normal(0, 3, (300, 16)) for c in rng.normal(0, 60, (6, 16))]) if clustered else rng.normal(0, 32, (4000, 64)))
    pivots = topk.Pivots(topk.pick_pivots(ints, 8 if clustered else 56))
    far = pivots.distances(ints)
    state = topk.Search([(i, topk.packed(ints[i]), far[i].tobytes()) for i in range(0, len(ints), 50)], pivots, 5).begin()
    state.take(np.arange(len(ints)), list(ints), far)
    assert state.evaluated < 0.25 * len(state.ids) * len(ints)


# ---- URL filter -------------------------------------------------------------------------------


def plain_host(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


URLS = ["http://WWW.Casino-Win.example.com/en/1?x", "https://a.example.net/en/x#y", "http://net/", "http://net", "http://example.com/de/x", "http://notexample.com/de/x", "ftp://x.org/fr/", "http://x.org/frx", None, "", "no scheme/net/", "a://b://c/d", "http://?q", "http://casino-win.example.com.evil.com/x", "http://É.example.org/ä/", "http://x.net\n/y"]


def test_url_judgement(spark):
    rows = spark.createDataFrame([(i, u, "net/") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string")
    got = {r.page_id: r for r in urlfilter.judge(rows, LISTED, RULES).collect()}
    for i, url in enumerate(URLS * 2):
        host, path = plain_host(url)
        assert (got[i].host, got[i].path) == (host, path), url
        parts = host.split(".")
        listed = any(".".join(parts[k:]) in LISTED for k in range(len(parts)))
        fit = max(((len(t), t, v) for v, t in RULES if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith("/" + t.split("/", 1)[1])), default=None)
        assert got[i].listed == listed and got[i].rule == (fit[1] if fit else None)
        assert got[i].verdict == (fit[2] if fit else "block" if listed else "allow")
    assert urlfilter.judge(rows.limit(0), LISTED, RULES).count() == 0


@pytest.mark.parametrize(("options", "shards", "least"), [({}, 1, 5), ({"bits_per_key": 1, "hashes": 1}, 1, 5), ({"max_filter_bytes": 1500}, 4, 2), ({"bits_per_key": 30, "hashes": 20}, 1, 1)])
def test_cascade_is_exact(spark, options, shards, least):
    keys = spark.range(30_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.pmod(F.xxhash64("id"), F.lit(3)) == 0).alias("listed"))
    cascades = urlfilter.build(keys, **options)
    assert len(cascades) >= shards and max(len(c.levels) for c in cascades) >= least
    assert all(sum(len(v.bits) for v in c.levels) <= options.get("max_filter_bytes", 8 << 20) for c in cascades)
    held = F.lit(False)
    for c in cascades:
        held = held | c.holds(F.col("key"))
    assert keys.where(held != F.col("listed")).count() == 0


def test_lists_are_tables_and_shards_are_probed_apart(spark):
    """A long list, split into several filters, with null and repeated names and names that no page has."""
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 700, '.site.example/', repeat('x', cast(id % 5 as int) * 4000)) as url", "false as listed")
    listed = spark.range(20_000).selectExpr("concat('h', id * 3, '.site.example') as name", "1 as key").unionAll(spark.createDataFrame([(None, 1), ("h1.site.example", 1), ("h1.site.example", 2)], "name string, key int"))
    for options in ({}, {"max_filter_bytes": 40}):
        got = {r.page_id: (r.listed, r.verdict, len(r.path)) for r in urlfilter.judge(pages, listed, [], **options).collect()}
        assert got == {i: ((n := i % 700) % 3 == 0 or n == 1, "block" if n % 3 == 0 or n == 1 else "allow", 1 + i % 5 * 4000) for i in range(3000)}
    assert urlfilter.judge(pages, listed.limit(0), []).where("listed").count() == 0


def test_query_needs_several_levels(spark):
    host, _ = urlfilter.host_and_path(F.col("url"))
    keys = urlfilter.universe_of(host, spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), LISTED)
    assert max(len(c.levels) for c in urlfilter.build(keys)) >= 3


# ---- WARC ---------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "<p>x</p>"), (8, "u", "y" * 3_000_000), (9, "u", "solo")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    raw = warc.write(rows, min_revisit_bytes=least)
    index = warc.normalise(raw)
    got = {r.page_id: r for r in warc.read(index).collect()}
    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        payload = (html or "").encode()
        same = [i for i, _, h in PAGES if (h or "").encode() == payload] if len(payload) >= least else [page_id]
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if max(same) == page_id else ("revisit", max(same)))
        if r.record_type == "response":
            assert bytes(r.payload) == payload
    for path in {r.path.removeprefix("file://") for r in index.collect()}:
        whole = open(path, "rb").read()
        lines = [x.split("\t") for x in open(path.replace(".warc.gz", ".idx")).read().splitlines()]
        assert sum(int(n) for _, _, n in lines) == len(whole)
        for name, at, n in lines:
            assert name.encode() in gzip.decompress(whole[int(at) : int(at) + int(n)])
    assert warc.read(warc.normalise(warc.write(rows.limit(0)))).count() == 0


def test_null_and_repeated_ids_revisit(spark, monkeypatch):
    monkeypatch.setattr(warc, "_INDEX_ROWS", 2)
    rows = [(1, "x"), (None, "x"), (7, "x"), (7, "x"), (None, "y"), (None, "y"), (None, None), (4, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' as url", "1 as sha")
    got = warc.read(warc.normalise(warc.write(pages.coalesce(1)))).collect()
    order = lambda t: tuple(-1 if x is None else x for x in t)
    want = [(1, "revisit", 7), (None, "revisit", 7), (7, "response", None), (7, "response", None), (None, "response", None), (None, "response", None), (None, "revisit", 4), (4, "response", None)]
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=lambda t: str(order(t))) == sorted(want, key=lambda t: str(order(t)))


def test_records_cut_anywhere():
    items = [warc.record(i, "u", b"a\r\n\r\n" * i, "response", None, "D") for i in range(5)]
    stream = b"".join(items)
    for step in (1, 7, 4096):
        reader = warc.RecordReader()
        assert [x for at in range(0, len(stream), step) for x in reader.feed(stream[at : at + step])] == items


# ---- SQL --------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf_dir, name):
    from run_oracle import compare, duck

    assert compare(spark, duck(sf_dir), name, QUERIES[name], ORACLES[name], sf_dir).startswith("ok")


def test_op3_equals_brute_force(spark, sf_dir):
    con = duckdb.connect()
    pages = con.execute(f"select page_id, html from '{sf_dir}/pages.parquet'").fetchall()
    last = {}
    for i, h in pages:
        last[h] = max(last.get(h, -1), i)
    want = sorted((i, len(h.encode()), "response" if last[h] == i else "revisit", None if last[h] == i else last[h]) for i, h in pages)
    got = QUERIES["op3_warc"](spark, sf_dir).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want and pa.__version__
