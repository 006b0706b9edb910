"""The operators bound to the driver's tables: query name to function, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as contamination
from . import bytebpe, html_text, negatives, pieces, prefix_trie, quality, secrets, simhash, token_rollup, topk, urlfilter, warc
from .common import fresh_path, table

#: The folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("RASTERLOOM_TOKENIZERS", "/opt/tokenizers")
#: The word pattern that goes with the byte-level rank files.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Listed domains and explicit rules of the URL filter.
LISTED = [f"{name}.example.{end}" for name in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org")]
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model", n=4, kept_words=600_000)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(name,) for name in LISTED], "name string")
    return urlfilter.judge(table(spark, sf_dir, "pages"), listed, RULES)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = warc.write(table(spark, sf_dir, "pages"), min_revisit_bytes=0)
    index = warc.normalise(raw)
    warc.remove(raw)
    return warc.read(index, payloads=False).drop("payload", "url")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "stop", "kind", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.score(documents, quality.train(documents, table(spark, sf_dir, "labels")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = topk.build_index(table(spark, sf_dir, "embeddings"))
    return topk.search(index, index.table.where(F.col("vec_id") % 50 == 0), k=5)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load all documents, take exact copies away, count what is left anew with the next version
    (another vocabulary), and commit every batch a second time."""
    documents = table(spark, sf_dir, "documents")
    store = token_rollup.TokenRollup(spark, fresh_path(spark, "tokens"))
    first, second = (token_rollup.BytePairCounter(f"{TOKENIZERS}/{name}.tiktoken", PATTERN) for name in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    for _ in range(2):
        store.insert("1-load", token_rollup.counted(documents, first, "byte_bpe_50k"))
        store.delete("2-copies", store.exact_copies())
        store.recount("3-recount", token_rollup.counted(documents, second, "byte_bpe_multi_50k"))
    return store.totals()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bytebpe.Codec(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", PATTERN)
    coded = bytebpe.decode(bytebpe.encode(table(spark, sf_dir, "documents"), codec), codec)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return negatives.mine(negatives.build_index(rows.select("vec_id", "embedding", label.alias("label"))), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.build(table(spark, sf_dir, "conversations"), graft=prefix_trie.Graft(every=20, heads=4))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_url_filter, op3_warc, op4_html_text, op5_secrets, op6_simhash, op7_quality, op8_topk, op9_token_counts, op10_decontamination, op11_byte_bpe, op12_hard_negatives, op13_prefix_trie)
}

_LISTED_SQL = ", ".join(f"'{d}'" for d in LISTED)

ORACLES: dict[str, str] = {
    "op2_url_filter": f"""
WITH parsed AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
marked AS (
  SELECT *, len(list_filter(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')), lambda d: d IN ({_LISTED_SQL}))) > 0 AS listed,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM marked""",
    "op3_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest FROM pages),
five AS (SELECT list_transform(range(0, 32), lambda i: lpad(bin(i), 5, '0')) AS f, list_transform(range(0, 16), lambda i: lpad(bin(i), 4, '0')) AS h),
b AS (
  SELECT *, array_to_string(list_transform(string_split(sha1(body), ''), lambda c: h[strpos('0123456789abcdef', c)]), '') AS bits FROM p, five)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_position(f, substr(bits, CAST(5 * i + 1 AS INT), 5)), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
FROM b""",
    # The given pages have one article each, of headings, paragraphs, bold text and line breaks.
    "op4_html_text": """
WITH a AS (SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<br>', ' ') AS body FROM pages),
b AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM c""",
    "op8_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(CAST(a.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS k
  FROM p JOIN s ON p.k <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3""",
    "op13_prefix_trie": """
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h FROM own),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.w, 1, c.h), []), list_slice(c.w, c.h + 1, len(c.w))) AS seq FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
steps AS (SELECT conv_id, len(seq) AS size, d, list_slice(seq, 1, d) AS path, seq[d].x AS said FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, any_value(CASE WHEN d > 0 THEN len(regexp_extract_all(said, '[^\x20\x09-\x0D]+')) ELSE 0 END) AS words,
    sha256(coalesce(string_agg(CASE WHEN size = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends FROM steps GROUP BY path, d),
kids AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
faced AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.path = nodes.path),
below AS (
  SELECT list_slice(path, 1, k) AS path, sum((n - 1) * words) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM faced) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM faced f JOIN below ON below.path = f.path LEFT JOIN nodes u ON f.d > 0 AND u.d = f.d - 1 AND u.path = list_slice(f.path, 1, f.d - 1)""",
    "op10_decontamination": """
WITH split AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
items AS (
  SELECT id AS item_id, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS win, least(13, len(w)) AS size
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM split WHERE side = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM items),
wins AS (
  SELECT id AS doc_id, p, size, array_to_string(list_slice(w, p, p + size - 1), ' ') AS win
  FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM split, sizes WHERE side = 'd' AND len(w) >= size)),
hits AS (SELECT doc_id, p, wins.size, item_id FROM wins JOIN items USING (win, size)),
words AS (SELECT doc_id, count(DISTINCT hit_at) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS hit_at FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS listed FROM hits GROUP BY doc_id)
SELECT s.id AS doc_id, CAST(len(s.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(s.w) AS contaminated
FROM split s LEFT JOIN words ON s.id = words.doc_id LEFT JOIN found ON s.id = found.doc_id WHERE s.side = 'd'""",
}
