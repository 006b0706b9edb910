"""Query name to function and to SQL, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import boxes as B
from .functions import lexicon as L
from .functions import text as T
from .operators import evaluation as E
from .operators import grid as G
from .operators import records as R
from .operators import imagery, router, scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")




_PAIRS = """
used AS (SELECT conv_id, turn, lower(role) IN ('human', 'user') AS asks, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS said FROM conversations
  WHERE lower(role) IN ('human', 'user', 'gpt', 'assistant', 'model') AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''),
seen AS (SELECT *, max(CASE WHEN asks THEN turn END) OVER w AS asked, max(CASE WHEN NOT asks THEN turn END) OVER w AS answered FROM used
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pairs AS (SELECT a.conv_id, a.asked AS question_turn, a.turn AS answer_turn,
    regexp_replace(regexp_replace(q.said, '<image>\\s*', '', 'gi'), '^\\s+|\\s+$', '', 'g') AS question, a.said AS answer
  FROM seen a JOIN used q ON q.conv_id = a.conv_id AND q.turn = a.asked WHERE NOT a.asks AND (a.answered IS NULL OR a.asked > a.answered))"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {_PAIRS} SELECT * FROM pairs WHERE question <> ''")
def conv_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"""WITH {_PAIRS}, tagged AS (SELECT CASE WHEN lower(question) LIKE '%describe%' OR lower(question) LIKE '%caption%' OR lower(question) LIKE '%provide a description%' OR lower(question) LIKE '%give a description%'
    OR lower(question) LIKE '%summarize the image%' OR len(string_split_regex(answer, '\\s+')) >= 20 THEN 'caption' ELSE 'vqa' END AS task, len(string_split_regex(answer, '\\s+')) AS n FROM pairs WHERE question <> '')
SELECT task, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS words, CAST(count(*) FILTER (n > 0 AND n <= 12) AS BIGINT) AS short_answers FROM tagged GROUP BY task""")
def conv_pairs_word_stats(spark, sf_dir):
    n = F.size(T.words(F.col("answer")))
    tagged = _pairs(spark, sf_dir).select(F.when(T.is_caption(F.col("question"), F.col("answer")), "caption").otherwise("vqa").alias("task"), n.alias("n"))
    return tagged.groupBy("task").agg(F.count("*").alias("pairs"), F.sum("n").cast("long").alias("words"), F.count_if((F.col("n") > 0) & (F.col("n") <= 12)).alias("short_answers"))


@query(f"""WITH {_PAIRS} SELECT conv_id, 'answer en ' || question AS vqa,
  'answer en The left image is from time T1, the right image is from time T2. Answer the question about what changed: ' || question AS change FROM pairs WHERE question <> ''""")
def prompts(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", T.vqa_prompt(F.col("question")).alias("vqa"), T.change_prompt(F.col("question")).alias("change"))


@query("SELECT left(sha1(text), 16) AS content_id, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def doc_content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("content_id"))
    return docs.groupBy("content_id").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("""SELECT conv_id, turn, left(sha1(text || nxt), 16) AS pair_id FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL""")
def pair_content_id(spark, sf_dir):
    nxt = F.lead("text").over(R.Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", nxt.alias("nxt")).where("nxt is not null").select("conv_id", "turn", T.content_id(F.col("text"), F.col("nxt")).alias("pair_id"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'no_answer_for_question' WHEN d.n_chars < 200 THEN 'too_short' WHEN l.toxic = 1 THEN 'flagged' ELSE 'kept' END AS reason
  FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY reason""")
def label_join_reasons(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled")
    joined = R.join_answers(docs, labels, "doc_id", "labelled", [F.col("quality")])
    reason = R.reasons([("no_answer_for_question", F.col("labelled").isNull()), ("too_short", F.col("n_chars") < 200), ("flagged", F.col("toxic") == 1)])
    return joined.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type <> 'refund') WHERE k = 1""")
def first_answer_wins(spark, sf_dir):
    live = table(spark, sf_dir, "events").where(F.col("event_type") != "refund").select("user_id", "event_id", "event_type", "ts")
    return R.first_per_key(live, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


_BASE = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1)"


@query(f"""WITH names AS (SELECT page_id, url, {_BASE} AS base FROM pages), files AS (SELECT min(url) AS image, base FROM names GROUP BY base),
  stems AS (SELECT min(url) AS image, regexp_replace(base, '(.)\\.[^.]*$', '\\1') AS stem FROM names GROUP BY 2), wanted AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN base ELSE regexp_replace(base, '(.)\\.[^.]*$', '\\1') || '.png' END AS name FROM names)
SELECT page_id, name, coalesce(f.image, s.image) AS image FROM wanted w LEFT JOIN files f ON f.base = w.name LEFT JOIN stems s ON s.stem = regexp_replace(w.name, '(.)\\.[^.]*$', '\\1')""")
def image_index_fallback(spark, sf_dir):
    base = F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"([^/]*)/?$", 1)
    names = table(spark, sf_dir, "pages").select("page_id", "url", base.alias("base"))
    wanted = names.select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("base")).otherwise(F.concat(T.stem(F.col("base")), F.lit(".png"))).alias("name"))
    return R.resolve_images(wanted, names.select("url", "base"), "name", "url", base="base").select("page_id", "name", "image")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans_anti(spark, sf_dir):
    return R.orphans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def kept_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "source")


def _split_sql(rows: str, group: str, fraction: float, seed: int) -> str:
    return f"""keys AS (SELECT DISTINCT {group} AS g FROM {rows} WHERE {group} IS NOT NULL), ranked AS (SELECT g, row_number() OVER (ORDER BY md5('{seed}|' || CAST(g AS VARCHAR)), g) AS k, count(*) OVER () AS n FROM keys),
  marked AS (SELECT r.*, coalesce(k <= greatest(1, CAST(floor(n * {fraction}) AS BIGINT)), false) AS is_val FROM {rows} r LEFT JOIN ranked ON g = {group})"""


@query(f"WITH {_split_sql('documents', 'source', 0.2, 13)} SELECT source FROM marked WHERE is_val INTERSECT SELECT source FROM marked WHERE NOT is_val")
def leakage_intersect(spark, sf_dir):
    marked = R.split_by_group(table(spark, sf_dir, "documents"), "source", 0.2, seed=13)
    return R.leaked(marked.where("is_val"), marked.where("not is_val"), "source")


@query(f"WITH {_split_sql('lineitem', 'l_orderkey', 0.1, 7)} SELECT l_orderkey, is_val, count(*) AS n FROM marked GROUP BY 1, 2")
def split_by_group(spark, sf_dir):
    marked = R.split_by_group(table(spark, sf_dir, "lineitem"), "l_orderkey", 0.1, seed=7)
    return marked.groupBy("l_orderkey", "is_val").agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5('3|' || CAST(event_id AS VARCHAR)), event_id) AS k FROM events) WHERE k <= 3")
def cap_per_group(spark, sf_dir):
    return R.cap_per_group(table(spark, sf_dir, "events").select("event_id", "user_id"), ["user_id"], ["event_id"], 3, seed=3)


def _balance_sql(rows: str, scope: str, fraction: str, free: str = "false") -> str:
    s = f"{scope}, " if scope else ""
    on = f"USING ({scope})" if scope else "ON true"
    return f"""src AS ({rows}), counts AS (SELECT {s}answer, count(*) AS n FROM src GROUP BY ALL), facts AS (SELECT {s}max(n) AS most, count(*) AS answers FROM counts {'GROUP BY ' + scope if scope else ''}),
  tried AS (SELECT {s}c, sum(least(n, c)) AS total, any_value(answers) AS answers FROM (SELECT *, unnest(range(1, most + 1)) AS c FROM facts) JOIN counts {on} GROUP BY {s}c),
  caps AS (SELECT {s}coalesce(max(CASE WHEN c <= greatest(1, floor(total * ({fraction}))) THEN c END), 1) AS cap, max(c) AS most, any_value(answers) AS answers FROM tried {'GROUP BY ' + scope if scope else ''}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY {s}answer ORDER BY md5('0|' || CAST(id AS VARCHAR)), id) AS k FROM src)
SELECT {s}answer, id FROM ranked JOIN caps {on} WHERE k <= CASE WHEN {free} THEN most ELSE cap END"""


_CLASSES = "CASE WHEN value < 20 THEN 'yes' WHEN value < 25 THEN 'no' WHEN value < 40 THEN event_type ELSE 'many' END"


@query("WITH " + _balance_sql(f"SELECT event_id AS id, {_CLASSES} AS answer FROM events", "", "0.2"))
def balance_global(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id as id", f"{_CLASSES} as answer")
    return R.balance(rows, F.col("answer"), ["id"], 0.2).select("answer", "id")


@query("WITH " + _balance_sql("SELECT o_orderkey AS id, o_orderstatus AS type, lower(CASE WHEN o_totalprice < 100000 THEN 'low' ELSE o_orderpriority END) AS answer FROM orders", "type", "greatest(0.25, 1.0 / answers)", "answers < 2 OR answers > 12"))
def balance_per_type(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "o_orderstatus as type", "lower(case when o_totalprice < 100000 then 'low' else o_orderpriority end) as answer")
    return R.balance(rows, F.col("answer"), ["id"], 0.25, ["type"], floor_by_count=True, min_answers=2, max_answers=12).select("type", "answer", "id")


@query("""WITH a AS (SELECT lower(o_orderpriority) AS a, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS answers, max(n) / sum(n) AS top FROM a)
SELECT records, (SELECT count(DISTINCT o_custkey) FROM orders) AS "groups", answers, round(top, 6) AS top_answer_fraction, records < 2000 AS too_few_records, answers < 100 AS too_few_answers, top > 0.35 AS dominant_answer FROM s""")
def quality_gate_stats(spark, sf_dir):
    stats = R.quality_problems(R.quality_stats(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderpriority")))
    return stats.select("records", "groups", "answers", F.round("top_answer_fraction", 6).alias("top_answer_fraction"), *[F.array_contains("problems", p).alias(p) for p in ("too_few_records", "too_few_answers", "dominant_answer")])


@query("""SELECT l_returnflag, answers, round(share, 6) AS top_share, answers = 2 AND share > 0.7 AS skewed FROM (SELECT l_returnflag, count(*) AS answers, max(n) / sum(n) AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1)""")
def template_skew(spark, sf_dir):
    return R.template_skew(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_linestatus")).withColumn("top_share", F.round("top_share", 6))


@query("SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, min(p_partkey), p_type LIMIT 20")
def top_answers(spark, sf_dir):
    return R.top_values(table(spark, sf_dir, "part").select(F.col("p_type").alias("value"), "p_partkey"), "value", "p_partkey", 20)


@query("""SELECT p_partkey FROM (SELECT *, CASE p_partkey % 5 WHEN 0 THEN ' Urban and natural LAND-cover. ' WHEN 1 THEN 'urban and natural land-cover' ELSE p_name END AS answer, CASE WHEN p_partkey % 7 = 0 THEN 'Describe the visible features.' ELSE 'what is it' END AS question FROM part)
WHERE lower(trim(answer)) IN ('urban and natural land-cover.', 'urban and natural land-cover') OR lower(trim(question)) IN ('describe the visible features in this image.', 'describe the visible features.')""")
def forbidden_values(spark, sf_dir):
    key = F.col("p_partkey")
    answer = F.when(key % 5 == 0, " Urban and natural LAND-cover. ").when(key % 5 == 1, "urban and natural land-cover").otherwise(F.col("p_name"))
    question = F.when(key % 7 == 0, "Describe the visible features.").otherwise("what is it")
    return table(spark, sf_dir, "part").where(T.is_forbidden(question, answer)).select("p_partkey")


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('refund', 'click') GROUP BY 1")
def banned_types(spark, sf_dir):
    banned = spark.createDataFrame([("refund",), ("click",)], "event_type string")
    return table(spark, sf_dir, "events").join(F.broadcast(banned), "event_type", "left_semi").groupBy("event_type").agg(F.count("*").alias("n"))  # two rows


@query("SELECT count(*) AS total, count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) < 5) AS failed, round(count(*) FILTER (TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NULL OR TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) < 5) / count(*), 6) AS fraction FROM events")
def failure_fraction(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return R.failure_fraction(table(spark, sf_dir, "events"), k.isNull() | (k < 5)).withColumn("fraction", F.round("fraction", 6))


@query("SELECT event_id, json_extract_string(props, '$.k') AS answer FROM events")
def jsonl_alias_coalesce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.first_text(F.try_parse_json("props"), ["answer", "label", "k"]).alias("answer"))


@query("""SELECT unit, round(max(hi), 3) AS max_value, round(min(lo), 3) AS min_value, any_value(CASE WHEN m <= 1.5 THEN 'normalised_0_1' WHEN m <= 100.5 THEN 'percent_0_100' WHEN m <= 1000.5 THEN 'per_mille_0_999' ELSE 'absolute_pixels' END) AS convention,
  any_value(CASE WHEN m <= 1.5 THEN 1.0 WHEN m <= 100.5 THEN 100.0 WHEN m <= 1000.5 THEN 999.0 END)::DOUBLE AS divisor
FROM (SELECT *, max(hi) OVER (PARTITION BY unit) AS m FROM (SELECT l_shipmode AS unit, greatest(x0, x1) AS hi, least(x0, x1) AS lo FROM (SELECT CAST(l_linenumber AS VARCHAR) AS l_shipmode, l_quantity * power(10, l_linenumber - 3) AS x0, (l_quantity + 1) * power(10, l_linenumber - 3) AS x1 FROM lineitem))) GROUP BY unit""")
def bbox_convention(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").selectExpr("cast(l_linenumber as string) as unit", "l_quantity * power(10, l_linenumber - 3) as x0", "(l_quantity + 1) * power(10, l_linenumber - 3) as x1")
    ends = boxes.groupBy("unit").agg(F.max(F.greatest("x0", "x1")).alias("hi"), F.min(F.least("x0", "x1")).alias("lo"))
    name, divisor = B.convention(F.col("hi"))
    return ends.select("unit", F.round("hi", 3).alias("max_value"), F.round("lo", 3).alias("min_value"), name.alias("convention"), divisor.cast("double").alias("divisor"))


_GOLD = "l_partkey % 50 AS x0, l_suppkey % 40 AS y0, l_partkey % 50 + l_quantity AS x1, l_suppkey % 40 + 10 + l_linenumber AS y1"
_IOU_SQL = """CASE WHEN iw > 0 AND ih > 0 THEN iw * ih / ((gx1 - gx0) * (gy1 - gy0) + (px1 - px0) * (py1 - py0) - iw * ih) ELSE 0 END"""
_BOXES_SQL = f"""g AS (SELECT l_orderkey, l_linestatus, {_GOLD} FROM lineitem WHERE l_linenumber = 1), p AS (SELECT l_orderkey, {_GOLD} FROM lineitem WHERE l_linenumber > 1),
  m AS (SELECT l_orderkey, l_linestatus, g.x0 AS gx0, g.y0 AS gy0, g.x1 AS gx1, g.y1 AS gy1, p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1, least(g.x1, p.x1) - greatest(g.x0, p.x0) AS iw, least(g.y1, p.y1) - greatest(g.y0, p.y0) AS ih FROM g LEFT JOIN p USING (l_orderkey)),
  best AS (SELECT l_orderkey, l_linestatus, max(CASE WHEN px0 IS NOT NULL THEN {_IOU_SQL} END) AS iou FROM m GROUP BY ALL)"""


def _best_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    shape = [e.replace(" AS ", " as ") for e in _GOLD.split(", ")]
    gold = items.where("l_linenumber = 1").selectExpr("l_orderkey", "l_linestatus", *[e.rsplit(" ", 1)[0] + " g" + e.rsplit(" ", 1)[1] for e in shape])
    said = items.where("l_linenumber > 1").selectExpr("l_orderkey", *[e.rsplit(" ", 1)[0] + " p" + e.rsplit(" ", 1)[1] for e in shape])
    box = lambda t: tuple(F.col(f"{t}{c}").cast("double") for c in ("x0", "y0", "x1", "y1"))
    scored = gold.join(said, "l_orderkey", "left").withColumn("iou", F.when(F.col("px0").isNotNull(), B.iou(box("g"), box("p"))))
    return scored.groupBy("l_orderkey", "l_linestatus").agg(F.max("iou").alias("iou"))


@query(f"WITH {_BOXES_SQL} SELECT l_orderkey, l_linestatus, round(iou, 6) AS iou FROM best")
def best_iou(spark, sf_dir):
    return _best_iou(spark, sf_dir).withColumn("iou", F.round("iou", 6))


@query(f"""WITH {_BOXES_SQL} SELECT l_linestatus, count(*) AS n, round(avg(coalesce(iou, 0)), 6) AS mean_iou, round(avg(CASE WHEN coalesce(iou, 0) >= 0.5 THEN 1.0 ELSE 0 END), 6) AS acc_50, round(avg(CASE WHEN coalesce(iou, 0) >= 0.25 THEN 1.0 ELSE 0 END), 6) AS acc_25,
  round(avg(CASE WHEN iou IS NULL THEN 1.0 ELSE 0 END), 6) AS no_detection_rate, avg(coalesce(iou, 0)) < 0.1 AS collapsed FROM best GROUP BY 1""")
def box_metrics(spark, sf_dir):
    rounded = [F.round(c, 6).alias(c) for c in ("mean_iou", "acc_50", "acc_25", "no_detection_rate")]
    return E.box_metrics(_best_iou(spark, sf_dir), ["l_linestatus"]).select("l_linestatus", "n", *rounded, "collapsed")


_FOOT_A = "SELECT s_suppkey AS id, s_acctbal / 100 AS x0, s_suppkey % 97 AS y0, s_acctbal / 100 + 6 AS x1, s_suppkey % 97 + 6 AS y1 FROM supplier"
_FOOT_B = "SELECT c_custkey AS id, c_acctbal / 100 AS x0, c_custkey % 97 AS y0, c_acctbal / 100 + 8 AS x1, c_custkey % 97 + 5 AS y1 FROM customer"


@query(f"""SELECT a.id AS left_id, b.id AS right_id, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)), 6) AS overlap
FROM ({_FOOT_A}) a JOIN ({_FOOT_B}) b ON a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
WHERE (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) >= 0.6""")
def footprint_overlap(spark, sf_dir):
    rect = lambda sql, name: table(spark, sf_dir, name).selectExpr(*[f"cast({e.rsplit(' AS ', 1)[0]} as {'long' if e.endswith(' id') else 'double'}) as {e.rsplit(' AS ', 1)[1]}" for e in sql.removeprefix("SELECT ").split(" FROM ")[0].split(", ")])
    return scenes.footprint_pairs(rect(_FOOT_A, "supplier"), rect(_FOOT_B, "customer"), 10.0).withColumn("overlap", F.round("overlap", 6))


_SCENES = """SELECT s_suppkey, s_suppkey % 11 <> 0 AS a_valid, true AS b_valid, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'EPSG:32643' END AS a_crs, CASE WHEN s_suppkey % 13 = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN 'EPSG:4326' ELSE 'EPSG:32643' END AS b_crs,
  100 AS a_w, 100 AS a_h, CASE WHEN s_suppkey % 3 = 0 THEN 120 ELSE 100 END AS b_w, 100 AS b_h, 0.0 AS a_x0, 0.0 AS a_y0, 1000.0 AS a_x1, 1000.0 AS a_y1, sh AS b_x0, sh AS b_y0, 1000.0 + sh AS b_x1, 1000.0 + sh AS b_y1,
  10.0 AS a_rx, 10.0 AS a_ry, CASE WHEN s_suppkey % 5 = 1 THEN 20.0 ELSE 10.0 END AS b_rx, 10.0 AS b_ry
FROM (SELECT *, CAST(CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 100 ELSE 900 END AS DOUBLE) AS sh FROM supplier)"""


@query(f"""WITH s AS ({_SCENES}), o AS (SELECT *, CASE WHEN b_x0 >= a_x1 THEN 0 ELSE (a_x1 - b_x0) * (a_y1 - b_y0) / 1000000.0 END AS ov, abs(a_x0 - b_x0) / 10.0 AS d, a_w = b_w AND a_h = b_h AS dims, abs(a_rx - b_rx) <= 0.2 AS res, a_crs IS NOT NULL AND b_crs IS NOT NULL AS located FROM s),
  t AS (SELECT *, CASE WHEN NOT a_valid THEN 'unreadable' WHEN NOT located AND dims THEN 'not_georeferenced' WHEN NOT located THEN 'dimension_mismatch' WHEN a_crs <> b_crs OR ov < 0.6 THEN 'no_overlap' WHEN dims AND res AND d < 1e-6 THEN 'identical_grid' WHEN res AND d <= 1 THEN 'aligned_within_tolerance' ELSE 'resampling_required' END AS status FROM o)
SELECT s_suppkey, status, status NOT IN ('unreadable', 'no_overlap') AS ok_to_proceed, status IN ('identical_grid', 'aligned_within_tolerance') AS verified, status IN ('dimension_mismatch', 'resampling_required') OR (status = 'aligned_within_tolerance' AND NOT dims) AS requires_resampling,
  CASE WHEN located THEN round(ov, 6) END AS overlap FROM t""")
def coregistration_status(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_supplier_scenes")
    pairs = spark.sql(_SCENES.replace("FROM supplier", "FROM _supplier_scenes"))
    for c in pairs.columns:
        if dict(pairs.dtypes)[c].startswith("decimal"):
            pairs = pairs.withColumn(c, F.col(c).cast("double"))
    return scenes.coregister(pairs).select("s_suppkey", "status", "ok_to_proceed", "verified", "requires_resampling", F.round("overlap", 6).alias("overlap"))


@query("""WITH b AS (SELECT p_partkey, p_size * 20 AS w, 100 + p_partkey % 700 AS h, CAST(p_partkey % 90 AS DOUBLE) AS x0, CAST(p_partkey % 70 AS DOUBLE) AS y0 FROM part),
  f AS (SELECT *, least(224.0 / w, 224.0 / h) AS s FROM b), n AS (SELECT *, greatest(1, CAST(round_even(w * s, 0) AS INT)) AS nw, greatest(1, CAST(round_even(h * s, 0) AS INT)) AS nh FROM f),
  o AS (SELECT *, CAST(floor((224 - nw) / 2) AS INT) AS dx, CAST(floor((224 - nh) / 2) AS INT) AS dy FROM n)
SELECT p_partkey, nw AS new_w, nh AS new_h, dx, dy, round(x0 * s + dx, 6) AS cx0, round(y0 * s + dy, 6) AS cy0, round(greatest(0, least(x0, w)), 6) AS bx0, round(greatest(0, least(y0, h)), 6) AS by0 FROM o""")
def letterbox_roundtrip(spark, sf_dir):
    c = F.col
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size * 20 as w", "100 + p_partkey % 700 as h", "cast(p_partkey % 90 as double) as x0", "cast(p_partkey % 70 as double) as y0").withColumns({"x1": c("x0") + 5, "y1": c("y0") + 5})
    fit = B.letterbox(c("w"), c("h"))
    on = B.to_canvas((c("x0"), c("y0"), c("x1"), c("y1")), c("w"), c("h"))
    back = B.from_canvas(on, c("w"), c("h"))
    return boxes.select("p_partkey", fit["new_w"].alias("new_w"), fit["new_h"].alias("new_h"), fit["dx"].alias("dx"), fit["dy"].alias("dy"), F.round(on[0], 6).alias("cx0"), F.round(on[1], 6).alias("cy0"), F.round(back[0], 6).alias("bx0"), F.round(back[1], 6).alias("by0"))


_TOKEN_SQL = "'<loc' || lpad(CAST(CAST(greatest(0, least(1023, round_even({} / 224.0 * 1023, 0))) AS INT) AS VARCHAR), 4, '0') || '>'"


@query(f"""WITH b AS (SELECT p_partkey, p_name, CAST(p_partkey % 300 AS DOUBLE) AS x0, CAST(p_partkey % 211 AS DOUBLE) AS y0, CAST(p_size * 4 AS DOUBLE) AS x1, CAST(p_size * 3 AS DOUBLE) AS y1 FROM part),
  e AS (SELECT p_partkey, p_name, {_TOKEN_SQL.format('least(y0, y1)')} || {_TOKEN_SQL.format('least(x0, x1)')} || {_TOKEN_SQL.format('greatest(y0, y1)')} || {_TOKEN_SQL.format('greatest(x0, x1)')} AS tokens FROM b)
SELECT p_partkey, tokens || ' ' || p_name AS suffix, round(CAST(tokens[14:17] AS INT) * (224 / 1023.0::DOUBLE), 6) AS x0, round(CAST(tokens[5:8] AS INT) * (224 / 1023.0::DOUBLE), 6) AS y0, p_name AS label FROM e""")
def loc_tokens(spark, sf_dir):
    c = F.col
    boxes = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "array(named_struct('x0', cast(p_partkey % 300 as double), 'y0', cast(p_partkey % 211 as double), 'x1', cast(p_size * 4 as double), 'y1', cast(p_size * 3 as double))) as b")
    said = boxes.select("p_partkey", B.detect_suffix(c("b"), F.array("p_name")).alias("suffix"))
    first = said.withColumn("d", B.decode_tokens(c("suffix"))[0])
    return first.select("p_partkey", "suffix", F.round("d.x0", 6).alias("x0"), F.round("d.y0", 6).alias("y0"), c("d.label").alias("label"))


_NORM_SQL = "array_to_string(list_filter(string_split_regex(regexp_replace(translate(regexp_replace(lower({0}), '^\\s+|\\s+$', '', 'g'), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~', ''), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@query(f"SELECT item_id, {_NORM_SQL.format('text')} AS answer FROM benchmark")
def answer_normalise(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.normalise_answer(F.col("text")).alias("answer"))


@query(f"""WITH n AS (SELECT b.item_id, d.doc_id, list_filter(string_split({_NORM_SQL.format('d.text')}, ' '), lambda w: w <> '') AS p, list_filter(string_split({_NORM_SQL.format('b.text')}, ' '), lambda w: w <> '') AS g FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id),
  o AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda x: x = w)), len(list_filter(g, lambda x: x = w))))) AS k FROM n)
SELECT item_id, doc_id, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CAST(len(p) = len(g) AS INT) WHEN k = 0 THEN 0 ELSE 2.0 * k / (len(p) + len(g)) END, 6)::DOUBLE AS f1 FROM o""")
def token_f1_pairs(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("gold"))
    count = items.agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").join(count).select("doc_id", F.col("text").alias("said"), (F.col("doc_id") % F.col("n")).alias("item"))  # one row
    return docs.join(items, F.col("item") == F.col("item_id")).select("item_id", "doc_id", F.round(T.token_f1(F.col("said"), F.col("gold")), 6).alias("f1"))


@query("""WITH r AS (SELECT CAST(toxic AS VARCHAR) AS p, CAST(quality AS VARCHAR) AS g FROM labels), n AS (SELECT count(*) AS n, avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END) AS em FROM r),
  a AS (SELECT count(*) AS d, max(k) AS m FROM (SELECT p, count(*) AS k FROM r GROUP BY p)), b AS (SELECT count(*) AS d, max(k) AS m FROM (SELECT g, count(*) AS k FROM r GROUP BY g))
SELECT n, round(em, 6) AS exact_match, round(em, 6) AS token_f1, round(a.d / n, 6) AS distinct_ratio, round(a.m / n, 6) AS most_common_fraction, round(b.m / n, 6) AS majority_baseline, round(b.d / n, 6) AS gold_distinct_ratio,
  a.d / n < 0.1 OR a.m / n > 0.6 AS collapsed, em > b.m / n AS beats_majority_baseline FROM n, a, b""")
def text_metrics(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    out = E.text_metrics(E.text_rows(labels, F.col("toxic").cast("string"), F.col("quality").cast("string")))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:7]], "collapsed", "beats_majority_baseline")


@query("SELECT lang, count(*) AS n, round(avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END), 6) AS exact_match FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def metrics_rollup(spark, sf_dir):
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.by_type(E.text_rows(joined, F.col("quality").cast("string"), F.col("toxic").cast("string"), ["lang"]), "lang").withColumn("exact_match", F.round("exact_match", 6))


# ---- routing ----------------------------------------------------------------------------

_ASKED = [
    (1, "How many buildings are there in this image?", "single", 1), (2, "Describe the land-cover and major objects.", "single", 1), (3, "Highlight the water body near the built-up area", "single", 1),
    (4, "What changed between the two dates?", "bi_temporal", 2), (5, "Use the optical and SAR images together to identify built-up and water regions", "cross_modal", 2), (6, "what has changed over time near the runway", "single", 1),
    (7, "Locate the storage tank and the oil tank by the harbour", "single", 1), (8, "tanker routes", "single", 1), (9, "", "single", 1), (10, "Locate it", "single", 1), (11, "which roads remained unchanged", "bi_temporal", 2), (12, "Is the car park next to a golf course or a stadium, a lake, a dam?", "single", 1),
]
#: The questions above, and every user turn of the conversations with a mode and a number of images of its own.
_ASKED_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}', '{m}', {n})" for i, q, m, n in _ASKED) + """) UNION ALL
  SELECT CAST(1000 + conv_id * 100 + turn AS INT), text, ['single', 'bi_temporal', 'cross_modal'][CAST(1 + conv_id % 3 AS INT)], CAST(1 + turn % 2 AS INT) FROM conversations WHERE role = 'user'"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    mode = F.element_at(F.array(F.lit("single"), F.lit("bi_temporal"), F.lit("cross_modal")), (1 + c("conv_id") % 3).cast("int"))
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    said = turns.select((1000 + c("conv_id") * 100 + c("turn")).cast("int").alias("request_id"), c("text").alias("query"), mode.alias("input_mode"), (1 + c("turn") % 2).cast("int").alias("image_count"))
    return spark.createDataFrame(_ASKED, "request_id int, query string, input_mode string, image_count int").unionByName(said)


def _score_sql(task: str) -> str:
    cues = " + ".join(f"CASE WHEN contains(q, '{cue}') THEN {w} ELSE 0 END" for cue, w in L.CUES[task].items())
    bonus = "".join(f" + CASE WHEN input_mode = '{m}' THEN {b} ELSE 0 END" for m, (t, b) in L.MODE_BONUS.items() if t == task)
    return f"CAST({cues}{bonus} AS DOUBLE)"


_SCORES_SQL = f"""asked(request_id, query, input_mode, image_count) AS ({_ASKED_SQL}), low AS (SELECT *, regexp_replace(regexp_replace(lower(query), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS q FROM asked),
  raw AS (SELECT *, {', '.join(f'{_score_sql(t)} AS {t}' for t in L.TASKS)} FROM low), scored AS (SELECT * REPLACE (CASE WHEN greatest({', '.join(L.TASKS)}) = 0 THEN 1.0 ELSE vqa END AS vqa) FROM raw)"""


@query(f"WITH {_SCORES_SQL} SELECT request_id, {', '.join(f'round({t}, 6)::DOUBLE AS score_{t}' for t in L.TASKS)} FROM scored")
def intent_scores(spark, sf_dir):
    return router.with_scores(_asked(spark, sf_dir)).select("request_id", *[F.round(f"score_{t}", 6).alias(f"score_{t}") for t in L.TASKS])


_FORMS_SQL = "VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in L.ENTITIES.items())
# Every place of every form as a whole word; a form inside a longer one that starts no later goes.
_ENTITY_SQL = f"""forms(form, phrase) AS ({_FORMS_SQL}), spots AS (SELECT id, q, unnest(range(1, len(q) + 1)) AS i FROM texts),
  hits AS (SELECT id, i, len(form) AS n, phrase FROM spots JOIN forms ON q[i:i + len(form) - 1] = form AND NOT regexp_matches(q[i - 1:i - 1], '[\\p{{L}}\\p{{N}}]') AND NOT regexp_matches(q[i + len(form):i + len(form)], '[\\p{{L}}\\p{{N}}]')),
  own AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.id = h.id AND o.n > h.n AND o.i < h.i + h.n AND h.i < o.i + o.n)),
  firsts AS (SELECT id, phrase, min(i) AS i FROM own GROUP BY ALL), found AS (SELECT id, array_to_string(list_slice(list(phrase ORDER BY i), 1, 4), ',') AS entities FROM firsts GROUP BY id)"""


@query(f"""WITH {_SCORES_SQL}, texts AS (SELECT request_id AS id, q FROM low), {_ENTITY_SQL},
  usable AS (SELECT s.* REPLACE (CASE WHEN image_count < 2 THEN 0 ELSE change_analysis END AS change_analysis, CASE WHEN image_count < 2 THEN 0 ELSE optical_sar_fusion END AS optical_sar_fusion, CASE WHEN entities IS NULL THEN 0 ELSE grounding END AS grounding), entities FROM scored s LEFT JOIN found ON id = request_id),
  long AS (SELECT request_id, entities, unnest([{', '.join(f"{{'task': '{t}', 'score': {t}, 'k': {i}}}" for i, t in enumerate(L.TASKS))}]) AS t FROM usable),
  ranked AS (SELECT request_id, entities, t.task AS task, t.score AS score, row_number() OVER (PARTITION BY request_id ORDER BY t.score DESC, t.k) AS r FROM long),
  two AS (SELECT request_id, entities, max(CASE WHEN r = 1 THEN task END) AS task, max(CASE WHEN r = 1 THEN score END) AS s1, max(CASE WHEN r = 2 THEN score END) AS s2 FROM ranked GROUP BY ALL)
SELECT request_id, CASE WHEN s1 <= 0 THEN 'vqa' ELSE task END AS task, string_split(entities, ',')[1] AS target_entity, round(0.45 + 0.5 * greatest(0, least(1, (CASE WHEN s1 <= 0 THEN 1 ELSE s1 END - s2) / CASE WHEN s1 <= 0 THEN 1 ELSE s1 END)), 3)::DOUBLE AS confidence,
  CASE WHEN s1 > 0 AND task = 'grounding' THEN replace(entities, ',', '.,') || '.' END AS nouns FROM two""")
def intent_route(spark, sf_dir):
    routed = router.repair(router.route(_asked(spark, sf_dir)))
    return routed.select("request_id", "task", "target_entity", "confidence", F.array_join("search_nouns", ",").alias("nouns"))


@query(f"""WITH asked(request_id, query, input_mode, image_count) AS ({_ASKED_SQL}), texts AS (SELECT request_id AS id, regexp_replace(regexp_replace(lower(query), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS q FROM asked UNION ALL SELECT -p_partkey, lower(trim(p_name)) FROM part), {_ENTITY_SQL} SELECT id, coalesce(entities, '') AS entities FROM texts LEFT JOIN found USING (id)""")
def entity_extract(spark, sf_dir):
    asked = _asked(spark, sf_dir).select(F.col("request_id").cast("long").alias("id"), "query")
    named = table(spark, sf_dir, "part").select((-F.col("p_partkey")).alias("id"), F.col("p_name").alias("query"))
    return asked.unionByName(named).select("id", F.array_join(router.entities(F.col("query")), ",").alias("entities"))


_PLAN_SQL = "VALUES " + ", ".join(f"('{t}', {i + 1}, '{tool}')" for t, calls in L.PLANS.items() for i, (tool, _, _) in enumerate(calls))
_TOOLS_SQL = "VALUES " + ", ".join(f"('{k}', '{kind}', {str(a).lower()}, '{c}')" for k, kind, a, c in L.TOOLS)


@query(f"""WITH plan(task, step_order, tool) AS ({_PLAN_SQL}), tools(tool, kind, adapted, confidence_type) AS ({_TOOLS_SQL}), routed AS ({ORACLES['intent_route']})
SELECT request_id, step_order, tool, kind, confidence_type FROM routed JOIN plan USING (task) JOIN tools USING (tool)""")
def tool_plan(spark, sf_dir):
    steps = router.plan(router.repair(router.route(_asked(spark, sf_dir))))
    return steps.join(F.broadcast(router.tool_catalogue(spark).withColumnRenamed("tool", "key")), F.col("tool") == F.col("key")).select("request_id", "step_order", "tool", "kind", "confidence_type")  # nine tools


# ---- raster algebra ---------------------------------------------------------------------

_PX = "px AS (SELECT vec_id AS y, unnest(range(0, len(embedding))) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pixels_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query(f"WITH {_PX} SELECT count(*) AS n, round(sum(v), 6) AS total, CAST(max(y) + 1 AS BIGINT) AS h, CAST(max(x) + 1 AS BIGINT) AS w, count(*) FILTER (v > 0) AS above FROM px")
def grid_explode(spark, sf_dir):
    return _pixels(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"), (F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), F.count_if(F.col("v") > 0).alias("above"))


@query(f"""WITH {_PX}, q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM px) SELECT y, x, CAST(round_even(greatest(0, least(1, (v - lo) / (hi - lo))) * 255, 0) AS INT) AS v FROM px, q""")
def grid_stretch(spark, sf_dir):
    return G.stretch(_pixels(spark, sf_dir)).select("y", "x", "v")


@query(f"""WITH {_PX}, d AS (SELECT y, x, 10 * log10(greatest(abs(v), 1e-10)) AS v FROM px), q AS (SELECT quantile_cont(v, 0.01) AS p1, quantile_cont(v, 0.99) AS p99 FROM d)
SELECT y, x, '10log10' AS label, round(least(greatest(v, greatest(-30, p1 - 5)), least(5, p99 + 5)), 6) AS v FROM d, q""")
def grid_decibel(spark, sf_dir):
    return G.decibels(_pixels(spark, sf_dir).withColumn("v", F.abs("v"))).select("y", "x", "label", F.round("v", 6).alias("v"))


def _mean_sql(source: str, out: str, radius: int, value: str = "v") -> str:
    """Reflected box mean by a gather: every pixel with the offsets around it."""
    mirror = lambda a, n: f"CASE WHEN {a} < 0 THEN -({a}) WHEN {a} > {n} - 1 THEN 2 * ({n} - 1) - ({a}) ELSE {a} END"
    side = f"(SELECT unnest(range(-{radius}, {radius} + 1)) AS"
    return f"""{out}_h AS (SELECT p.y, p.x, sum(s.{value}) AS v FROM {source} p, {side} dx) d, {source} s, (SELECT max(x) + 1 AS n FROM {source}) w WHERE s.y = p.y AND s.x = {mirror('p.x + dx', 'w.n')} GROUP BY ALL),
  {out} AS (SELECT p.y, p.x, sum(s.v) / {(2 * radius + 1) ** 2}.0 AS v FROM {out}_h p, {side} dy) d, {out}_h s, (SELECT max(y) + 1 AS n FROM {source}) w WHERE s.x = p.x AND s.y = {mirror('p.y + dy', 'w.n')} GROUP BY ALL)"""


@query(f"WITH {_PX}, {_mean_sql('px', 'bm', 2)} SELECT y, x, round(v, 6) AS v FROM bm")
def grid_box_mean(spark, sf_dir):
    return G.box_means(_pixels(spark, sf_dir), 2).select("y", "x", F.round("v", 6).alias("v"))


@query(f"""WITH {_PX.replace('unnest(embedding)::DOUBLE', 'abs(unnest(embedding)::DOUBLE)')}, sq AS (SELECT y, x, v * v AS v FROM px), {_mean_sql('px', 'bm', 2)}, {_mean_sql('sq', 'bs', 2)},
  j AS (SELECT px.y, px.x, px.v, bm.v AS m, greatest(bs.v - bm.v * bm.v, 0) / greatest(bm.v * bm.v, 1e-10) AS ci2 FROM px JOIN bm USING (y, x) JOIN bs USING (y, x))
SELECT y, x, round(m + greatest(0, least(1, 1 - 0.523 * 0.523 / greatest(ci2, 1e-10))) * (v - m), 6) AS v FROM j""")
def grid_lee(spark, sf_dir):
    return G.lee(_pixels(spark, sf_dir).withColumn("v", F.abs("v"))).select("y", "x", F.round("v", 6).alias("v"))


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings), q AS (SELECT quantile_cont(v, 0.25) FILTER (label % 2 = 0) AS r1, quantile_cont(v, 0.75) FILTER (label % 2 = 0) AS r3, quantile_cont(v, 0.25) FILTER (label % 2 = 1) AS t1, quantile_cont(v, 0.75) FILTER (label % 2 = 1) AS t3 FROM v)
SELECT round((r3 - r1) / (t3 - t1), 5) AS gain, round(r1 - (r3 - r1) / (t3 - t1) * t1, 3) AS "offset" FROM q""")
def grid_radiometric_fit(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    side = lambda k: G.pixels_of(rows.where(F.col("label") % 2 == k), "vec_id", "embedding")
    return G.rounded_fit(G.radiometric_fit(side(0), side(1))).select("gain", "offset")


_MAG = f"""{_PX}, hgt AS (SELECT max(y) + 1 AS h FROM px), df AS (SELECT a.y, a.x, greatest(0, least(1, abs(a.v - b.v))) AS v FROM px a JOIN hgt ON true JOIN px b ON b.x = a.x AND b.y = (a.y + 1) % h), {_mean_sql('df', 'mag', 1)}"""


def _magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _pixels(spark, sf_dir)
    height = first.agg((F.max("y") + 1).alias("h"))
    second = first.join(height).select("scene", "band", F.pmod(F.col("y") - 1, F.col("h")).alias("y"), "x", "v")  # one row
    return G.change_magnitude(first, second, full_scale=1.0)


@query(f"WITH {_MAG} SELECT y, x, round(v, 6) AS v FROM mag")
def grid_change_magnitude(spark, sf_dir):
    return _magnitude(spark, sf_dir).select("y", "x", F.round("v", 6).alias("v"))


_OTSU = """hist AS (SELECT CAST(least(floor(v * 256), 255) AS BIGINT) AS bin, count(*) AS n FROM {0} WHERE v >= 0 AND v <= 1 GROUP BY 1),
  cum AS (SELECT bin, n, (bin + 0.5) / 256.0 AS c, sum(n) OVER w / sum(n) OVER () AS om, sum(n * (bin + 0.5) / 256.0) OVER w / sum(n) OVER () AS mu, sum(n * (bin + 0.5) / 256.0) OVER () / sum(n) OVER () AS mt, sum(n) OVER () AS total FROM hist WINDOW w AS (ORDER BY bin ROWS UNBOUNDED PRECEDING)),
  var AS (SELECT *, round(CASE WHEN om * (1 - om) > 1e-15 THEN power(mt * om - mu, 2) / (om * (1 - om)) ELSE 0 END, 12) AS sb FROM cum),
  ots AS (SELECT arg_max(c, (sb, -bin)) AS threshold, max(sb) / sum(n * power(c - mt, 2) / total) AS separability FROM var)"""


@query(f"WITH {_MAG}, {_OTSU.format('mag')} SELECT round(threshold, 6)::DOUBLE AS threshold, round(separability, 6) AS separability FROM ots")
def otsu_threshold(spark, sf_dir):
    return G.otsu(_magnitude(spark, sf_dir)).select(F.round("threshold", 6).alias("threshold"), F.round("separability", 6).alias("separability"))


_MASK = f"{_PX}, cut AS (SELECT quantile_cont(v, 0.9) AS t FROM px), mask AS (SELECT y, x, v >= t AS b FROM px, cut)"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.with_percentiles(_pixels(spark, sf_dir), (0.9,), ("t",)).select("scene", "band", "y", "x", (F.col("v") >= F.col("t")).alias("on"))


def _spread_sql(source: str, out: str, pick: str, radius: int) -> str:
    frame = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"{out}_h AS (SELECT y, x, {pick}(b) OVER (PARTITION BY y ORDER BY x {frame}) AS b FROM {source}), {out} AS (SELECT y, x, {pick}(b) OVER (PARTITION BY x ORDER BY y {frame}) AS b FROM {out}_h)"


@query(f"""WITH {_MASK}, {_spread_sql('mask', 'e1', 'min', 1)}, {_spread_sql('e1', 'o1', 'max', 1)}, {_spread_sql('mask', 'd1', 'max', 1)}, {_spread_sql('d1', 'c1', 'min', 1)}
SELECT mask.y, mask.x, mask.b AS "on", o1.b AS opened, c1.b AS closed FROM mask JOIN o1 USING (y, x) JOIN c1 USING (y, x)""")
def grid_open_close(spark, sf_dir):
    out = G.morphology(_mask(spark, sf_dir), {"opened": (("erode", 1), ("dilate", 1)), "closed": (("dilate", 1), ("erode", 1))}, ["on"])
    return out.select("y", "x", "on", "opened", "closed")


_CELLS = f"""{_MASK}, dim AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w, greatest(1, CAST(ceil(greatest(max(y) + 1, max(x) + 1) / 256.0) AS BIGINT)) AS s FROM px),
  cells AS (SELECT DISTINCT CAST(floor(y / s) AS BIGINT) AS cy, CAST(floor(x / s) AS BIGINT) AS cx FROM mask, dim WHERE b AND floor(y / s) < floor(h / s) AND floor(x / s) < floor(w / s)),
  walk AS (SELECT cy, cx, cy * 1000000 + cx AS label FROM cells UNION SELECT c.cy, c.cx, least(w.label, c.cy * 1000000 + c.cx) FROM walk w JOIN cells c ON abs(c.cy - w.cy) + abs(c.cx - w.cx) = 1),
  labelled AS (SELECT cy, cx, min(label) AS label FROM walk GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {_CELLS}, reg AS (SELECT label, min(cx) * s AS x0, min(cy) * s AS y0, least((max(cx) + 1) * s, w) AS x1, least((max(cy) + 1) * s, h) AS y1, count(*) AS cells, floor(avg(cx) * s) AS mx, floor(avg(cy) * s) AS my, h, w FROM labelled, dim GROUP BY label, s, h, w),
  area AS (SELECT reg.*, (SELECT count(*) FROM mask WHERE b AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS area_px FROM reg)
SELECT CAST(x0 AS BIGINT) AS x0, CAST(y0 AS BIGINT) AS y0, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, cells, area_px, CAST(k AS INT) AS rank, direction FROM (SELECT *, row_number() OVER (ORDER BY area_px DESC, y0, x0, y1, x1) AS k,
  CASE WHEN v = '' AND e = '' THEN 'centre' WHEN v = '' THEN e WHEN e = '' THEN v ELSE v || ' ' || e END AS direction FROM (SELECT *, CASE WHEN mx * 3.0 < w THEN 'western' WHEN mx * 3.0 < 2 * w THEN '' ELSE 'eastern' END AS e, CASE WHEN my * 3.0 < h THEN 'northern' WHEN my * 3.0 < 2 * h THEN '' ELSE 'southern' END AS v FROM area)
  WHERE area_px / (h * w) >= 0.0005) WHERE k <= 8""")
def grid_components(spark, sf_dir):
    return G.regions(_mask(spark, sf_dir)).select("x0", "y0", "x1", "y1", "cells", "area_px", "rank", "direction")


_SHIFTED = "opt AS (SELECT CASE WHEN y = 0 THEN h - 1 ELSE y - 1 END AS y, x, v FROM px, (SELECT max(y) + 1 AS h FROM px))"


@query(f"""WITH {_PX}, {_SHIFTED}, {_mean_sql('px', 'g', 1)}, gs AS (SELECT y, x, v * v AS v FROM g), {_mean_sql('g', 'gm', 2)}, {_mean_sql('gs', 'g2', 2)}, t AS (SELECT gm.y, gm.x, sqrt(greatest(g2.v - gm.v * gm.v, 0)) AS v FROM gm JOIN g2 USING (y, x)),
  j AS (SELECT g.y, g.x, g.v AS v, t.v AS t, opt.v AS o FROM g JOIN t USING (y, x) JOIN opt USING (y, x)), q AS (SELECT quantile_cont(v, 0.15) AS w, quantile_cont(v, 0.9) AS b, quantile_cont(t, 0.55) AS r, quantile_cont(o, 0.6) AS l FROM j)
SELECT round(avg(CASE WHEN v <= w AND o <= l THEN 1.0 ELSE 0 END), 4) AS water_fraction, round(avg(CASE WHEN v >= b AND t >= r THEN 1.0 ELSE 0 END), 4) AS built_up_fraction, count(*) FILTER (v <= w AND o > l) AS rejected FROM j, q""")
def sar_classes(spark, sf_dir):
    sar = _pixels(spark, sf_dir)
    height = sar.agg((F.max("y") + 1).alias("h"))
    optical = sar.join(height).select("scene", "band", F.pmod(F.col("y") - 1, F.col("h")).alias("y"), "x", "v")  # one row
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    return G.sar_classes(optical, sar).agg(share("water").alias("water_fraction"), share("built_up").alias("built_up_fraction"), F.count_if("rejected").alias("rejected"))


# ---- reports, caches, extensions ------------------------------------------------------------


@query("SELECT page_id, replace(replace(replace(regexp_extract(html, '<title>([^<]*)', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title FROM pages")
def html_escape_report(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape(F.regexp_extract("html", r"<title>([^<]*)", 1)).alias("title"))


@query("""WITH keyed AS (SELECT doc_id, sha256(text || 'describe' || lang) AS key FROM documents), cache AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE doc_id < (SELECT max(doc_id) // 2 FROM documents) GROUP BY key)
SELECT cache.key IS NOT NULL AS cache_hit, count(*) AS n FROM keyed LEFT JOIN cache USING (key) GROUP BY 1""")
def cache_join(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", T.cache_key(F.col("text"), F.lit("describe"), F.col("lang")).alias("key"))
    half = keyed.agg(F.floor(F.max("doc_id") / 2).alias("half"))
    cache = keyed.join(half).where("doc_id < half").groupBy("key").agg(F.min("doc_id").alias("first_doc"))  # one row
    return keyed.join(cache, "key", "left").groupBy(F.col("first_doc").isNotNull().alias("cache_hit")).agg(F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def orders_nation_revenue(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))
    joined = per_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR)[1:10] AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return days.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS f FROM events), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL""")
def events_session(spark, sf_dir):
    sessions = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return sessions.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


# ---- single functions and smaller operators -------------------------------------------------


@query("SELECT user_id, round(exp(avg(ln(greatest(value / 100, 1e-12)))), 6) AS likelihood FROM events GROUP BY 1")
def sequence_likelihood(spark, sf_dir):
    tokens = table(spark, sf_dir, "events").select("user_id", (F.col("value") / 100).alias("p"))
    return E.sequence_likelihood(tokens, "user_id", "p").withColumn("likelihood", F.round("likelihood", 6))


@query("SELECT o_orderkey FROM orders ORDER BY md5('21|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100")
def seeded_sample(spark, sf_dir):
    return R.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 100, seed=21)


@query("SELECT doc_id, left(sha256(text), 16) || '.txt' AS stored_as FROM documents")
def upload_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.upload_name(F.col("text"), F.lit(".TXT")).alias("stored_as"))


@query("SELECT item_id, 'data:text/plain;base64,' || to_base64(encode(text)) AS uri FROM benchmark")
def data_uris(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(T.data_uri(F.encode("text", "UTF-8"), "text/plain"), r"[\r\n]", "").alias("uri"))


@query(r"SELECT page_id, list_transform(list_slice(regexp_extract_all(url, '-?\d+(?:\.\d+)?'), 1, 4), lambda x: CAST(x AS DOUBLE)) AS numbers FROM pages")
def number_extraction(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.numbers(F.col("url")).alias("numbers"))


_NAMES = "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'd/S1A_IW_GRD.tif' WHEN 1 THEN 'd\\S2B_MSI.tif' WHEN 2 THEN 'scene_vv.tif' ELSE 'plain.tif' END AS name, CASE WHEN p_size < 25 THEN 'float32' ELSE 'uint16' END AS dtype, 1 + p_size % 4 AS bands FROM part"


def _contains_sql(hints: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(b, '{h}')" for h in hints) + ")"


@query(f"""WITH n AS ({_NAMES}), k AS (SELECT *, lower(regexp_extract(replace(name, chr(92), '/'), '([^/]*)$', 1)) AS b FROM n)
SELECT p_partkey, CASE WHEN {_contains_sql(T.SAR_HINTS)} THEN 'sar' WHEN {_contains_sql(T.OPTICAL_HINTS)} THEN 'optical' WHEN bands = 1 AND dtype IN ('float32', 'float64') THEN 'sar' WHEN bands >= 3 THEN 'optical' ELSE 'unknown' END AS modality FROM k""")
def modality_inference(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("_named_parts")
    named = spark.sql(_NAMES.replace("FROM part", "FROM _named_parts").replace("\\", "\\\\"))
    return named.select("p_partkey", T.modality(F.col("name"), F.col("dtype"), F.col("bands")).alias("modality"))


@query("WITH " + _balance_sql("SELECT event_id AS id, event_type AS type, CASE WHEN value < 30 THEN 'yes' ELSE 'no' END AS answer FROM events", "type", "greatest(0.3, 1.0 / answers)", "answers > 8"))
def balance_per_template(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id as id", "event_type as type", "case when value < 30 then 'yes' else 'no' end as answer")
    return R.balance(rows, F.col("answer"), ["id"], 0.3, ["type"], floor_by_count=True, max_answers=8).select("type", "answer", "id")


_DETECTED = "l_orderkey, l_partkey % 60 AS x0, l_suppkey % 50 AS y0, l_partkey % 60 + l_quantity AS x1, l_suppkey % 50 + l_linenumber * 10 - 10 AS y1, 100 AS w, 80 AS h, l_discount * 10 AS score"


@query(f"""WITH d AS (SELECT {_DETECTED} FROM lineitem), a AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) / (w * h) AS f FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, y0, x0, y1, x1) AS k FROM a WHERE score >= 0.25 AND f > 0 AND f <= 0.92)
SELECT l_orderkey, CAST(k AS INT) AS rank, round(score, 6) AS score, round(f, 6) AS area_fraction FROM r WHERE k <= 8""")
def detections_kept(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").selectExpr(*[e.replace(" AS ", " as ") for e in _DETECTED.split(", ")])
    return imagery.kept_detections(found, "l_orderkey").select("l_orderkey", "rank", F.round("score", 6).alias("score"), F.round("area_fraction", 6).alias("area_fraction"))


@query(f"""WITH b AS (SELECT l_orderkey, l_linenumber, {_GOLD} FROM lineitem) SELECT l_orderkey, l_linenumber, round(10 + x0 * 0.01, 6)::DOUBLE AS lon0, round(50 - y0 * 0.01, 6)::DOUBLE AS lat0, round(10 + x1 * 0.01, 6)::DOUBLE AS lon1, round(50 - y1 * 0.01, 6)::DOUBLE AS lat1 FROM b""")
def pixel_rings(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", *[e.replace(" AS ", " as ") for e in _GOLD.split(", ")])
    ring = B.lonlat_ring(tuple(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")), F.lit(10.0), F.lit(50.0), F.lit(0.01), F.lit(0.01))
    at = lambda i, j: F.round(ring[i][j], 6)
    return boxes.select("l_orderkey", "l_linenumber", at(0, 0).alias("lon0"), at(0, 1).alias("lat0"), at(2, 0).alias("lon1"), at(2, 1).alias("lat1"))


@query(f"""WITH {_PAIRS}, rows AS (SELECT 'vqa' AS kind, CAST(conv_id AS VARCHAR) AS key, question, answer FROM pairs WHERE question <> '' UNION ALL SELECT 'caption', CAST(item_id AS VARCHAR), NULL, text FROM benchmark)
SELECT kind, count(*) AS n, count(question) AS asked, count(*) FILTER (len(string_split_regex(regexp_replace(answer, '^\\s+|\\s+$', '', 'g'), '\\s+')) <= 40) AS kept FROM rows GROUP BY 1""")
def task_records(spark, sf_dir):
    vqa = _pairs(spark, sf_dir).select(F.col("conv_id").cast("string").alias("key"), "question", "answer")
    captions = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.col("text").alias("answer"))
    size = F.size(T.words(F.col("answer")))
    return imagery.task_records(vqa=vqa, caption=captions).groupBy("kind").agg(F.count("*").alias("n"), F.count("question").alias("asked"), F.count_if((size > 0) & (size <= 40)).alias("kept"))


from . import catalog_files, catalog_more, catalog_rasters, catalog_runs, catalog_tiles  # noqa: E402, F401  they register their queries here
