"""Queries over builds, scores, requests and reports that ``catalog`` doesn't hold, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _ASKED_SQL, _GOLD, _PAIRS, _SCENES, ORACLES, _asked, _split_sql, query, table
from .functions import boxes as B
from .functions import lexicon as L
from .functions import text as T
from .operators import evaluation as E
from .operators import records as R
from .operators import router, scenes
from .plans import datasets
from .sources import sinks

# ---- builders --------------------------------------------------------------------------------

_TURNS = """SELECT user_id AS conv_id, event_id AS turn, CASE event_id % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'gpt' WHEN 2 THEN 'user' ELSE 'assistant' END AS role,
  CASE WHEN event_id % 2 = 0 THEN '<image> find ' || event_type WHEN event_id % 3 = 0 THEN '{<' || user_id % 90 || '><' || event_id % 90 || '><30.5><-4>}' WHEN event_id % 5 = 0 THEN '<1><2>' ELSE 'none, 1 2 3 4' END AS text FROM events"""
_BOXES = f"WITH turns AS ({_TURNS}), {_PAIRS.replace('FROM conversations', 'FROM turns')}, b AS (SELECT conv_id, question AS phrase, list_transform(list_slice(regexp_extract_all(answer, '-?\\d+(?:\\.\\d+)?'), 1, 4), lambda x: CAST(x AS DOUBLE)) AS n FROM pairs WHERE question <> '' AND contains(answer, '<'))"


@query(f"{_BOXES} SELECT conv_id, phrase, n[1] AS x0, n[2] AS y0, n[3] AS x1, n[4] AS y1 FROM b WHERE len(n) = 4")
def box_pairs(spark, sf_dir):
    e = F.col("event_id")
    role = F.element_at(F.array(*map(F.lit, ("human", "gpt", "user", "assistant"))), (1 + e % 4).cast("int"))
    boxed = F.concat(F.lit("{<"), F.col("user_id") % 90, F.lit("><"), e % 90, F.lit("><30.5><-4>}"))
    said = F.when(e % 2 == 0, F.concat(F.lit("<image> find "), F.col("event_type"))).when(e % 3 == 0, boxed).when(e % 5 == 0, "<1><2>").otherwise("none, 1 2 3 4")
    turns = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), e.alias("turn"), role.alias("role"), said.alias("text"))
    found = R.pair_boxes(turns, "conv_id", "turn", "role", "text")
    return found.select("conv_id", "phrase", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(f"WITH {_split_sql('documents', 'doc_id', 0.2, 13)} SELECT source FROM marked WHERE is_val INTERSECT SELECT source FROM marked WHERE NOT is_val")
def leakage_found(spark, sf_dir):
    """A split by document leaks sources: all that have documents on both sides."""
    marked = R.split_by_group(table(spark, sf_dir, "documents"), "doc_id", 0.2, seed=13)
    return R.leaked(marked.where("is_val"), marked.where("not is_val"), "source")


def _gate_sql(kind: str) -> str:
    f = R.FLOORS[kind]
    tests = f"[CASE WHEN records < {f['min_records']} THEN 'too_few_records' END, CASE WHEN g < {f['min_groups']} THEN 'too_few_groups' END, CASE WHEN answers < {f['min_answers']} THEN 'too_few_answers' END, CASE WHEN top > {f['max_top']} THEN 'dominant_answer' END]"
    return f"SELECT '{kind}' AS build, records, g AS \"groups\", answers, round(top, 6) AS top_answer_fraction, round(records / g, 6) AS records_per_group, array_to_string(list_filter({tests}, lambda p: p IS NOT NULL), ',') AS problems FROM s"


@query("WITH a AS (SELECT lower(o_orderpriority) AS a, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT CAST(sum(n) AS BIGINT) AS records, count(*) AS answers, max(n) / sum(n) AS top, (SELECT count(DISTINCT o_custkey) FROM orders) AS g FROM a) " + " UNION ALL ".join(map(_gate_sql, R.FLOORS)))
def build_gates(spark, sf_dir):
    stats = R.records_per_group(R.quality_stats(table(spark, sf_dir, "orders"), F.col("o_custkey"), F.col("o_orderpriority")))
    out = None
    for kind, floors in R.FLOORS.items():
        one = R.quality_problems(stats, **floors).withColumns({"build": F.lit(kind), "problems": F.array_join("problems", ",")})
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: F.round(c, 6) for c in ("top_answer_fraction", "records_per_group")})


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 = 0 THEN false WHEN event_id % 3 = 1 THEN true END = false, false)) WHERE k = 1")
def active_answers(spark, sf_dir):
    """Only a literal false excludes: a missing flag counts as active."""
    events = table(spark, sf_dir, "events").withColumn("active", F.when(F.col("event_id") % 3 == 0, False).when(F.col("event_id") % 3 == 1, True))
    asked = events.select(F.col("user_id").alias("asker")).distinct()
    joined = R.join_answers(asked, events, "asker", "user_id", [F.col("ts"), F.col("event_id")], active="active")
    return joined.where("event_id is not null").select("user_id", "event_id", "event_type")


_LABELS = "SELECT p_partkey, list_concat(string_split(lower(p_type), ' '), [['Inland waters', 'Urban fabric ', 'Mixed forest', 'Pastures', 'Beaches, dunes, sands', '7'][1 + p_partkey % 6], ['', 'Airports', 'Marine waters'][1 + p_partkey % 3]]) AS labels FROM part"
_TIDY = f"t AS (SELECT p_partkey, list_filter(list_transform(labels, lambda x: lower(trim(x))), lambda x: x <> '' AND NOT regexp_full_match(x, '-?\\d+')) AS l FROM ({_LABELS}))"


def _group_sql(name: str) -> str:
    return "(" + " OR ".join(f"contains(j, '{w}')" for w in L.GROUPS[name]) + f") AS \"{name}\""


def _template_sql() -> str:
    both, built, water, neither = (a.replace("'", "''") for a in L.JOINT_ANSWERS)
    made = {
        "kind": "CASE WHEN \"built-up\" THEN 'urban' ELSE 'rural' END", "groups": "CASE WHEN len(gs) > 0 THEN array_to_string(list_sort(gs), ', ') || '.' END", "labels": "CASE WHEN len(l) > 0 THEN array_to_string(list_slice(list_sort(list_distinct(l)), 1, 6), ', ') || '.' END",
        "joint": f"CASE WHEN len(gs) > 0 THEN CASE WHEN \"built-up\" AND \"water\" THEN '{both}' WHEN \"built-up\" THEN '{built}' WHEN \"water\" THEN '{water}' ELSE '{neither}' END END",
    }
    rows = [f"SELECT '{t}' AS template, '{q}' AS question, {made.get(told) or f'CASE WHEN {chr(34)}{told}{chr(34)} THEN {chr(39)}yes{chr(39)} ELSE {chr(39)}no{chr(39)} END'} AS answer FROM g" for t, q, told in L.LABEL_QUESTIONS]
    return " UNION ALL ".join(rows)


@query(f"""WITH {_TIDY}, f AS (SELECT *, {', '.join(map(_group_sql, L.GROUPS))} FROM (SELECT *, array_to_string(l, ' | ') AS j FROM t)),
  g AS (SELECT *, list_filter([{', '.join(f'CASE WHEN "{n}" THEN {chr(39)}{n}{chr(39)} END' for n in L.GROUPS)}], lambda x: x IS NOT NULL) AS gs FROM f)
SELECT template, question, answer, count(*) AS n FROM ({_template_sql()}) WHERE answer IS NOT NULL GROUP BY ALL""")
def label_questions(spark, sf_dir):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (1 + F.col("p_partkey") % n).cast("int"))
    more = F.array(pick(("Inland waters", "Urban fabric ", "Mixed forest", "Pastures", "Beaches, dunes, sands", "7"), 6), pick(("", "Airports", "Marine waters"), 3))
    patches = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.split(F.lower("p_type"), " "), more).alias("labels"))
    return datasets.label_questions(patches, "labels").groupBy("template", "question", "answer").agg(F.count("*").alias("n"))


# ---- scores -----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT CAST(toxic AS VARCHAR) AS p, CAST(quality AS VARCHAR) AS g, n_chars / 1000.0::DOUBLE AS latency, doc_id % 3 = 0 AS hit FROM labels JOIN documents USING (doc_id)), c AS (SELECT p, count(*) AS k FROM r GROUP BY p)
SELECT count(*) AS n, round(avg(CASE WHEN p = g THEN 1.0 ELSE 0.0 END), 6) AS exact_match, (SELECT p FROM c ORDER BY k DESC, p LIMIT 1) AS most_common_prediction, round(avg(latency), 6) AS mean_latency, count(*) FILTER (hit) AS cache_hits FROM r""")
def run_facts(spark, sf_dir):
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("toxic").cast("string").alias("said"), F.col("quality").cast("string").alias("gold"), (F.col("n_chars") / 1000.0).alias("latency"), (F.col("doc_id") % 3 == 0).alias("cache_hit"))
    out = E.text_metrics(E.text_rows(joined, F.col("said"), F.col("gold"), ["latency", "cache_hit"]))
    return out.select("n", F.round("exact_match", 6).alias("exact_match"), "most_common_prediction", F.round("mean_latency", 6).alias("mean_latency"), "cache_hits")


@query("SELECT o_orderstatus, string_agg(o_orderpriority || '=' || n, ',' ORDER BY o_orderpriority) AS backends FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def backend_counts(spark, sf_dir):
    counted = E.backend_counts(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority")
    shown = F.transform(F.map_entries("backends"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return counted.select("o_orderstatus", F.array_join(shown, ",").alias("backends"))


_TOKEN = "round_even(greatest(0, least(224, {})) / 224.0::DOUBLE * 1023, 0) * (224 / 1023.0::DOUBLE)"


@query(f"""WITH b AS (SELECT l_linestatus, l_linenumber, {_GOLD} FROM lineitem), p AS (SELECT *, {_TOKEN.format('least(x0 + 2, x1)')} AS a, {_TOKEN.format('y0')} AS b, {_TOKEN.format('greatest(x0 + 2, x1)')} AS c, {_TOKEN.format('y1 + l_linenumber')} AS d FROM b),
  i AS (SELECT *, least(x1, c) - greatest(x0, a) AS iw, least(y1, d) - greatest(y0, b) AS ih FROM p), s AS (SELECT l_linestatus, CASE WHEN l_linenumber = 3 THEN NULL WHEN iw > 0 AND ih > 0 THEN iw * ih / ((x1 - x0) * (y1 - y0) + (c - a) * (d - b) - iw * ih) ELSE 0 END AS iou FROM i)
SELECT l_linestatus, count(*) AS n, round(avg(coalesce(iou, 0)), 6) AS mean_iou, round(avg(CASE WHEN coalesce(iou, 0) >= 0.5 THEN 1.0 ELSE 0 END), 6) AS acc_50, round(avg(CASE WHEN coalesce(iou, 0) >= 0.25 THEN 1.0 ELSE 0 END), 6) AS acc_25,
  round(avg(CASE WHEN iou IS NULL THEN 1.0 ELSE 0 END), 6) AS no_box_decoded_rate, avg(coalesce(iou, 0)) < 0.1 AS collapsed FROM s GROUP BY 1""")
def decoded_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_linestatus", "l_linenumber", *[e.replace(" AS ", " as ") for e in _GOLD.split(", ")])
    gold = tuple(F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    tokens = B.encode_tokens((gold[0] + 2, gold[1], gold[2], gold[3] + F.col("l_linenumber")))
    said = F.when(F.col("l_linenumber") == 3, "no box at all").otherwise(F.concat(tokens, F.lit(" thing")))
    out = E.decoded_metrics(rows, ["l_linestatus"], said, gold)
    return out.select("l_linestatus", "n", *[F.round(c, 6).alias(c) for c in ("mean_iou", "acc_50", "acc_25", "no_box_decoded_rate")], "collapsed")


# ---- requests ----------------------------------------------------------------------------------

_VALID = f"""WITH co AS ({ORACLES['coregistration_status']}), s AS ({_SCENES}), r AS (SELECT s_suppkey, a_valid, CASE s_suppkey % 3 WHEN 0 THEN 'vqa' WHEN 1 THEN 'change_analysis' ELSE 'optical_sar_fusion' END AS task, s_suppkey % 6 % 4 AS given, status FROM s JOIN co USING (s_suppkey))
SELECT s_suppkey, CASE WHEN given = 0 THEN 'No image was supplied.' WHEN NOT a_valid THEN 'broken' WHEN task <> 'vqa' AND given < 2 THEN 'Task ''' || task || ''' needs two images; ' || given || ' supplied.' WHEN task <> 'vqa' AND status IN ('unreadable', 'no_overlap') THEN 'co-registration: ' || status END AS rejected FROM r"""


@query(_VALID)
def request_validation(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("_supplier_requests")
    c, pairs = F.col, spark.sql(_SCENES.replace("FROM supplier", "FROM _supplier_requests"))
    for name, kind in pairs.dtypes:
        if kind.startswith("decimal"):
            pairs = pairs.withColumn(name, c(name).cast("double"))
    pairs = scenes.coregister(pairs)
    image = lambda valid: F.struct(valid.alias("valid"), F.when(~valid, "broken").alias("error"))
    given = c("s_suppkey") % 6 % 4
    images = F.slice(F.array(image(c("a_valid")), image(c("b_valid")), image(c("b_valid"))), F.lit(1), given.cast("int"))
    task = F.element_at(F.array(F.lit("vqa"), F.lit("change_analysis"), F.lit("optical_sar_fusion")), (1 + c("s_suppkey") % 3).cast("int"))
    asked = pairs.select("s_suppkey", task.alias("task"), images.alias("images"), c("status").alias("coregistration"))
    return router.validated(asked).select("s_suppkey", "rejected")


def _fallback_sql(loaded: tuple[str, ...]) -> tuple[str, str]:
    adapter = " ".join(f"WHEN '{t}' THEN '{own if own in loaded else other}'" for t, (own, other, _) in L.FALLBACKS.items())
    warning = " ".join(f"WHEN '{t}' THEN '{told}'" for t, (own, _, told) in L.FALLBACKS.items() if own not in loaded)
    return f"CASE tool {adapter} ELSE tool END", f"coalesce(CASE tool {warning} END, '')"


@query(f"SELECT request_id, step_order, tool, {_fallback_sql(('ground', 'fusion'))[0]} AS adapter, {_fallback_sql(('ground', 'fusion'))[1]} AS warning FROM ({ORACLES['tool_plan']})")
def adapter_fallbacks(spark, sf_dir):
    steps = router.with_adapters(router.plan(router.repair(router.route(_asked(spark, sf_dir)))), ("ground", "fusion"))
    return steps.select("request_id", "step_order", "tool", "adapter", F.array_join("adapter_warnings", " ").alias("warning"))


@query("SELECT p_partkey, CASE WHEN b = 'VLM' OR (b IN ('auto', '') AND p_size % 2 = 0) THEN 'grounding_vlm' ELSE 'grounding' END AS tool FROM (SELECT *, ['VLM', 'detector', 'auto', ''][1 + p_partkey % 4] AS b FROM part)")
def grounding_dispatch(spark, sf_dir):
    asked = F.nullif(F.element_at(F.array(*map(F.lit, ("VLM", "detector", "auto", ""))), (1 + F.col("p_partkey") % 4).cast("int")), F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", router.grounding_tool(asked, F.col("p_size") % 2 == 0).alias("tool"))


_PURPOSES = "VALUES " + ", ".join(f"('{t}', {i + 1}, '{why}')" for t, calls in L.PLANS.items() for i, (_, why, _) in enumerate(calls))
_TRACED = f"""asked(request_id, query, input_mode, image_count) AS ({_ASKED_SQL}), routed AS ({ORACLES['intent_route']}), planned AS ({ORACLES['tool_plan']}), why(task, step_order, purpose) AS ({_PURPOSES}),
  steps AS (SELECT p.request_id, p.step_order, p.tool, r.task, CASE WHEN p.tool = 'grounding' THEN 'Localise: ' || replace(r.nouns, ',', ', ') ELSE w.purpose END AS purpose, p.tool = 'change_map' AS warned FROM planned p JOIN routed r USING (request_id) JOIN why w ON w.task = r.task AND w.step_order = p.step_order),
  traced AS (SELECT request_id, any_value(task) AS task, CASE WHEN count(*) > 1 THEN 'answer of ' || arg_max(tool, step_order) || CASE WHEN any_value(task) = 'change_analysis' THEN chr(10) || chr(10) || 'Spatial evidence: ' ELSE chr(10) || chr(10) END || 'answer of ' || arg_min(tool, step_order) ELSE 'answer of ' || any_value(tool) END AS answer,
    'executed' AS status, CASE WHEN bool_or(warned) THEN 'weak_separability' ELSE '' END AS warnings, CAST(count(*) AS INT) AS n_steps,
    '[' || string_agg('{{"step_order":' || step_order || ',"tool":"' || tool || '","purpose":"' || purpose || '","answer":"answer of ' || tool || '","confidence":0.5,"warnings":' || CASE WHEN warned THEN '["weak_separability","weak_separability"]' ELSE '[]' END || '}}', ',' ORDER BY step_order) || ']' AS trace FROM steps GROUP BY request_id)"""


@query(f"WITH {_TRACED} SELECT * FROM traced")
def execution_traces(spark, sf_dir):
    routed = router.repair(router.route(_asked(spark, sf_dir)))
    steps = router.plan(routed)
    warned = F.when(F.col("tool") == "change_map", F.array(F.lit("weak_separability"), F.lit("weak_separability"))).otherwise(F.array().cast("array<string>"))
    results = steps.select("request_id", "step_order", "tool", "purpose", F.concat(F.lit("answer of "), F.col("tool")).alias("answer"), F.lit(0.5).alias("confidence"), warned.alias("warnings"), F.lit(None).cast("string").alias("error"))
    return router.traces(routed, results, "request_id").select("request_id", "task", "answer", "status", F.array_join("warnings", ",").alias("warnings"), F.size("steps").alias("n_steps"), F.to_json("steps").alias("trace"))


def _escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""WITH {_TRACED} SELECT request_id, '<!doctype html><html><head><meta charset=''utf-8''><title>Request ' || request_id || '</title></head><body><h1>Request ' || request_id || '</h1><p>' || {_escaped('answer')} || '</p><table><tr><th>task</th><td>' || task || '</td></tr><tr><th>status</th><td>' || status
  || '</td></tr></table><h2>Steps</h2><ul><li>' || {_escaped('trace')} || '</li></ul><h2>Warnings</h2><ul>' || CASE WHEN warnings <> '' THEN '<li>' || warnings || '</li>' ELSE '' END || '</ul><h2>Images</h2><figure><img src=''data:image/png;base64,' || to_base64(encode(task)) || '''></figure><p>2024-01-02 03:04 UTC</p><pre>{{}}</pre></body></html>' AS html FROM traced""")
def html_reports(spark, sf_dir):
    traced = execution_traces(spark, sf_dir)
    fact = lambda name: F.struct(F.lit(name).alias("key"), F.col(name).alias("value"))
    image = F.regexp_replace(T.data_uri(F.encode("task", "UTF-8")), r"[\r\n]", "")
    page = sinks.html_report(
        F.concat(F.lit("Request "), F.col("request_id").cast("string")), F.col("answer"), F.array(fact("task"), fact("status")), F.array("trace"), F.filter(F.split("warnings", ","), lambda w: w != ""), F.lit("{}"),
        images=F.array(image), stamp=F.lit("2024-01-02 03:04:05").cast("timestamp"),
    )
    return traced.select("request_id", page.alias("html"))


@query(f"""WITH m AS ({ORACLES['box_metrics']}) SELECT 'grounding' AS task, '| l_linestatus | n | mean_iou | acc_50 |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS markdown FROM (SELECT '| ' || l_linestatus || ' | ' || n || ' | ' || mean_iou || ' | ' || acc_50 || ' |' AS line FROM m)""")
def markdown_report(spark, sf_dir):
    from .catalog import box_metrics

    return sinks.markdown_table(box_metrics(spark, sf_dir).withColumn("task", F.lit("grounding")), ["l_linestatus", "n", "mean_iou", "acc_50"], ["task"])
