"""Queries over table functions, reference systems, sizes and sources, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _ASKED_SQL, _PLAN_SQL, _PX, _TOOLS_SQL, ORACLES, _asked, _pixels, query, table
from .operators import grid as G
from .functions import lexicon as L
from .functions import text as T
from .operators import router, scenes
from .plans import tools


@query(f"""WITH plan(task, step_order, tool) AS ({_PLAN_SQL}), tools(tool, kind, adapted, confidence_type) AS ({_TOOLS_SQL}), routed AS ({ORACLES['intent_route']})
SELECT request_id, step_order, tool, kind, confidence_type FROM routed JOIN plan USING (task) JOIN tools USING (tool)""")
def tool_plan_lateral(spark, sf_dir):
    """The plan of every request by a lateral join with a table function, from SQL alone."""
    router.register_plans(spark)
    router.repair(router.route(_asked(spark, sf_dir))).createOrReplaceTempView("_routed_requests")
    router.tool_catalogue(spark).createOrReplaceTempView("_tool_catalogue")
    return spark.sql("SELECT r.request_id, s.step_order, s.tool, t.kind, t.confidence_type FROM _routed_requests r, LATERAL plan_steps(r.task, r.search_nouns) s JOIN _tool_catalogue t ON t.tool = s.tool")


@query(f"""WITH plan(task, step_order, tool) AS ({_PLAN_SQL}), routed AS ({ORACLES['intent_route']}) SELECT request_id, step_order, tool FROM routed JOIN plan USING (task)""")
def tool_plan_table(spark, sf_dir):
    """The same, of a whole table that is dealt by request."""
    router.register_plans(spark)
    router.repair(router.route(_asked(spark, sf_dir))).createOrReplaceTempView("_routed_requests")
    return spark.sql("SELECT request_id, step_order, tool FROM plan_steps(TABLE(_routed_requests) PARTITION BY request_id)")


_R = 6378137.0


@query(f"""WITH s AS (SELECT s_suppkey, (s_suppkey % 60) * 2.0 + 10 AS lon, (s_suppkey % 40) * 1.5 - 30 AS lat, CASE s_suppkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.01 ELSE 0.2 END AS off FROM supplier),
  b AS (SELECT *, lon AS x0, lat AS y0, lon + 0.2 AS x1, lat + 0.2 AS y1, lon + off AS u0, lat AS v0, lon + off + 0.2 AS u1, lat + 0.2 AS v1 FROM s),
  i AS (SELECT *, greatest(0, least(x1, u1) - greatest(x0, u0)) * greatest(0, least(y1, v1) - greatest(y0, v0)) / 0.04 AS ov FROM b)
SELECT s_suppkey, CASE WHEN ov < 0.6 THEN 'no_overlap' WHEN off = 0 THEN 'identical_grid' ELSE 'resampling_required' END AS status, round(ov, 5) AS overlap, round(off * 1000, 3) AS dx_px FROM i""")
def coregistration_two_systems(spark, sf_dir):
    """Scenes in degrees against ones in web Mercator: the second's bounds are carried over."""
    key = F.col("s_suppkey")
    off = F.when(key % 3 == 0, 0.0).when(key % 3 == 1, 0.01).otherwise(0.2)
    here = table(spark, sf_dir, "supplier").select("s_suppkey", ((key % 60) * 2.0 + 10).alias("lon"), ((key % 40) * 1.5 - 30).alias("lat"), off.alias("off"))
    east = lambda lon: _R * F.radians(lon)
    north = lambda lat: _R * F.asinh(F.tan(F.radians(lat)))
    lon, lat = F.col("lon"), F.col("lat")
    columns = {"a_valid": F.lit(True), "b_valid": F.lit(True), "a_crs": F.lit("EPSG:4326"), "b_crs": F.lit("EPSG:3857"), "a_w": F.lit(200), "a_h": F.lit(200), "b_w": F.lit(200), "b_h": F.lit(200), "a_x0": lon, "a_y0": lat, "a_x1": lon + 0.2, "a_y1": lat + 0.2}
    columns |= {"b_x0": east(lon + F.col("off")), "b_y0": north(lat), "b_x1": east(lon + F.col("off") + 0.2), "b_y1": north(lat + 0.2), "a_rx": F.lit(0.001), "a_ry": F.lit(0.001), "b_rx": F.lit(0.001), "b_ry": F.lit(0.001)}
    return scenes.coregister(here.withColumns(columns)).select("s_suppkey", "status", F.round("overlap", 5).alias("overlap"), F.round("dx_px", 3).alias("dx_px"))


@query(f"""WITH {_PX}, dim AS (SELECT max(y) + 1 AS h FROM px), g AS (SELECT h, CAST(floor(h * 0.3) AS BIGINT) AS oh, 20 AS ow FROM dim),
  wx AS (SELECT o AS ox, i AS x, greatest(0, 1 - abs((i + 0.5 - (o + 0.5) * 3.2) / 3.2)) AS k FROM range(0, 20) a(o), range(0, 64) b(i)),
  wy AS (SELECT o AS oy, i AS y, greatest(0, 1 - abs((i + 0.5 - (o + 0.5) * h / oh) / (h / oh))) AS k FROM g, range(0, CAST((SELECT oh FROM g) AS BIGINT)) a(o), range(0, CAST((SELECT h FROM g) AS BIGINT)) b(i) WHERE abs((i + 0.5 - (o + 0.5) * h / oh) / (h / oh)) < 1),
  rows_ AS (SELECT px.y, ox, sum(k * v) / sum(k) AS v FROM px JOIN wx USING (x) WHERE k > 0 GROUP BY px.y, ox)
SELECT oy AS y, ox AS x, round(sum(k * v) / sum(k), 6) AS v FROM rows_ JOIN wy USING (y) WHERE k > 0 GROUP BY oy, ox""")
def grid_shrunk(spark, sf_dir):
    """A raster at three tenths of its height and 20 columns, each pixel the weighted mean of what it covers."""
    pixels = _pixels(spark, sf_dir)
    sizes = pixels.groupBy("scene").agg((F.max("y") + 1).alias("b_h"), (F.max("x") + 1).alias("b_w"))
    pairs = sizes.select("scene", F.floor(F.col("b_h") * 0.3).alias("a_h"), F.lit(20).alias("a_w"), "b_h", "b_w")
    return G.resize(pixels, pairs, whole=False).select("y", "x", F.round("v", 6).alias("v"))


#: The adapters that the query has, and the stand-in of each tool's own.
_LOADED = ("vqa", "fusion")
_ADAPTERS = "VALUES " + ", ".join(f"('{tool}', '{L.FALLBACKS[tool][0 if L.FALLBACKS[tool][0] in _LOADED else 1] if tool in L.FALLBACKS else tool}')" for tool, *_ in L.TOOLS)
_STEPS_SQL = "VALUES " + ", ".join(f"('{task}', {n}, '{tool}', '{how}')" for task, calls in L.PLANS.items() for n, (tool, _, how) in enumerate(calls, 1))


def _told(adapter: str, prompt: str, image: bytes | None) -> tuple[str, float]:
    return f"{adapter}:{len(prompt)}", len(prompt) % 7 / 10


@query(f"""WITH plan(task, step_order, tool, parameters) AS ({_STEPS_SQL}), adapters(tool, adapter) AS ({_ADAPTERS}), asked(request_id, query, input_mode, image_count) AS ({_ASKED_SQL}), routed AS ({ORACLES['intent_route']}),
  calls AS (SELECT request_id, step_order, tool, adapter, parameters, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS q FROM routed JOIN plan USING (task) JOIN adapters USING (tool) JOIN asked USING (request_id)),
  p AS (SELECT *, CASE tool WHEN 'vqa' THEN 'answer en ' || q WHEN 'caption' THEN 'caption en' WHEN 'change_vqa' THEN 'answer en {T.CHANGE_PREFIX}' || q WHEN 'optical_sar_vlm' THEN 'answer en {T.FUSION_PREFIX}' || q END AS prompt FROM calls),
  k AS (SELECT *, CASE WHEN prompt IS NOT NULL AND adapter IN ('vqa', 'fusion') THEN sha256(md5(CAST(request_id AS VARCHAR)) || prompt || tool || '|' || adapter || '|' || parameters) END AS call FROM p)
SELECT request_id, step_order, tool, adapter, prompt,
  CASE WHEN prompt IS NULL THEN CASE WHEN request_id % 2 = 0 THEN 'map' END WHEN call IS NULL THEN NULL WHEN left(call, 1) < '8' THEN 'told before' ELSE adapter || ':' || length(prompt) END AS answer,
  CASE WHEN prompt IS NULL THEN CASE WHEN request_id % 2 = 0 THEN 0.5 END WHEN call IS NULL THEN NULL WHEN left(call, 1) < '8' THEN 1.0 ELSE length(prompt) % 7 / 10 END::DOUBLE AS confidence, coalesce(left(call, 1) < '8', false) AS cache_hit,
  CASE WHEN prompt IS NULL AND request_id % 2 = 1 THEN 'no result of ' || tool WHEN prompt IS NOT NULL AND call IS NULL THEN 'no adapter for ' || tool END AS error FROM k""")
def tool_answers(spark, sf_dir):
    """All planned calls: half of them answered before, maps for every other request, the rest by the predictor."""
    steps = router.plan(router.repair(router.route(_asked(spark, sf_dir)))).withColumn("image_key", F.md5(F.col("request_id").cast("string")))
    keyed = router.with_adapters(steps, _LOADED).withColumn("prompt", tools.prompts())
    call = T.cache_key(F.col("image_key"), F.col("prompt"), F.concat_ws("|", "tool", "adapter", "parameters"))
    cache = keyed.where("prompt is not null").select(call.alias("key"), F.lit("told before").alias("answer"), F.lit(1.0).alias("confidence")).where("left(key, 1) < '8'").distinct()
    evidence = steps.where("request_id % 2 = 0").select("request_id", "tool", F.lit("map").alias("answer"), F.lit(0.5).alias("confidence"))
    results, _ = tools.execute(steps, "request_id", cache, evidence, tools.from_function(_told), loaded=_LOADED)
    return results.select("request_id", "step_order", "tool", "adapter", "prompt", "answer", "confidence", "cache_hit", "error")
