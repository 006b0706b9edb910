"""Rule router: a question and its input configuration to a task, entities and a plan."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import lexicon as L
from .checkpoints import importable

BACKEND = "local-rules-v1"


def normalise_query(query: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(query), r"^\s+|\s+$", ""), r"\s+", " ")


def entity_pattern() -> str:
    """Longest form first; whole words only."""
    forms = sorted(L.ENTITIES, key=lambda k: (-len(k), k))
    return r"((?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, forms)) + r")(?![\p{L}\p{N}]))"


def entities(query: Column, limit: int = 4) -> Column:
    """Noun phrases in the order of appearance, without repeats."""
    table = F.create_map(*[F.lit(x) for pair in L.ENTITIES.items() for x in pair])
    found = F.regexp_extract_all(normalise_query(query), F.lit(entity_pattern().replace(r"\ ", " ").replace(r"\-", "-")), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, lambda k: F.element_at(table, k))), 1, limit)


def task_scores(query: Column, mode: Column) -> dict[str, Column]:
    """Sum of the cues' weights per task, with the mode's bonus; no cue at all counts for a question."""
    q = normalise_query(query)
    scores: dict[str, Column] = {}
    for task in L.TASKS:
        total = F.lit(0.0)
        for cue, weight in L.CUES[task].items():
            total = total + F.when(F.contains(q, F.lit(cue)), weight).otherwise(0.0)
        for name, (favoured, bonus) in L.MODE_BONUS.items():
            if favoured == task:
                total = total + F.when(mode == name, bonus).otherwise(0.0)
        scores[task] = total
    none = F.greatest(*scores.values()) == 0.0
    scores["vqa"] = F.when(none, 1.0).otherwise(scores["vqa"])
    return scores


def with_scores(requests: DataFrame, query: str = "query", mode: str = "input_mode") -> DataFrame:
    scores = task_scores(F.col(query), F.col(mode))
    return requests.select("*", *[s.alias(f"score_{t}") for t, s in scores.items()])


def route(requests: DataFrame, query: str = "query", mode: str = "input_mode", images: str = "image_count") -> DataFrame:
    """Adds task, target_entity, search_nouns, confidence, backend, notes.

    Pair tasks need two images, grounding needs an entity.  Ties go to the task listed
    first.  Repair: a pair task without its pair, or grounding without a noun, becomes a
    plain question, and the notes say so.
    """
    scored = with_scores(requests, query, mode).withColumn("_entities", entities(F.col(query)))
    usable = {t: F.col(f"score_{t}") for t in L.TASKS}
    for t in L.PAIR_TASKS:
        usable[t] = F.when(F.col(images) < 2, 0.0).otherwise(usable[t])
    usable["grounding"] = F.when(F.size("_entities") == 0, 0.0).otherwise(usable["grounding"])
    ranked = F.reverse(F.array_sort(F.array(*[F.struct(usable[t].alias("score"), F.lit(-i).alias("rank"), F.lit(t).alias("task")) for i, t in enumerate(L.TASKS)])))
    top = scored.withColumn("_ranked", ranked)
    first, second = F.col("_ranked")[0], F.col("_ranked")[1]
    blank = first["score"] <= 0
    best = F.when(blank, 1.0).otherwise(first["score"])
    margin = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (best - second["score"]) / best))
    chosen = F.when(blank, "vqa").otherwise(first["task"])
    routed = top.withColumns({"task": chosen, "target_entity": F.try_element_at("_entities", F.lit(1)), "confidence": F.round(0.45 + 0.5 * margin, 3), "backend": F.lit(BACKEND)})
    nouns = F.when(F.col("task") == "grounding", F.transform("_entities", lambda e: F.concat(e, F.lit("."))))
    return routed.withColumn("search_nouns", nouns).drop("_ranked", *[f"score_{t}" for t in L.TASKS])


def repair(routed: DataFrame, images: str = "image_count") -> DataFrame:
    """Reconcile an external classification with what was supplied; expects ``_entities`` of ``route``."""
    lone_pair = F.col("task").isin(*L.PAIR_TASKS) & (F.col(images) < 2)
    task1 = F.when(lone_pair, "vqa").otherwise(F.col("task"))
    no_noun = (task1 == "grounding") & (F.coalesce(F.size("search_nouns"), F.lit(0)) <= 0)
    derived = no_noun & (F.size("_entities") > 0)
    lost = no_noun & ~derived
    notes = F.filter(F.array(F.when(lone_pair, "downgraded to single-image VQA"), F.when(derived, "search_nouns derived locally from the query"), F.when(lost, "downgraded to VQA: no locatable entity")), lambda n: n.isNotNull())
    nouns = F.when(derived, F.transform("_entities", lambda e: F.concat(e, F.lit(".")))).otherwise(F.col("search_nouns"))
    target = F.when(derived, F.coalesce("target_entity", F.try_element_at("_entities", F.lit(1)))).otherwise(F.col("target_entity"))
    return routed.withColumns({"task": F.when(lost, "vqa").otherwise(task1), "search_nouns": nouns, "target_entity": target, "notes": notes}).drop("_entities")


def plan(routed: DataFrame) -> DataFrame:
    """A row per tool call: order, tool, purpose, parameters."""
    steps = F.create_map(*[x for task, calls in L.PLANS.items() for x in (F.lit(task), F.array(*[F.struct(F.lit(tool).alias("tool"), F.lit(why).alias("purpose"), F.lit(how).alias("parameters")) for tool, why, how in calls]))])
    rows = routed.select("*", F.posexplode(F.try_element_at(steps, F.col("task"))).alias("_at", "_step"))
    nouns = F.concat(F.lit("Localise: "), F.array_join("search_nouns", ", "))
    purpose = F.when(F.col("_step.tool") == "grounding", nouns).otherwise(F.col("_step.purpose"))
    return rows.select(*routed.columns, (F.col("_at") + 1).alias("step_order"), F.col("_step.tool").alias("tool"), purpose.alias("purpose"), F.col("_step.parameters").alias("parameters"))


def validated(routed: DataFrame, images: str = "images", status: str = "coregistration") -> DataFrame:
    """Adds ``rejected``: why a request can't run, or null.

    ``images`` is array<struct<valid boolean, error string>> of what was supplied; ``status`` is the
    outcome of ``scenes.coregister`` for its first two (null if there is no pair).
    """
    given = F.coalesce(F.size(images), F.lit(0))
    bad = F.try_element_at(F.filter(images, lambda i: ~F.coalesce(i["valid"], F.lit(False))), F.lit(1))
    pair = F.col("task").isin(*L.PAIR_TASKS)
    short = F.format_string("Task '%s' needs two images; %d supplied.", F.col("task"), given)
    why = (
        F.when(given <= 0, "No image was supplied.")
        .when(bad.isNotNull(), F.coalesce(bad["error"], F.lit("unreadable input")))
        .when(pair & (given < 2), short)
        .when(pair & F.col(status).isin("unreadable", "no_overlap"), F.concat(F.lit("co-registration: "), F.col(status)))
    )
    return routed.withColumn("rejected", why)


def with_adapters(steps: DataFrame, loaded: Sequence[str]) -> DataFrame:
    """Adds ``adapter`` and ``adapter_warnings``: a tool whose own adapter isn't loaded takes the one that stands in."""
    adapter, warning = F.col("tool"), F.lit(None).cast("string")
    for tool, (own, other, told) in L.FALLBACKS.items():
        adapter = F.when(F.col("tool") == tool, own if own in loaded else other).otherwise(adapter)
        warning = F.when((F.col("tool") == tool) & F.lit(own not in loaded), told).otherwise(warning)
    return steps.withColumns({"adapter": adapter, "adapter_warnings": F.filter(F.array(warning), lambda w: w.isNotNull())})


def grounding_tool(backend: Column, adapter_loaded: Column) -> Column:
    """Which of the two grounding tools runs: the adapted model if asked for or there, else the detector."""
    wanted = F.lower(F.coalesce(backend, F.lit("auto")))
    return F.when((wanted == "vlm") | ((wanted == "auto") & adapter_loaded), "grounding_vlm").otherwise("grounding")


def tool_catalogue(spark) -> DataFrame:
    return spark.createDataFrame(list(L.TOOLS), "tool string, kind string, remote_sensing_adapted boolean, confidence_type string")


def traces(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row a request: its steps in order, the merged answer (semantic step first), distinct warnings, status.

    ``results(key, step_order, tool, purpose, answer, confidence, warnings, error)``.
    """
    steps = results.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step_order", "tool", "purpose", "answer", "confidence", "warnings", "error"))).alias("steps"))
    joined = requests.join(steps, key, "left")
    last, first = F.element_at("steps", -1), F.element_at("steps", 1)
    label = F.when(F.col("task") == "change_analysis", "\n\nSpatial evidence: ").otherwise("\n\n")
    answer = F.when(F.size("steps") > 1, F.concat(last["answer"], label, first["answer"])).otherwise(last["answer"])
    status = F.when(F.col("steps").isNull(), "unsupported_query").when(F.exists("steps", lambda s: s["error"].isNotNull()), "executed_with_errors").otherwise("executed")
    warnings = F.array_distinct(F.flatten(F.transform("steps", lambda s: F.coalesce(s["warnings"], F.array().cast("array<string>")))))
    return joined.select("*", answer.alias("answer"), last["confidence"].alias("confidence_of_answer"), warnings.alias("warnings"), status.alias("status"))


class PlanSteps:
    """The table function ``plan_steps``: a request's tool calls in order, from SQL.

    ``SELECT r.*, s.* FROM routed r, LATERAL plan_steps(r.task, r.search_nouns) s`` gives the rows of ``plan``;
    of a whole table, ``plan_steps(TABLE(routed) PARTITION BY request_id)`` does with the request's id before them.
    """

    @staticmethod
    def analyze(first: AnalyzeArgument, nouns: AnalyzeArgument | None = None) -> AnalyzeResult:
        steps = StructType().add("step_order", IntegerType()).add("tool", StringType()).add("purpose", StringType()).add("parameters", StringType())
        if not first.isTable:
            if first.dataType != StringType():
                raise ValueError("plan_steps takes a task's name and its nouns, or a table")
            return AnalyzeResult(steps)
        names = first.dataType.fieldNames()
        if missing := {"request_id", "task", "search_nouns"} - set(names):
            raise ValueError(f"the table lacks {sorted(missing)}")
        return AnalyzeResult(StructType([first.dataType["request_id"], *steps.fields]))

    def eval(self, first: Row | str | None, nouns: list[str] | None = None) -> Iterator[tuple]:
        whole = isinstance(first, Row)
        task, nouns = (first["task"], first["search_nouns"]) if whole else (first, nouns)
        for n, (tool, why, how) in enumerate(L.PLANS.get(task, ()), 1):
            step = (n, tool, f"Localise: {', '.join(nouns)}" if tool == "grounding" and nouns is not None else None if tool == "grounding" else why, how)
            yield (first["request_id"], *step) if whole else step


def register_plans(spark: SparkSession) -> None:
    """Make ``plan_steps`` known to SQL."""
    importable(spark)
    spark.udtf.register("plan_steps", F.udtf(PlanSteps))
