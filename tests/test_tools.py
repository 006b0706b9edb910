"""Planned calls carried out: prompts, stand-in adapters, cache, one call for equal ones, evidence, traces."""

from pyspark.sql import functions as F

from rasterloom.functions import text as T
from rasterloom.operators import router
from rasterloom.plans import tools


def _steps(spark):
    rows = [(1, "Is there water?", "vqa", None, "a"), (2, "Is there water?", "vqa", None, "a"), (3, "What changed?", "change_analysis", None, "b"), (4, "Find ships", "grounding", ["ship."], "c"), (5, "Use both", "optical_sar_fusion", None, "d"), (6, None, "caption", None, None)]
    routed = spark.createDataFrame(rows, "request_id int, query string, task string, search_nouns array<string>, image_key string").withColumn("confidence", F.lit(0.9))
    return routed, router.plan(routed)


def test_calls_are_carried_out(spark):
    _, steps = _steps(spark)
    asked = spark.sparkContext.accumulator(0)

    def ask(adapter, prompt, image):
        asked.add(1)
        return f"{adapter} says {len(prompt)}", 0.25

    known = T.cache_key(F.lit("b"), T.change_prompt(F.lit("What changed?")), F.lit('change_vqa|vqa|{"max_new_tokens":64}'))
    cache = spark.range(1).select(known.alias("key"), F.lit("a road").alias("answer"), F.lit(0.8).alias("confidence"))
    evidence = spark.createDataFrame([(3, "change_map", "4 % changed", 0.6), (4, "grounding", "2 boxes", 0.7)], "request_id int, tool string, answer string, confidence double")
    results, new = tools.execute(steps, "request_id", cache, evidence, tools.from_function(ask), loaded=("vqa",))
    got = {(r.request_id, r.tool): r for r in results.collect()}
    assert asked.value == new.count() == 2  # two equal questions are one call, one is known, the caption's adapter isn't loaded
    assert got[(1, "vqa")].answer == got[(2, "vqa")].answer == f"vqa says {len('answer en Is there water?')}"
    assert (got[(3, "change_vqa")].answer, got[(3, "change_vqa")].cache_hit, got[(3, "change_vqa")].adapter, len(got[(3, "change_vqa")].warnings)) == ("a road", True, "vqa", 1)
    assert (got[(3, "change_map")].answer, got[(4, "grounding")].answer, got[(5, "sar_evidence")].error) == ("4 % changed", "2 boxes", "no result of sar_evidence")
    assert got[(6, "caption")].error == "no adapter for caption" and got[(6, "caption")].answer is None
    # What was answered is known from then on.
    again, none = tools.execute(steps, "request_id", cache.unionByName(new), evidence, tools.from_function(ask), loaded=("vqa",))
    assert none.count() == 0 and again.where("error is null").count() == results.where("error is null").count() and again.where("cache_hit").count() == 4


def test_results_become_traces(spark):
    routed, steps = _steps(spark)
    evidence = spark.createDataFrame([(3, "change_map", "4 % changed", 0.6)], "request_id int, tool string, answer string, confidence double")
    results, _ = tools.execute(steps, "request_id", spark.createDataFrame([], tools.ANSWERS), evidence, tools.from_function(lambda a, p, i: ("yes", 0.5)), loaded=("vqa", "caption", "change", "fusion"))
    got = {r.request_id: r for r in router.traces(routed.select("request_id", "task"), results, "request_id").collect()}
    assert got[3].answer == "yes\n\nSpatial evidence: 4 % changed" and got[3].status == "executed"
    assert {i: r.status for i, r in got.items()} == {1: "executed", 2: "executed", 3: "executed", 4: "executed_with_errors", 5: "executed_with_errors", 6: "executed"}
    assert tools.execute(steps.limit(0), "request_id", spark.createDataFrame([], tools.ANSWERS), evidence, tools.from_function(lambda a, p, i: ("", 0.0)), loaded=())[0].count() == 0
