"""Planned tool calls carried out as one plan: prompts, stand-in adapters, cache, predictor, evidence.

``execute`` takes the steps of ``router.plan`` and gives what ``router.traces`` merges.  Tools that
ask a model go through the predictor contract: a function of Arrow batches ``key, adapter, prompt,
image`` to ``key, answer, confidence``.  A call that was answered before is read from the cache,
equal calls are asked once, and only what is left reaches the predictor, in an order that
changes adapters rarely.  Tools that compute (maps, evidence, boxes) bring their own results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import router
from ..operators.checkpoints import importable, written
from ..operators.kernels import predict

ANSWERS = "key string, answer string, confidence double"


def prompts(query: str = "query", nouns: str = "search_nouns") -> Column:
    """What each model tool is asked; null for tools that compute."""
    asked = F.coalesce(F.col(query), F.lit(""))
    wanted = F.coalesce(F.col(nouns), F.array().cast("array<string>"))
    by_tool = {"vqa": T.vqa_prompt(asked), "caption": T.caption_prompt(), "change_vqa": T.change_prompt(asked), "optical_sar_vlm": T.fusion_prompt(asked), "fusion_vlm": T.fusion_prompt(asked), "grounding_vlm": T.detect_prompt(wanted)}
    out = F.lit(None).cast("string")
    for tool, prompt in by_tool.items():
        out = F.when(F.col("tool") == tool, prompt).otherwise(out)
    return out


def execute(
    steps: DataFrame, key: str, cache: DataFrame, evidence: DataFrame, predictor: Callable[[pa.RecordBatch], pa.RecordBatch], *, loaded: Sequence[str], image_key: str = "image_key", image: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(results, additions to the cache).

    ``steps``: rows of ``router.plan`` with ``image_key``, the digest of what the call looks at, and
    maybe the ``image`` itself.  ``cache(key, answer, confidence)`` is keyed by digests of image, prompt, adapter
    and parameters.  ``evidence(<key>, tool, answer, confidence)`` holds what computing tools found.
    A model tool none of whose adapters is loaded, and a computing one without a result, carry an ``error``.
    """
    importable(steps.sparkSession)
    adapted = router.with_adapters(steps, loaded).withColumn("prompt", prompts())
    there = F.col("adapter").isin(*loaded) if loaded else F.lit(False)
    digest = T.cache_key(F.coalesce(F.col(image_key), F.lit("")), F.col("prompt"), F.concat_ws("|", "tool", "adapter", "parameters"))
    shown = F.col(image) if image else F.lit(None).cast("binary")
    asked_for = F.when(F.col("prompt").isNotNull() & there, digest)
    calls = written(adapted.select(key, "step_order", "tool", "adapter", "purpose", "prompt", "adapter_warnings", asked_for.alias("call"), shown.alias("shown")), "calls")

    known = cache.select(F.col("key").alias("call"), "answer", "confidence")
    wanted = calls.where("call is not null").dropDuplicates(["call"]).join(known.select("call"), "call", "left_anti")
    asked = wanted.select(F.col("call").alias("key"), "adapter", "prompt", F.col("shown").alias("image")).repartition("key").sortWithinPartitions("adapter")
    answered = written(predict(asked, predictor, ANSWERS), "answers")

    told = known.withColumn("cache_hit", F.lit(True)).unionByName(answered.select(F.col("key").alias("call"), "answer", "confidence", F.lit(False).alias("cache_hit")))
    found = evidence.select(F.col(key).alias("_of"), F.col("tool").alias("_tool"), F.col("answer").alias("_answer"), F.col("confidence").alias("_confidence"))
    joined = calls.join(told, "call", "left").join(found, (F.col(key) == F.col("_of")) & (F.col("tool") == F.col("_tool")), "left")
    model = F.col("prompt").isNotNull()
    error = F.when(model & F.col("call").isNull(), F.concat(F.lit("no adapter for "), "tool")).when(model & F.col("answer").isNull(), "no answer").when(~model & F.col("_of").isNull(), F.concat(F.lit("no result of "), "tool"))
    results = joined.select(
        key, "step_order", "tool", "adapter", "purpose", "prompt", F.when(model, F.col("answer")).otherwise(F.col("_answer")).alias("answer"), F.when(model, F.col("confidence")).otherwise(F.col("_confidence")).alias("confidence"),
        F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), F.col("adapter_warnings").alias("warnings"), error.alias("error"),
    )
    return results, answered


def from_function(ask: Callable[[str, str, bytes | None], tuple[str, float]]) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """A predictor of a plain function of adapter, prompt and image."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [ask(a, p, i) for a, p, i in zip(*(batch.column(n).to_pylist() for n in (1, 2, 3)), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], names=["key", "answer", "confidence"])

    return run
