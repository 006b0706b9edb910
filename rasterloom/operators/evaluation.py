"""Scores of predictions against gold answers and boxes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T


def text_rows(rows: DataFrame, predicted: Column, gold: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Adds normalised answers, exact match and token F1."""
    p, g = T.normalise_answer(predicted), T.normalise_answer(gold)
    return rows.select(*keep, p.alias("p"), g.alias("g"), (p == g).cast("double").alias("em"), T.token_f1(predicted, gold).alias("f1"))


def text_metrics(scored: DataFrame) -> DataFrame:
    """One row: n, exact match, F1, distinct ratio, commonest prediction and its share, majority baseline, flags;
    mean latency and cache hits if ``scored`` has ``latency`` and ``cache_hit``."""
    facts = [F.avg("latency").alias("mean_latency")] if "latency" in scored.columns else []
    facts += [F.count_if("cache_hit").alias("cache_hits")] if "cache_hit" in scored.columns else []
    means = scored.agg(F.count("*").alias("n"), F.avg("em").alias("exact_match"), F.avg("f1").alias("token_f1"), *facts)
    counted = scored.groupBy("p").agg(F.count("*").alias("k"))
    said = counted.agg(F.count("*").alias("distinct_predictions"), F.max("k").alias("most_predicted"), F.min_by("p", F.struct(-F.col("k"), "p")).alias("most_common_prediction"))
    true = scored.groupBy("g").agg(F.count("*").alias("k")).agg(F.count("*").alias("distinct_gold"), F.max("k").alias("most_gold"))
    one = means.join(said).join(true)  # one row each
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("n")), F.lit(0.0))
    out = one.select(
        "n", "exact_match", "token_f1", share("distinct_predictions").alias("distinct_ratio"), share("most_predicted").alias("most_common_fraction"), share("most_gold").alias("majority_baseline"), share("distinct_gold").alias("gold_distinct_ratio"),
        "most_common_prediction", *[c for c in ("mean_latency", "cache_hits") if c in one.columns],
    )
    return out.withColumns({"collapsed": (F.col("distinct_ratio") < 0.10) | (F.col("most_common_fraction") > 0.60), "beats_majority_baseline": F.col("exact_match") > F.col("majority_baseline")})


def by_type(scored: DataFrame, kind: str) -> DataFrame:
    """n and exact match per type, and overall (type null), in one pass."""
    return scored.rollup(kind).agg(F.count("*").alias("n"), F.avg("em").alias("exact_match"))


def box_metrics(best: DataFrame, group: Sequence[str], iou: str = "iou") -> DataFrame:
    """Mean IoU, accuracy at 0.5 and 0.25, share without a detection, collapse."""
    value = F.coalesce(F.col(iou), F.lit(0.0))
    rate = lambda test: F.avg(test.cast("double"))
    out = best.groupBy(*group).agg(F.count("*").alias("n"), F.avg(value).alias("mean_iou"), rate(value >= 0.5).alias("acc_50"), rate(value >= 0.25).alias("acc_25"), rate(F.col(iou).isNull()).alias("no_detection_rate"))
    return out.withColumn("collapsed", F.col("mean_iou") < 0.10)


def sequence_likelihood(tokens: DataFrame, sequence: str, probability: str) -> DataFrame:
    return tokens.groupBy(sequence).agg(F.exp(F.avg(F.ln(F.greatest(F.col(probability), F.lit(1e-12))))).alias("likelihood"))


def backend_counts(rows: DataFrame, group: Sequence[str], backend: str) -> DataFrame:
    """group columns and ``backends``: how many samples each backend answered."""
    counts = rows.groupBy(*group, backend).agg(F.count("*").alias("_n"))
    return counts.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(backend, "_n")))).alias("backends"))


def decoded_metrics(rows: DataFrame, group: Sequence[str], said: Column, gold: tuple[Column, Column, Column, Column], size: int = 224) -> DataFrame:
    """Box metrics of answers in location tokens: the best of an answer's boxes counts; how many hold none."""
    best = F.array_max(F.transform(B.decode_tokens(said, size), lambda d: B.iou(gold, (d["x0"], d["y0"], d["x1"], d["y1"]))))
    return box_metrics(rows.withColumn("_iou", best), group, "_iou").withColumnRenamed("no_detection_rate", "no_box_decoded_rate")
