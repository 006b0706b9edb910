"""Dataset builds and benchmark runs as whole plans: raw records to splits and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as B
from ..functions import text as T
from ..functions.lexicon import GROUPS, JOINT_ANSWERS, LABEL_QUESTIONS
from ..operators import evaluation as E
from ..operators import records as R
from ..operators.checkpoints import checkpointed

# Field names that records may use, in order.  Fixed values.
IMAGE_KEYS = ("image", "image_id", "img", "image_path", "file_name", "filename", "imgname")
QUESTION_KEYS = ("question", "query", "instruction", "prompt", "text")
ANSWER_KEYS = ("answer", "ground_truth", "gt", "label", "response")
CAPTION_KEYS = ("caption", "description", "captions")
PHRASE_KEYS = ("question", "referring_sentence", "sentence", "phrase", "expression", "caption")
BOX_KEYS = ("bbox", "box", "boxes", "answer", "gt_box")
CAPTION_QUESTION = "Describe this image."


def _turns(records: DataFrame) -> DataFrame:
    """record_id, image_id and the turns of records with conversations."""
    talks = F.try_variant_get("record", "$.conversations", "array<variant>")
    exploded = records.where(F.size(talks) > 0).select("record_id", "image_id", F.posexplode(talks).alias("turn", "t"))
    text = F.when(F.schema_of_variant(F.try_variant_get("t", "$.value", "variant")) == "STRING", F.try_variant_get("t", "$.value", "string"))
    return exploded.select("record_id", "image_id", "turn", F.lower(F.coalesce(F.try_variant_get("t", "$.from", "string"), F.lit(""))).alias("role"), text.alias("value")).where("value is not null")


def with_image(records: DataFrame) -> DataFrame:
    """``records(record_id, record)`` with the image's base name; records without one are dropped."""
    return records.withColumn("image_id", T.basename(T.first_text(F.col("record"), IMAGE_KEYS))).where("image_id is not null")


def normalise(records: DataFrame) -> DataFrame:
    """record_id, image_id, question, answer of conversations, flat pairs and captions.

    A record with conversations is read as such even if they give nothing.
    """
    named = with_image(records)
    pairs = R.pair_turns(_turns(named).withColumn("id", F.struct("record_id", "image_id")), "id", "turn", "role", "value")
    talked = pairs.select("id.record_id", "id.image_id", "question", "answer")
    flat = named.where(F.coalesce(F.size(F.try_variant_get("record", "$.conversations", "array<variant>")), F.lit(0)) <= 0)
    rec = F.col("record")
    asked, said, caption = T.first_text(rec, QUESTION_KEYS), T.first_text(rec, ANSWER_KEYS), T.first_text(rec, CAPTION_KEYS)
    whole = asked.isNotNull() & said.isNotNull()
    rows = flat.select("record_id", "image_id", F.when(whole, T.clean_prompt(asked)).when(caption.isNotNull(), CAPTION_QUESTION).alias("question"), F.when(whole, said).otherwise(caption).alias("answer"))
    return talked.unionByName(rows.where("answer is not null and question is not null"))


def normalise_grounding(records: DataFrame) -> DataFrame:
    """record_id, image_id, phrase, bbox (four doubles): boxes in conversations, else flat ones."""
    named = with_image(records)
    talked = R.pair_boxes(_turns(named).withColumn("id", F.struct("record_id", "image_id")), "id", "turn", "role", "value").select("id.record_id", "id.image_id", "phrase", "bbox")

    def box(key: str) -> Column:
        listed = F.try_variant_get("record", f"$.{key}", "array<double>")
        text = F.when(F.schema_of_variant(F.try_variant_get("record", f"$.{key}", "variant")) == "STRING", F.try_variant_get("record", f"$.{key}", "string"))
        told = T.numbers(text)
        return F.when(F.size(listed) == 4, listed).when(F.size(told) == 4, told)

    rest = named.join(talked.select("record_id").distinct(), "record_id", "left_anti")
    flat = rest.select("record_id", "image_id", T.clean_prompt(T.first_text(F.col("record"), PHRASE_KEYS)).alias("phrase"), F.coalesce(*map(box, BOX_KEYS)).alias("bbox"))
    return talked.unionByName(flat.where("phrase is not null and bbox is not null"))


def with_convention(boxes: DataFrame) -> DataFrame:
    """Adds bbox_convention and bbox_divisor, told by the largest coordinate of all."""
    top = boxes.agg(F.max(F.array_max("bbox")).alias("_top"))
    name, divisor = B.convention(F.col("_top"))
    return boxes.join(top).withColumns({"bbox_convention": name, "bbox_divisor": divisor}).drop("_top")  # one row


@dataclass
class Build:
    """A built set: rows with ``is_val``, and its report of one row."""

    rows: DataFrame
    report: DataFrame


def build_questions(records: DataFrame, files: DataFrame, *, val_fraction: float = 0.1, top_answer: float = 0.35, max_records: int | None = None, max_missing: float = 0.10, seed: int = 0, check: bool = True, **limits) -> Build:
    """Normalise, find images, tag the task, cap, balance the short answers, gate and split by image.

    ``records(record_id, record)``, ``files(path)``.  Raises ``BuildError`` when too many
    images are missing, a placeholder text occurs, or a floor isn't met.
    """
    found = checkpointed(R.resolve_images(normalise(records), files, "image_id", "path"))
    reason = R.reasons([("image_file_missing", F.col("image").isNull()), ("placeholder", T.is_forbidden(F.col("question"), F.col("answer")))])
    marked = found.withColumn("reason", reason)
    if check:
        row = R.failure_fraction(marked, F.col("reason") == "image_file_missing").first()
        if row.fraction > max_missing:
            raise R.BuildError(f"image_file_missing: {row.failed} of {row.total}")
        if not marked.where("reason = 'placeholder'").isEmpty():
            raise R.BuildError("placeholder texts in the records")
    kept = marked.where("reason is null").drop("reason")
    key = ["image_id", "question", "answer"]
    if max_records is not None:
        kept = R.seeded_sample(kept, key, max_records, seed)
    tagged = kept.withColumn("task", F.when(T.is_caption(F.col("question"), F.col("answer")), "caption").otherwise("vqa"))
    balanced = R.balance(tagged.where("task = 'vqa'"), F.col("answer"), key, top_answer, seed=seed)
    rows = checkpointed(balanced.unionByName(tagged.where("task = 'caption'")))
    if check:
        R.assert_quality(rows, F.col("image_id"), F.col("answer"), max_top=top_answer, **limits)
    report = R.quality_stats(rows, F.col("image_id"), F.col("answer")).join(marked.agg(F.count("reason").alias("dropped")))  # one row each
    return Build(R.split_by_group(rows, "image_id", val_fraction, seed), report)


def with_groups(rows: DataFrame, labels: str) -> DataFrame:
    """Adds ``groups``: the land-cover groups whose keywords occur in the labels."""
    joined = F.array_join(T.labels_of(F.col(labels)), " | ")

    def present(words: tuple[str, ...]) -> Column:
        return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(joined, w))

    return rows.withColumn("groups", F.filter(F.array(*[F.when(present(words), name) for name, words in GROUPS.items()]), lambda g: g.isNotNull()))


def label_questions(rows: DataFrame, labels: str) -> DataFrame:
    """template, question, answer rows made from the labels of each patch.

    Seven fixed questions; the open ones only where there is something to answer.
    """
    grouped = with_groups(rows, labels)
    has = lambda g: F.array_contains("groups", g)
    water, built = has("water"), has("built-up")
    both, only_built, only_water, neither = map(F.lit, JOINT_ANSWERS)
    listed = lambda items: F.when(F.size(items) > 0, F.concat(F.array_join(items, ", "), F.lit(".")))
    open_ = {
        "kind": F.when(built, "urban").otherwise("rural"),
        "joint": F.when(F.size("groups") > 0, F.when(built & water, both).when(built, only_built).when(water, only_water).otherwise(neither)),
        "groups": listed(F.array_sort("groups")),
        "labels": listed(F.slice(F.array_sort(F.array_distinct(T.labels_of(F.col(labels)))), 1, 6)),
    }
    templates = [(t, q, open_[told] if told in open_ else F.when(has(told), "yes").otherwise("no")) for t, q, told in LABEL_QUESTIONS]
    made = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(q).alias("question"), a.alias("answer")) for t, q, a in templates])
    return grouped.select(*rows.columns, F.inline(made)).where("answer is not null")


def build_change(samples: DataFrame, *, cap: int = 8, top_answer: float = 0.35, val_fraction: float = 0.1, seed: int = 0, check: bool = False) -> Build:
    """Change questions from ``samples(key, first, second, annotation)``: content ids, caps, balance, split by pair.

    Pairs of equal content share an id; their rows stay.  ``check`` applies the change set's floors.
    """
    record = F.try_parse_json("annotation")
    talk = lambda i: F.try_variant_get(record, f"$.conversations[{i}].value", "string")
    rows = samples.select("key", T.content_id(F.col("first"), F.col("second")).alias("pair_id"), F.col("first").isNull().alias("no_first"), F.col("second").isNull().alias("no_second"), record.isNull().alias("no_json"), T.clean_prompt(talk(0)).alias("question"), T.strip(talk(1)).alias("answer"))
    reason = R.reasons([("image_missing", F.col("no_first") | F.col("no_second")), ("annotation_unreadable", F.col("no_json")), ("question_or_answer_missing", F.coalesce(F.col("question"), F.lit("")).eqNullSafe("") | F.coalesce(F.col("answer"), F.lit("")).eqNullSafe(""))])
    marked = checkpointed(rows.withColumn("reason", reason))
    kept = marked.where("reason is null").select("key", "pair_id", "question", "answer")
    capped = R.cap_per_group(kept, ["pair_id"], ["key", "question"], cap, seed)
    balanced = R.balance(capped, F.col("answer"), ["key", "question"], top_answer, seed=seed)
    prefixed = balanced.withColumns({"prefix": T.change_prompt(F.col("question")), "suffix": F.col("answer")})
    if check:
        R.assert_quality(prefixed, F.col("pair_id"), F.col("answer"), **R.FLOORS["change"])
    return Build(R.split_by_group(prefixed, "pair_id", val_fraction, seed), marked.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")))


def benchmark(gold: DataFrame, predictions: DataFrame, key: str, kind: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Text metrics of predictions joined to gold on the id, and the breakdown by type.

    ``gold(key, answer[, kind])``, ``predictions(key, prediction[, latency, cache_hit])``; a gold row
    without a prediction scores as an empty answer.  Serves questions, captions, changes and pairs.
    """
    joined = gold.join(predictions, key, "left").withColumn("prediction", F.coalesce("prediction", F.lit("")))
    facts = [c for c in ("latency", "cache_hit") if c in predictions.columns]
    scored = E.text_rows(joined, F.col("prediction"), F.col("answer"), [key, *([kind] if kind else []), *facts])
    return E.text_metrics(scored), E.by_type(scored, kind) if kind else None


def benchmark_boxes(gold: DataFrame, detections: DataFrame, key: str) -> DataFrame:
    """Box metrics of the best detection of each gold box, one row: and how many samples each backend answered.

    ``gold(key, x0, y0, x1, y1)``, ``detections(key, x0, y0, x1, y1, backend)``; samples without a
    detection count, with backend ``none``.
    """
    box = lambda t: tuple(F.col(f"{t}{c}").cast("double") for c in ("x0", "y0", "x1", "y1"))
    said = detections.select(key, "backend", *[F.col(c).alias(f"p{c}") for c in ("x0", "y0", "x1", "y1")])
    met = gold.select(key, *[F.col(c).alias(f"g{c}") for c in ("x0", "y0", "x1", "y1")]).join(said, key, "left")
    scored = met.withColumn("iou", F.when(F.col("px0").isNotNull(), B.iou(box("g"), box("p"))))
    best = scored.groupBy(key).agg(F.max("iou").alias("iou"), F.coalesce(F.min("backend"), F.lit("none")).alias("backend")).withColumn("task", F.lit("grounding"))
    return E.box_metrics(best, ["task"]).join(E.backend_counts(best, ["task"], "backend"), "task")  # one row each
