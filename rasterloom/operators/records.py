"""Record builders: pairing, joins with reasons, caps, balancing, splits and gates.

Plans only, but for the count of distinct keys in ``split_by_group``, the one-row aggregates of the
gates, and what balancing, sampling and splitting write once to read it several times: counts, a
cut per group, and the rows that may be kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .checkpoints import written


class BuildError(RuntimeError):
    """A gate was not passed; the message lists every problem."""


def seeded(seed: int, *keys: Column) -> Column:
    """A reproducible shuffle order: the MD5 of seed and keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


# ---- pairing -------------------------------------------------------------------------


def pair_turns(turns: DataFrame, key: str, order: str, role: str, value: str) -> DataFrame:
    """key, question_turn, answer_turn, question, answer: an answer takes the latest open question.

    Roles other than questioner and answerer, and blank values, don't count.  A question
    that is asked again before an answer is replaced by the newer one; an answer closes it.
    """
    asks, answers = F.lower(F.col(role)).isin("human", "user"), F.lower(F.col(role)).isin("gpt", "assistant", "model")
    used = turns.where((asks | answers) & (T.strip(F.col(value)) != ""))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    seen = used.select(
        F.col(key), F.col(order).alias("answer_turn"), answers.alias("is_answer"), T.strip(F.col(value)).alias("answer"),
        F.max(F.when(asks, F.struct(F.col(order).alias("at"), T.clean_prompt(F.col(value)).alias("said")))).over(before).alias("asked"),
        F.max(F.when(answers, F.col(order))).over(before).alias("last_answer"),
    )
    open_ = F.col("asked").isNotNull() & (F.col("last_answer").isNull() | (F.col("asked.at") > F.col("last_answer"))) & (F.col("asked.said") != "")
    return seen.where(F.col("is_answer") & open_).select(key, F.col("asked.at").alias("question_turn"), "answer_turn", F.col("asked.said").alias("question"), "answer")


def pair_boxes(turns: DataFrame, key: str, order: str, role: str, value: str) -> DataFrame:
    """key, phrase, bbox: the pairs whose answer holds ``<`` and at least four numbers."""
    pairs = pair_turns(turns, key, order, role, value)
    boxed = pairs.select(key, F.col("question").alias("phrase"), F.contains(F.col("answer"), F.lit("<")).alias("marked"), T.numbers(F.col("answer")).alias("bbox"))
    return boxed.where("marked and size(bbox) = 4").select(key, "phrase", "bbox")


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key (``setdefault`` semantics), combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ordered = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def reasons(rules: Sequence[tuple[str, Column]]) -> Column:
    """The first rule that holds names the reason; null for rows that are kept."""
    out = F.lit(None).cast("string")
    for name, holds in reversed(list(rules)):
        out = F.when(holds, name).otherwise(out)
    return out


def is_active(flag: Column) -> Column:
    """Only a literal false excludes."""
    return ~flag.eqNullSafe(F.lit(False))


def join_answers(questions: DataFrame, answers: DataFrame, question_key: str, answer_key: str, order: Sequence[Column], active: str | None = None) -> DataFrame:
    """Questions with the first active answer (all count without a flag); those without keep nulls, for ``reasons``."""
    usable = answers if active is None else answers.where(is_active(F.col(active)))
    firsts = first_per_key(usable, [answer_key], order)
    return questions.join(firsts, questions[question_key] == firsts[answer_key], "left")


def resolve_images(records: DataFrame, files: DataFrame, name: str, path: str, base: str | None = None) -> DataFrame:
    """Adds ``image``: the file with the record's base name, else one with its stem; least path wins.

    The base name is that of ``path``, or in the column ``base`` where it isn't its last part.
    """
    named = T.basename(F.col(path)) if base is None else F.col(base)
    exact = files.groupBy(named.alias("_base")).agg(F.min(path).alias("_exact"))
    loose = files.groupBy(T.stem(named).alias("_stem")).agg(F.min(path).alias("_loose"))
    keyed = records.withColumns({"_b": T.basename(F.col(name)), "_s": T.stem(F.col(name))})
    joined = keyed.join(exact, F.col("_b") == F.col("_base"), "left").join(loose, F.col("_s") == F.col("_stem"), "left")
    return joined.withColumn("image", F.coalesce("_exact", "_loose")).drop("_b", "_s", "_base", "_stem", "_exact", "_loose")


# ---- caps, balance, split ---------------------------------------------------------------


def cap_per_group(rows: DataFrame, group: Sequence[str], key: Sequence[str], cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows of a group, in seeded order (a top-k window: cut before the shuffle)."""
    ranked = Window.partitionBy(*group).orderBy(seeded(seed, *map(F.col, key)), *key)
    return rows.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= cap).drop("_n")


def balanced_caps(counts: DataFrame, fraction: float, scope: Sequence[str] = (), max_answers: int | None = None, floor_by_count: bool = False, min_answers: int = 1) -> DataFrame:
    """scope columns and ``cap``: the largest c with c <= max(1, floor(f * sum(min(n, c)))).

    ``counts(scope..., answer, n)``.  Between neighbouring sorted counts the sum is a line in
    c, so each segment has one candidate and the greatest that holds is the answer; a row per
    distinct count is all that is sorted.  Scopes with more than ``max_answers`` or fewer than
    ``min_answers`` answers are not capped; ``floor_by_count`` raises f to one over their number.
    """
    scope = list(scope)
    by_count = counts.groupBy(*scope, "n").agg(F.count("*").alias("same"))
    rising = Window.partitionBy(*scope).orderBy("n")
    whole = Window.partitionBy(*scope)
    facts = by_count.select(
        *scope, "n",
        F.sum(F.col("same") * F.col("n")).over(rising.rowsBetween(Window.unboundedPreceding, -1)).alias("below"),
        F.sum("same").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("above"),
        F.lag("n", 1, 0).over(rising).alias("low"), F.sum("same").over(whole).alias("answers"), F.max("n").over(whole).alias("most"),
    ).na.fill(0, ["below"])
    f = F.greatest(F.lit(fraction), 1.0 / F.col("answers")) if floor_by_count else F.lit(fraction)
    slack = 1.0 - f * F.col("above")
    best = F.when(slack <= 1e-12, F.col("n")).otherwise(F.least(F.col("n"), F.floor(f * F.col("below") / slack + 1e-9).cast("long")))
    total = lambda c: F.col("below") + c * F.col("above")
    around = F.filter(F.array(best + 1, best, best - 1), lambda c: (c > F.col("low")) & (c <= F.col("n")) & (c <= F.greatest(F.lit(1).cast("long"), F.floor(total(c) * f).cast("long"))))
    found = facts.select(*scope, "answers", "most", F.coalesce(F.array_max(around), F.lit(1).cast("long")).alias("cap"))
    out = found.groupBy(*scope).agg(F.max("cap").alias("cap"), F.max("answers").alias("answers"), F.max("most").alias("most"))
    free = F.col("answers") < min_answers
    if max_answers is not None:
        free = free | (F.col("answers") > max_answers)
    return out.select(*scope, F.when(free, F.col("most")).otherwise(F.col("cap")).alias("cap"))


def first_in_order(rows: DataFrame, by: Sequence[str], order: Column, key: Sequence[str], cap: Column, total: DataFrame) -> DataFrame:
    """The first ``cap`` rows of each group in the order of a hexadecimal digest, ties by ``key``.

    ``total(by..., cap, ...)`` has a row a group.  Digests fall evenly into 4096 bins, so counts per
    group and bin (combined before the shuffle) tell which bins are whole on one side; rows of the
    one bin that the cap cuts are all that is ranked, whatever a group holds.
    """
    binned = rows.withColumns({"_order": order, "_bin": F.conv(F.substring(order, 1, 3), 16, 10).cast("int")})
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c")).withColumn("_upto", F.sum("_c").over(upto))
    capped = counts.join(total, list(by)).withColumn("_cap", cap)
    over = F.col("_upto") > F.col("_cap")
    cut = capped.groupBy(*by).agg(F.min(F.when(over, F.col("_bin"))).alias("_cut"), F.max(F.when(~over, F.col("_upto"))).alias("_had"), F.max("_cap").alias("_cap"))
    cut = written(cut.select(*by, F.coalesce("_cut", F.lit(4096)).alias("_cut"), (F.col("_cap") - F.coalesce("_had", F.lit(0))).alias("_left")), "cut")
    # What may be kept is written once: whole bins and the bin that is cut are read from there.
    near = written(binned.join(cut, list(by)).where(F.col("_bin") <= F.col("_cut")), "near")
    ranked = near.where(F.col("_bin") == F.col("_cut")).withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_order", *key)))
    edge = ranked.where(F.col("_n") <= F.col("_left")).drop("_n")
    return near.where(F.col("_bin") < F.col("_cut")).unionByName(edge).drop("_order", "_bin", "_cut", "_left")


def balance(rows: DataFrame, answer: Column, key: Sequence[str], fraction: float, scope: Sequence[str] = (), seed: int = 0, **limits) -> DataFrame:
    """Rows kept so that no answer exceeds its share, globally or within each scope."""
    everywhere = unused(rows, "_all")
    marked = rows.withColumns({"_a": F.lower(T.strip(answer)), everywhere: F.lit(0)})
    groups = [*scope] if scope else [everywhere]
    counts = written(marked.groupBy(*groups, "_a").agg(F.count("*").alias("n")), "counts")
    caps = balanced_caps(counts, fraction, groups, **limits)
    total = counts.join(caps, groups).select(*groups, "_a", "cap").na.fill("", ["_a"])
    known = marked.withColumn("_a", F.coalesce("_a", F.lit("")))
    return first_in_order(known, [*groups, "_a"], seeded(seed, *map(F.col, key)), key, F.col("cap"), total).drop("_a", everywhere)


def unused(rows: DataFrame, stem: str) -> str:
    while stem in rows.columns:
        stem += "_"
    return stem


def seeded_sample(rows: DataFrame, key: Sequence[str], most: int, seed: int = 0) -> DataFrame:
    """At most ``most`` rows, the first in seeded order; no task holds more than one bin of them."""
    whole = unused(rows, "_all")
    marked = rows.withColumn(whole, F.lit(0))
    total = rows.sparkSession.createDataFrame([(0, most)], f"{whole} int, _most long")
    return first_in_order(marked, [whole], seeded(seed, *map(F.col, key)), key, F.col("_most"), total).drop(whole)


def split_by_group(rows: DataFrame, group: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds ``is_val``: whole groups go to one side, ``max(1, floor(n * fraction))`` of them to validation."""
    keys = written(rows.select(F.col(group).alias("_g")).where("_g is not null").distinct(), "groups")
    chosen = seeded_sample(keys, ["_g"], max(1, int(keys.count() * fraction)), seed).withColumn("_val", F.lit(True))
    return rows.join(chosen, rows[group] == chosen["_g"], "left").withColumn("is_val", F.coalesce("_val", F.lit(False))).drop("_g", "_val")


def leaked(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; a sound split has none."""
    return left.select(key).intersect(right.select(key))


def orphans(files: DataFrame, kept: DataFrame, file_key: str, kept_key: str) -> DataFrame:
    return files.join(kept.select(F.col(kept_key).alias("_k")), F.col(file_key) == F.col("_k"), "left_anti")


# ---- gates ----------------------------------------------------------------------------

#: Floors of the four builders.  Fixed values.
FLOORS: dict[str, dict[str, float]] = {
    "questions": {"min_records": 2000, "min_groups": 300, "min_answers": 100, "max_top": 0.35},
    "change": {"min_records": 500, "min_groups": 50, "min_answers": 8, "max_top": 0.35},
    "typed": {"min_records": 2000, "min_groups": 100, "min_answers": 8, "max_top": 0.35},
    "optical_sar": {"min_records": 4000, "min_groups": 800, "min_answers": 10, "max_top": 0.35},
}


def quality_stats(rows: DataFrame, group: Column, answer: Column) -> DataFrame:
    """One row: records, groups, answers, top_answer_fraction (records per group is their ratio)."""
    tidy = rows.select(group.alias("g"), F.lower(T.strip(answer)).alias("a"))
    by_answer = tidy.groupBy("a").agg(F.count("*").alias("n"))
    top = by_answer.agg(F.sum("n").alias("records"), F.count("a").alias("answers"), F.max("n").alias("most"))
    groups = tidy.agg(F.count_distinct("g").alias("groups"))
    share = F.coalesce(F.try_divide(F.col("most").cast("double"), F.col("records")), F.lit(0.0))
    return top.join(groups).select(F.coalesce("records", F.lit(0)).cast("long").alias("records"), "groups", "answers", share.alias("top_answer_fraction"))  # one row each side


def quality_problems(stats: DataFrame, min_records: int = 2000, min_groups: int = 300, min_answers: int = 100, max_top: float = 0.35) -> DataFrame:
    tests = (("too_few_records", F.col("records") < min_records), ("too_few_groups", F.col("groups") < min_groups), ("too_few_answers", F.col("answers") < min_answers), ("dominant_answer", F.col("top_answer_fraction") > max_top))
    return stats.withColumn("problems", F.filter(F.array(*[F.when(t, name) for name, t in tests]), lambda x: x.isNotNull()))


def assert_quality(rows: DataFrame, group: Column, answer: Column, **limits) -> None:
    row = quality_problems(quality_stats(rows, group, answer), **limits).first()
    if row.problems:
        raise BuildError(", ".join(row.problems))


def records_per_group(stats: DataFrame) -> DataFrame:
    return stats.withColumn("records_per_group", F.coalesce(F.try_divide(F.col("records").cast("double"), F.col("groups")), F.lit(0.0)))


def failure_fraction(rows: DataFrame, failed: Column) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(failed).alias("failed")).withColumn("fraction", F.coalesce(F.try_divide(F.col("failed").cast("double"), F.col("total")), F.lit(0.0)))


def template_skew(rows: DataFrame, template: str, answer: Column, limit: float = 0.70) -> DataFrame:
    """Templates with two answers of which one has more than ``limit``."""
    counts = rows.groupBy(template, F.lower(T.strip(answer)).alias("_a")).agg(F.count("*").alias("n"))
    per = counts.groupBy(template).agg(F.count("*").alias("answers"), (F.max("n") / F.sum("n")).alias("top_share"))
    return per.withColumn("skewed", (F.col("answers") == 2) & (F.col("top_share") > limit))


def top_values(rows: DataFrame, value: str, first: str, k: int) -> DataFrame:
    """value, n of the k commonest; ties in the order of their first appearance."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(first).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", value).limit(k).select(value, "n")
