"""Text expressions: they take columns and give columns, and stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, as answer normalisation deletes it.  Fixed value.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Cues of a description task.  Fixed values.
CAPTION_CUES = ("describe", "caption", "provide a description", "give a description", "summarize the image")
#: Placeholder texts that mark a broken build.  Fixed values.
FORBIDDEN_ANSWERS = ("urban and natural land-cover.", "urban and natural land-cover")
FORBIDDEN_QUESTIONS = ("describe the visible features in this image.", "describe the visible features.")
#: Prefixes of the paired prompts.  Fixed values.
CHANGE_PREFIX = "The left image is from time T1, the right image is from time T2. Answer the question about what changed: "
FUSION_PREFIX = "The left image is optical/multispectral, the right image is SAR radar backscatter in decibels. Use both together to answer: "


def strip(text: Column) -> Column:
    """Trim all white space, not just spaces."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between white space; an empty array for blank text."""
    return F.filter(F.split(strip(text), r"\s+"), lambda w: w != "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def clean_prompt(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?i)<image>\s*", ""))


def first_text(record: Column, names: Sequence[str]) -> Column:
    """The first named field of a VARIANT that is a non-blank string or a number (no booleans)."""

    fields = F.try_variant_get(record, "$", "map<string,variant>")

    def one(value: Column) -> Column:
        kind = F.schema_of_variant(value)
        text = F.nullif(strip(F.try_variant_get(value, "$", "string")), F.lit(""))
        usable = (kind == "STRING") | F.startswith(kind, F.lit("DECIMAL")) | kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
        return F.when(usable, text)

    found = F.transform(F.array(*map(F.lit, names)), lambda n: one(F.try_element_at(fields, n)))
    return F.try_element_at(F.filter(found, lambda t: t.isNotNull()), F.lit(1))


def is_caption(question: Column, answer: Column) -> Column:
    cue = F.lit(False)
    for phrase in CAPTION_CUES:
        cue = cue | F.contains(F.lower(question), F.lit(phrase))
    return cue | (F.size(words(answer)) >= 20)


def is_forbidden(question: Column, answer: Column) -> Column:
    return F.lower(strip(answer)).isin(*FORBIDDEN_ANSWERS) | F.lower(strip(question)).isin(*FORBIDDEN_QUESTIONS)


def normalise_answer(text: Column) -> Column:
    """Lower case, no punctuation, then no articles, single spaces."""
    bare = F.translate(strip(F.lower(text)), PUNCTUATION, "")
    kept = F.filter(words(bare), lambda w: ~w.isin("a", "an", "the"))
    return F.array_join(kept, " ")


def token_f1(predicted: Column, gold: Column) -> Column:
    """Harmonic mean of multiset precision and recall over normalised words."""
    # A lambda's variable holds both word lists: outside one they would be made again for every word.
    tidy = lambda c: F.sort_array(words(normalise_answer(c)))
    return F.transform(F.array(F.struct(tidy(predicted).alias("p"), tidy(gold).alias("g"))), lambda s: _f1(s["p"], s["g"]))[0]


def _f1(p: Column, g: Column) -> Column:
    """Of two sorted lists: one merge counts what they share, so long texts take linear time."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def step(at: Column, _: Column) -> Column:
        a, b = F.get(p, at["i"]), F.get(g, at["j"])
        moved = F.struct((at["i"] + (a <= b).cast("int")).alias("i"), (at["j"] + (b <= a).cast("int")).alias("j"), (at["n"] + (a == b).cast("int")).alias("n"))
        return F.when(a.isNotNull() & b.isNotNull(), moved).otherwise(at)

    overlap = F.aggregate(F.sequence(F.lit(0), F.size(p) + F.size(g)), start, step, lambda at: at["n"])
    score = 2.0 * overlap / (F.size(p) + F.size(g))
    blank = (F.size(p) == 0) | (F.size(g) == 0)
    return F.when(blank, (F.size(p) == F.size(g)).cast("double")).otherwise(score)


def numbers(text: Column, count: int = 4) -> Column:
    """The first decimal numbers of a text, as doubles."""
    found = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(F.slice(found, 1, count), lambda x: x.cast("double"))


def html_escape(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def position_words(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    """Where a point lies on a 3 by 3 grid."""
    col = F.when(cx * 3.0 < w, "western").when(cx * 3.0 < 2.0 * w, "").otherwise("eastern")
    row = F.when(cy * 3.0 < h, "northern").when(cy * 3.0 < 2.0 * h, "").otherwise("southern")
    return F.when((row == "") & (col == ""), "centre").otherwise(F.array_join(F.filter(F.array(row, col), lambda p: p != ""), " "))


#: Parts of file names that tell the modality.  Fixed values.
SAR_HINTS = ("sar", "risat", "s1a", "s1b", "sentinel1", "sentinel-1", "grd", "slc", "_vv", "_vh")
OPTICAL_HINTS = ("optical", "cartosat", "s2a", "s2b", "sentinel2", "sentinel-2", "msi", "resourcesat")


def modality(path: Column, dtype: Column, bands: Column) -> Column:
    """sar, optical or unknown: hints in the file name first, then type and band count."""
    low = F.lower(basename(path))
    hinted = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(low, h))
    single = (bands == 1) & dtype.isin("float32", "float64", "complex64", "complex128")
    return F.when(hinted(SAR_HINTS), "sar").when(hinted(OPTICAL_HINTS), "optical").when(single, "sar").when(bands >= 3, "optical").otherwise("unknown")


def vqa_prompt(question: Column) -> Column:
    return F.concat(F.lit("answer en "), strip(question))


def change_prompt(question: Column) -> Column:
    return F.concat(F.lit("answer en " + CHANGE_PREFIX), strip(question))


def fusion_prompt(question: Column) -> Column:
    return F.concat(F.lit("answer en " + FUSION_PREFIX), strip(question))


def caption_prompt() -> Column:
    return F.lit("caption en")


def detect_prompt(phrases: Column) -> Column:
    cleaned = F.transform(F.filter(phrases, lambda p: strip(p) != ""), lambda p: strip(F.regexp_replace(strip(p), r"\.+$", "")))
    return F.concat(F.lit("detect "), F.when(F.size(cleaned) == 0, "object").otherwise(F.array_join(cleaned, " ; ")))


def labels_of(raw: Column) -> Column:
    """Lower-cased, trimmed labels; blanks and bare integers go."""
    tidy = F.transform(raw, lambda x: F.lower(strip(x)))
    return F.filter(tidy, lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"^-?\d+$")))


def data_uri(content: Column, media_type: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{media_type};base64,"), F.base64(content))


def content_id(*contents: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the parts, one after another."""
    return F.substring(F.sha1(F.concat(*contents)), 1, 16)


def upload_name(content: Column, suffix: Column) -> Column:
    return F.concat(F.substring(F.sha2(content, 256), 1, 16), F.lower(suffix))


def cache_key(content: Column, prompt: Column, extra: Column) -> Column:
    return F.sha2(F.concat(content, prompt, extra), 256)
