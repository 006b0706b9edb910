"""A training corpus made from ``documents``: five stages, each a whole-table operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns that they
were given, extra ones with whatever names included; an empty table stays empty; texts are read
whole, however long; rows that repeat an id or have none are judged each by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm import decontaminate, near_copies, pieces, quality, secrets
from rasterloom.llm.catalog import TOKENIZERS
from rasterloom.llm.common import staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the positive-unlabelled classifier rejects (score below 0.7) go.

    Null and empty texts get the model's score for all-zero features; equal texts have equal
    scores, so ties and repeated rows go or stay together.  Without labels or rows the score is
    0.5 and nothing stays.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, Jaccard 0.8) stays: the smallest id.

    Links come from the Golay keys of SimHash and, for pairs beyond four bits, from MinHash
    bands, all verified on whole sets.  Null and wordless texts are one class.  Of rows of equal id
    and text one stays; an id counts as smaller than none; a class without ids keeps one row.
    """
    return near_copies.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates (a twentieth of their words or more in its windows) go.

    Null and wordless texts, and all texts if the benchmark is empty, are clean and stay.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are covered, and ``n_chars`` follows a changed text; every document stays.

    Null and empty texts stay as they are; of overlapping findings the likelier is covered.
    """
    return secrets.masked(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, its N-best scores and changes, and the exact way back; a row per document.

    Null and empty texts have no ids; ties are ordered by the search, alike on every machine.
    """
    return pieces.encode(docs, f"{TOKENIZERS}/piece_bpe_32k.model", n=4)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL can express neither the fitted models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
