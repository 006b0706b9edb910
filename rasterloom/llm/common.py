"""Shared plumbing: staged tables, worker imports, column-name hygiene, joins that bear hot keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch sent to a Python worker, before the row that crosses it.
BATCH_BYTES = 8 << 20

_REPO = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package, whatever folder the driver started in."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *paths])
    # Very long texts: a batch is bounded by bytes as well as by rows.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a temporary folder serves a local master (tests); on a cluster, whose
    executors would not see it, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage in the shared folder and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def as_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under fixed names, so extra columns can't clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


#: A key is hot if it holds more than one in so many rows, so there are fewer hot keys than this.
_HOT_SHARE = 2048


def hot_above(rows: int) -> int:
    """A key of more rows than this is hot; below a hundred none is."""
    return max(100, rows // _HOT_SHARE)


def hot_keys(rows: DataFrame, key: str) -> list:
    """The hot keys of ``rows`` (a staged table): fewer than ``_HOT_SHARE`` values, whatever its size."""
    return hot_among(rows.groupBy(key).count(), key)


def hot_among(counts: DataFrame, key: str, rows: int | None = None) -> list:
    """The hot keys by their ``count`` column, of ``rows`` rows in all (its sum, if not given)."""
    known = counts.where(F.col(key).isNotNull())
    most, total = known.agg(F.max("count"), F.sum("count")).first()
    limit = hot_above(total if rows is None else rows) if most else 0
    if not most or most <= limit:  # as a rule: one small job
        return []
    return [r[0] for r in known.where(F.col("count") > limit).select(key).limit(_HOT_SHARE).collect()]


def spread_join(rows: DataFrame, facts: DataFrame, row_key: str, fact_key: str, spread: str | Column, *, hot: list | None = None, how: str = "inner", salts: int = 64) -> DataFrame:
    """Join many ``rows`` to ``facts`` (one per key) on a key that may hold a third of the rows.

    Rows of hot keys are dealt by ``spread`` over ``salts`` parts and their few facts repeated for
    each part; other keys, and tables without hot keys, are joined as they are.
    """
    hot = hot_keys(rows, row_key) if hot is None else hot
    if not hot:
        return rows.join(facts, F.col(row_key) == F.col(fact_key), how)
    salt = F.when(F.col(row_key).isin(hot), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(0)
    parts = F.when(F.col(fact_key).isin(hot), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left, right = rows.withColumn("_salt", salt), facts.withColumn("_part", F.explode(parts))
    return left.join(right, (F.col(row_key) == F.col(fact_key)) & (F.col("_salt") == F.col("_part")), how).drop("_salt", "_part")
