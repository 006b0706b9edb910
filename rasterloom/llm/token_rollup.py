"""Token counts kept as delta-maintained rollups.

A batch of changes becomes signed rows: an insert adds its counts, a delete takes the
counts of the rows it removes away, a revision does both.  Totals by source, language and
tokenizer version are sums of signed rows, so a batch touches only what it changes.

Per batch two tables are written in the store's folder: ``ledger/batch=<id>`` (a signed row
per document and change) and then ``deltas/batch=<id>`` (their sums).  A batch is committed
once its deltas carry Spark's ``_SUCCESS`` mark, which is written last; committing it again
is a no-op, and a batch that died half-way is simply written over.  Readers name committed
batches only.  ``compact`` folds all committed batches into one of live rows, which takes
their place in the same atomic way; their names stay committed.

Null texts count zero tokens; null source or language is a group of its own.  Repeated rows
count each.  Very long texts are counted whole.  A delete or revision names ids, or ids and
contents; one of an unknown id changes nothing (a revision inserts), one of a repeated id takes
all its rows away (of that content, if it is named).  Rows without an id have the null id in
common: a revision replaces them together, and none is an exact copy of another.  An empty
batch commits.  Documents' other columns may have any name; they are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, spread_join, staged

KEYS = ("source", "lang", "tokenizer")
_LEDGER = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, content string"
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


@cache
def _encoding(pattern: str, ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


class BytePairCounter:
    """Tokens of a text under a rank file; the file is read once and travels with the object."""

    def __init__(self, rank_file: str, pattern: str):
        self.ranks, self.pattern = Path(rank_file).read_bytes(), pattern

    def __call__(self, text: str) -> int:
        return len(_encoding(self.pattern, self.ranks).encode_ordinary(text))


def counted(documents: DataFrame, counter: Callable[[str], int], tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Rows for the ledger with a positive sign, map-only; ``content`` is a digest of the text."""
    prepare(documents.sparkSession)
    rows = documents.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
        F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), 256).alias("content"), F.col(f"`{text_col}`").cast("string").alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [counter(text) if (text := t.as_py()) else 0 for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "content", "n_tokens"])

    found = rows.mapInArrow(count, "doc_id long, source string, lang string, content string, n_tokens long")
    return found.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(1).cast("long").alias("n_docs"), "n_tokens", "content")


class TokenRollup:
    """The store below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # -- folders, through Hadoop's file systems: any store that Spark writes to

    def _folder(self, name: str):
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _names(self, kind: str) -> list[str]:
        fs, place = self._folder(kind)
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def committed(self) -> list[str]:
        """Names of the committed batches that no committed compaction has replaced."""
        done = [n for n in self._names("deltas") if self.is_committed(n)]
        gone: set[str] = set()
        for name in set(self._names("replaced")) & set(done):
            gone |= {r.value for r in self.spark.read.text(f"{self.path}/replaced/batch={name}").collect()}  # names of batches
        return [n for n in done if n not in gone]

    def is_committed(self, batch: str) -> bool:
        fs, place = self._folder(f"deltas/batch={batch}/_SUCCESS")
        return fs.exists(place)

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/batch={b}" for b in done])

    # -- state

    def ledger(self) -> DataFrame:
        return self._read("ledger", _LEDGER)

    def live(self) -> DataFrame:
        """The rows whose signed counts don't cancel: what is in the corpus now."""
        sums = self.ledger().groupBy("doc_id", *KEYS, "content").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0")

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of the groups that have documents."""
        sums = self._read("deltas", _DELTAS).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    # -- changes

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Write a batch of signed ledger rows; false if it was committed before."""
        if self.is_committed(batch):
            return False
        signed.select(*[c.split()[0] for c in _LEDGER.split(", ")]).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")
        rows = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger/batch={batch}")
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        return True

    def insert(self, batch: str, rows: DataFrame) -> bool:
        """``rows`` as made by ``counted``."""
        return self.is_committed(batch) is False and self.commit(batch, rows)

    def _taken(self, ids: DataFrame) -> DataFrame:
        """The live rows of these ids (and contents, if named), with the sign turned."""
        named = [c for c in ("doc_id", "content") if c in ids.columns]
        gone = ids.select(*[F.col(c).alias(f"gone_{c}") for c in named]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"gone_{c}")) for c in named]
        old = self.live().join(gone, same, "left_semi")
        return old.withColumns({"n_docs": -F.col("n_docs"), "n_tokens": -F.col("n_tokens")})

    def delete(self, batch: str, ids: DataFrame) -> bool:
        return self.is_committed(batch) is False and self.commit(batch, self._taken(ids))

    def revise(self, batch: str, rows: DataFrame) -> bool:
        """New counts for the ids of ``rows``: the old ones are taken away in the same batch."""
        return self.is_committed(batch) is False and self.commit(batch, self._taken(rows.select("doc_id")).unionByName(rows))

    def recount(self, batch: str, rows: DataFrame) -> bool:
        """New counts, as made by ``counted``, for the documents among ``rows`` that are live."""
        if self.is_committed(batch):
            return False
        live = self.live().select(F.col("doc_id").alias("live_id"), F.col("content").alias("live_content")).distinct()
        new = rows.join(live, F.col("doc_id").eqNullSafe(F.col("live_id")) & (F.col("content") == F.col("live_content")), "left_semi")
        return self.commit(batch, self._taken(rows.select("doc_id", "content")).unionByName(new))

    def exact_copies(self) -> DataFrame:
        """Id and content of live documents whose text a smaller id has, too."""
        rows = staged(self.live().select("doc_id", "content"), "live")
        many = rows.groupBy("content").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
        same = many.select(F.col("content").alias("many_content"), "least")
        return spread_join(rows, same, "content", "many_content", "doc_id").where("doc_id > least").select("doc_id", "content")

    def compact(self, batch: str) -> bool:
        """One batch of the live rows takes the place of all committed ones."""
        if self.is_committed(batch):
            return False
        names = self.committed()
        self.spark.createDataFrame([(n,) for n in names], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/replaced/batch={batch}")
        return self.commit(batch, self.live())
