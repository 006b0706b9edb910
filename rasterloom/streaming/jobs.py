"""Structured Streaming forms of the builders: pairing, deduplication, windows, caps, and a stop after enough rows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.checkpoints import importable
from ..operators.records import seeded

_PAIRS = "key string, question_turn long, answer_turn long, question string, answer string"


def _timed(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Event time as a timestamp (files may hold one without a zone) under a watermark."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def pair_turns(turns: DataFrame, key: str, order: str, role: str, value: str, time: str, delay: str = "10 minutes") -> DataFrame:
    """Question-answer pairs of late and unordered turns.

    A conversation's turns wait in state until the watermark passes its last one; then they
    are paired in order, as the batch form does (tags of images go, a question that is blank
    without them counts as asked but gives no pair), and the state goes.  Keys are text.
    """
    asks = F.lower(role).isin("human", "user")
    turns = turns.where(T.strip(F.col(value)) != "").withColumn(value, F.when(asks, T.clean_prompt(F.col(value))).otherwise(F.col(value)))
    shaped = turns.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("turn"), F.lower(role).alias("role"), T.strip(F.col(value)).alias("said"), F.col(time).cast("timestamp").alias("time")).withWatermark("time", delay)

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield _paired(group[0], [tuple(r) for r in held])
            return
        latest = 0
        for frame in frames:
            held += [f"{t}\t{r}\t{s}" for t, r, s in zip(frame.turn, frame.role, frame.said, strict=True)]
            latest = max(latest, int(frame.time.max().timestamp() * 1000))
        state.update((held,))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)

    def _paired(group: str, rows: list) -> pd.DataFrame:
        turns = sorted((int(t), r, s) for t, r, s in ("".join(row).split("\t", 2) for row in rows))
        out, asked = [], None
        for turn, who, said in turns:
            if who in ("human", "user"):
                asked = (turn, said)
            elif who in ("gpt", "assistant", "model"):
                if asked and asked[1]:
                    out.append((group, asked[0], turn, asked[1], said))
                asked = None
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PAIRS.split(", ")])

    return shaped.groupBy("key").applyInPandasWithState(step, _PAIRS, "held array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_content(rows: DataFrame, content: str, time: str, delay: str = "1 hour") -> DataFrame:
    """First arrivals of each content within the watermark."""
    return _timed(rows, time, delay).withColumn("content_id", T.content_id(F.col(content))).dropDuplicatesWithinWatermark(["content_id"])


def tumbling(rows: DataFrame, time: str, width: str, by: str, value: str, delay: str = "10 minutes") -> DataFrame:
    counted = _timed(rows, time, delay).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return counted.select(F.col("w.start").alias("start"), by, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, by: str, delay: str = "10 minutes") -> DataFrame:
    found = _timed(rows, time, delay).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def exact_match_by_type(predictions: DataFrame, time: str, kind: str, predicted: str, gold: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """n and exact match per type and window of time."""
    same = (T.normalise_answer(F.col(predicted)) == T.normalise_answer(F.col(gold))).cast("double")
    scored = _timed(predictions, time, delay).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.avg(same).alias("exact_match"))
    return scored.select(F.col("w.start").alias("start"), kind, "n", "exact_match")


# ---- caps ------------------------------------------------------------------------------------


class _Capped(StatefulProcessor):
    """Keeps a group's ``cap`` first rows in seeded order until the watermark has passed its last one, then gives them."""

    def __init__(self, cap: int, wait_ms: int):
        self.cap, self.wait_ms = cap, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", StructType([StructField("order", StringType()), StructField("row", StringType())]))
        self.done = handle.getValueState("done", StructType([StructField("told", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        if self.done.exists():  # the group has been given: what comes later changes nothing
            for _ in rows:
                pass
            return iter(())
        best = dict(self.held.get()) if self.held.exists() else {}
        latest = 0
        for frame in rows:
            best.update(zip(frame["row_order"], frame["row_json"], strict=True))  # a repeated row has the same order
            latest = max(latest, int(frame["row_ms"].max()))
            if len(best) > 4 * self.cap:
                best = dict(heapq.nsmallest(self.cap, best.items()))
        self.held.put([(k, v) for k, v in heapq.nsmallest(self.cap, best.items())])
        for timer in list(self.handle.listTimers()):
            if timer < latest + self.wait_ms:
                self.handle.deleteTimer(timer)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(latest + self.wait_ms)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = sorted(self.held.get())
        self.held.clear()
        self.done.update(("",))
        yield pd.DataFrame({"row_json": [row for _, row in rows]})

    def close(self) -> None:
        pass


def cap_per_group(rows: DataFrame, group: Sequence[str], key: Sequence[str], cap: int, time: str, *, seed: int = 0, delay: str = "10 minutes", quiet: str = "0 seconds") -> DataFrame:
    """``records.cap_per_group`` of a stream: the first ``cap`` rows of each group in seeded order.

    A group's best rows wait in state, ``cap`` of them whatever comes; once the watermark is
    ``quiet`` past its last row they are given and the group is closed.  Rows that come again, or
    after that, change nothing, so after all input the rows are those of the batch form.
    Needs the RocksDB state store (``use_rocksdb``).
    """
    importable(rows.sparkSession)
    schema = rows.schema
    keys = F.to_json(F.struct(*group), {"ignoreNullFields": "false"}).alias("group_key")
    order = F.concat(seeded(seed, *map(F.col, key)), F.lit("|"), F.to_json(F.struct(*key), {"ignoreNullFields": "false"}))
    shaped = _timed(rows, time, delay).select(keys, order.alias("row_order"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("row_json"), F.unix_millis(time).alias("row_ms"), F.col(time).alias("row_time"))
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000) + 1
    capped = shaped.groupBy("group_key").transformWithStateInPandas(_Capped(cap, wait), "row_json string", "append", "EventTime")
    return capped.select(F.from_json("row_json", schema).alias("r")).select("r.*")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class FirstRows:
    """Writes a stream's rows until ``most`` are there, then stops its query: the rest is never read.

    Batches are taken in order, each row set by ``key`` so that a batch that is run again gives the
    same rows; a batch has a folder of its own, written over if it is run again, and the counts
    are read back from these folders, so a restarted query goes on where it stood.
    """

    def __init__(self, path: str, most: int, key: Sequence[str]):
        self.path, self.most, self.key = path.rstrip("/"), most, list(key)

    def count(self, spark: SparkSession, before: int | None = None) -> int:
        place = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return 0
        batches = [s.getPath().getName() for s in files.listStatus(place) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        wanted = [f"{self.path}/{b}" for b in batches if b.startswith("batch=") and (before is None or int(b[6:]) < before)]
        return spark.read.parquet(*wanted).count() if wanted else 0

    def take(self, batch: DataFrame, number: int) -> None:
        left = self.most - self.count(batch.sparkSession, number)
        if left > 0:
            batch.orderBy(*self.key).limit(left).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def run(self, stream: DataFrame, checkpoint: str, poll_seconds: float = 0.2) -> int:
        """Runs until there are ``most`` rows or all that is there has been read; gives the count."""
        query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.take).trigger(availableNow=True).start()
        spark = stream.sparkSession
        try:
            while query.isActive and not query.awaitTermination(poll_seconds):
                if self.count(spark) >= self.most:
                    break
        finally:
            query.stop()
        if query.exception() is not None and self.count(spark) < self.most:
            raise query.exception()
        return self.count(spark)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/batch=*")
