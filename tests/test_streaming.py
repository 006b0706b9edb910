from pyspark.sql import functions as F

from rasterloom.operators import records as R
from rasterloom.streaming import jobs


def _run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_streamed_pairs_equal_the_batch(spark, tmp_path):
    turns = [(k, n, "user" if n % 2 == 0 else "assistant", f"t{k}.{n}", 1_700_000_000 + 60 * n) for k in range(5) for n in range(6)]
    turns += [(7, 0, "user", "<image>\n what is it?", 1_700_000_000), (7, 1, "assistant", "a ship", 1_700_000_060), (8, 0, "user", "<image>", 1_700_000_000), (8, 1, "assistant", "nothing asked", 1_700_000_060), (8, 2, "user", " ", 1_700_000_061), (8, 3, "system", "x", 1_700_000_062)]
    turns.append((99, 0, "user", "later", 1_700_100_000))
    turns.append((99, 1, "user", "later", 1_700_200_000))
    rows = spark.createDataFrame(turns, "conv long, turn long, role string, text string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    for i, part in enumerate((rows.where("conv < 99"), rows.where("conv = 99 and turn = 0"), rows.where("conv = 99 and turn = 1"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = _run(jobs.pair_turns(stream, "conv", "turn", "role", "text", "ts"), "pairs")
    want = R.pair_turns(rows.where("conv < 99"), "conv", "turn", "role", "text")
    assert sorted((r.key, r.question, r.answer) for r in got.collect()) == sorted((str(r.conv), r.question, r.answer) for r in want.collect())
    named = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")).withColumn("conv", F.concat(F.lit("c-"), F.col("conv")))
    assert {r.key for r in _run(jobs.pair_turns(named, "conv", "turn", "role", "text", "ts"), "named").collect()} == {"c-7", *(f"c-{k}" for k in range(5))}


def test_streamed_contents_and_scores(spark, tmp_path):
    rows = [(i, f"text {i % 7}", "Yes." if i % 3 else "no", "yes", "ab"[i % 2], 1_700_000_000 + i) for i in range(40)] + [(99, "end", "x", "y", "z", 1_700_100_000)]
    table = spark.createDataFrame(rows, "id int, text string, said string, gold string, kind string, s long").withColumn("ts", F.timestamp_seconds("s"))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    assert _run(jobs.dedup_content(stream(), "text", "ts"), "contents").select("content_id").distinct().count() == 8 == spark.table("contents").count()
    got = _run(jobs.exact_match_by_type(stream(), "ts", "kind", "said", "gold"), "scores").where("kind <> 'z'").collect()
    assert {(r.kind, r.n, round(r.exact_match, 6)) for r in got} == {(k, 20, round(sum(i % 3 > 0 for i in range(j, 40, 2)) / 20, 6)) for j, k in enumerate("ab")}


def test_streamed_windows_equal_the_batch(spark, tmp_path, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "ev"))
    late = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.expr("ts + interval 3 days").alias("ts"), F.lit(0).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev"))
    got = _run(jobs.tumbling(stream, "ts", "1 day", "event_type", "value"), "days").where("event_type <> 'end'")
    want = events.groupBy(F.window("ts", "1 day"), "event_type").count()
    assert got.agg(F.sum("n")).first()[0] == events.count() and got.count() == want.count()
