"""Caps on a stream and an early stop, beside the batch forms."""

import pytest
from pyspark.sql import functions as F

from rasterloom.operators import records as R
from rasterloom.streaming import jobs


@pytest.fixture
def rocksdb(spark):
    jobs.use_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _stream(spark, folder, parts):
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/b={i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def test_streamed_caps_equal_the_batch(spark, rocksdb, tmp_path):
    """Rows come unordered, twice, and late; a group of a third of all rows is capped like the others."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 7}", None if i % 11 == 0 else f"t{i}", 1_700_000_000 + i) for i in range(300)]
    table = spark.createDataFrame(rows, "id long, kind string, text string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    end = spark.createDataFrame([(9_000 + n, "end", "x", 1_700_100_000 + 100_000 * n) for n in range(2)], "id long, kind string, text string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    late = table.where("id = 5").withColumn("id", F.lit(5_000).cast("long"))
    parts = [table.where("id % 2 = 0"), table.where("id % 2 = 1 or id < 40"), end.where("id = 9000"), late.unionByName(table.where("id < 9")), end.where("id = 9001")]
    stream = jobs.cap_per_group(_stream(spark, tmp_path / "in", parts), ["kind"], ["id"], 5, "ts", seed=3)
    query = stream.writeStream.format("memory").queryName("capped").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table("capped").where("kind <> 'end'").collect()))
    assert got == sorted(map(tuple, R.cap_per_group(table, ["kind"], ["id"], 5, seed=3).collect())) and len(got) == 40


def test_a_stream_ends_after_enough_rows(spark, tmp_path):
    parts = [spark.range(10 * n, 10 * n + 10).withColumn("v", F.col("id") * 2) for n in range(6)]
    stream = _stream(spark, tmp_path / "in", parts)
    first = jobs.FirstRows(str(tmp_path / "out"), 25, ["id"])
    assert first.run(stream, str(tmp_path / "check")) == 25
    got = sorted(r.id for r in first.rows(spark).collect())
    assert len(got) == 25 and len({i // 10 for i in got}) == 3  # three files of ten rows
    assert first.run(stream, str(tmp_path / "check")) == 25  # started again: nothing more
    all_ = jobs.FirstRows(str(tmp_path / "all"), 1_000, ["id"])
    assert all_.run(stream, str(tmp_path / "check2")) == 60
    # A batch that is run again replaces its own rows.
    all_.take(parts[2], 2)
    assert all_.count(spark) == 60
