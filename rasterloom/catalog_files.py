"""Queries over files that tasks write from the driver's tables and read again by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, table
from .operators.checkpoints import fresh_path
from .sources import ranged, readers, sinks

_SHARDS = 7
#: Bytes of a tar file; a seventh of the documents is dealt over as many as it takes.
_VOLUME_BYTES = 32 << 20


def _shards(spark, sf_dir) -> str:
    """Tar shards, in volumes, for each seventh of the documents: the text, and a description, of each."""
    docs, folder = table(spark, sf_dir, "documents"), fresh_path(spark, "shards")
    name = F.concat(F.lit("corpus/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    told = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    files = F.array(F.struct(F.concat(name, F.lit(".0.txt")).alias("name"), F.coalesce("text", F.lit("")).alias("content")), F.struct(F.concat(name, F.lit(".json")).alias("name"), told.alias("content")))
    members = docs.select((F.col("doc_id") % _SHARDS).alias("shard"), F.inline(files))
    sinks.write_tar(members, folder, _VOLUME_BYTES).write.format("noop").mode("overwrite").save()
    return folder


_MEMBERS = """SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS key, doc_id % 7 AS shard, coalesce(text, '') AS body, '{"lang":' || coalesce('"' || lang || '"', 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}' AS told FROM documents"""


@query(f"""WITH m AS ({_MEMBERS}) SELECT shard, key, '0.txt' AS role, CAST(octet_length(encode(body)) AS BIGINT) AS n_bytes, md5(body) AS digest FROM m UNION ALL SELECT shard, key, 'json', CAST(octet_length(encode(told)) AS BIGINT), md5(told) FROM m""")
def tar_shards(spark, sf_dir):
    """Members of all shards, each read at its own place."""
    ranged.register(spark)
    members = spark.read.format("tar_members").option("partitionBytes", 1 << 20).load(_shards(spark, sf_dir))
    return members.select(_number("shard", "tar").alias("shard"), "key", "role", F.length("content").cast("long").alias("n_bytes"), F.md5("content").alias("digest"))


@query(f"WITH m AS ({_MEMBERS}) SELECT key, md5(body) AS first, CAST(NULL AS VARCHAR) AS second, told AS annotation FROM m")
def tar_samples(spark, sf_dir):
    """Members found by an index made by a task a shard, grouped into samples by role."""
    members = ranged.members_of(ranged.tar_index(spark, _shards(spark, sf_dir)), 1 << 20)
    return readers.change_samples(members).select("key", F.md5("first").alias("first"), F.md5("second").alias("second"), "annotation")


def _rasters(spark, sf_dir) -> str:
    """A raster of at most 256 rows for each run of embeddings, strips of 16 rows, with two overviews."""
    folder = fresh_path(spark, "rasters")
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("scene"), F.lit(0).alias("band"), (F.col("vec_id") % 256).alias("y"), F.col("embedding").alias("values"))
    sinks.write_tiffs(rows, folder, nodata=-9999.0, overviews=2).write.format("noop").mode("overwrite").save()
    return folder


_RASTER = "r AS (SELECT vec_id // 256 AS scene, vec_id % 256 AS y, generate_subscripts(embedding, 1) - 1 AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"


def _number(path: str, suffix: str):
    return F.regexp_extract(path, rf"(\d+)\.{suffix}$", 1).cast("long")


@query(f"WITH {_RASTER} SELECT scene, y, x, v FROM r WHERE y >= 96 AND y < 160")
def tiff_window(spark, sf_dir):
    """A window of rows of every raster: only the strips that hold it are read."""
    ranged.register(spark)
    pixels = spark.read.format("tiff_pixels").load(_rasters(spark, sf_dir))
    return pixels.where("band = 0 and y >= 96 and y < 160").select(_number("scene", "tif").alias("scene"), "y", "x", "v")


@query(f"WITH {_RASTER} SELECT scene, y // 4 AS y, x // 4 AS x, v FROM r WHERE y % 4 = 0 AND x % 4 = 0")
def tiff_overview(spark, sf_dir):
    """The second overview of every raster: a sixteenth of the pixels, the full image isn't read."""
    ranged.register(spark)
    return spark.read.format("tiff_pixels").option("overview", 2).load(_rasters(spark, sf_dir)).select(_number("scene", "tif").alias("scene"), "y", "x", "v")


@query("""SELECT vec_id // 256 AS scene, 'GTiff' AS driver, any_value(len(embedding)) AS w, CAST(max(vec_id % 256) + 1 AS INT) AS h, 1 AS bands, 'f4' AS dtype, -9999.0::DOUBLE AS nodata, CAST(NULL AS VARCHAR) AS error FROM embeddings GROUP BY 1""")
def tiff_metadata(spark, sf_dir):
    """Size, type and no-data value of every raster from its header alone."""
    found = ranged.raster_metadata(spark, _rasters(spark, sf_dir))
    return found.select(_number("path", "tif").alias("scene"), "driver", "w", "h", "bands", "dtype", "nodata", "error")
