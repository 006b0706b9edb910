"""A stated set of queries against all rows of an index, in blocks, without the driver.

Queries are rows of a table, dealt to blocks of about ``block_rows`` (fewer if they are wide); the
index is a table of packs of rows.  If all queries fit ``broadcast_bytes`` (checked by count and
width), packs stay where they lie and every block comes to them; beyond it blocks and packs meet
in a join on block and share, a share being a part of the packs.  Either way a task sees pairs of
a pack and a block, and hands on what it keeps for a block's queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

#: What a block of queries may hold.
BLOCK_BYTES = 32 << 20


def meet(packs: DataFrame, queries: DataFrame, spread: str, fields: list[str], extra_bytes: int, block_rows: int, broadcast_bytes: int) -> DataFrame:
    """``block, queries`` (a list of structs of ``fields``) beside the columns of ``packs``; a row for each pack and block.

    ``queries`` has ``row`` (an id of its own), ``size`` (the length of its vector: a block's are alike)
    and ``fields``; it and ``packs`` are staged tables.  ``spread``: the column of ``packs`` that deals them to shares.
    """
    spark = packs.sparkSession
    n, widest = queries.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    each = 8 * widest + extra_bytes
    blocks = max(1, -(-n // max(1, min(block_rows, BLOCK_BYTES // each))))
    dealt = queries.withColumn("block", F.concat_ws("-", F.col("size"), F.pmod(F.xxhash64("row"), F.lit(blocks))))
    names = [r.block for r in dealt.select("block").distinct().collect()]  # one in block_rows queries and length
    packed = dealt.groupBy("block").agg(F.collect_list(F.struct(*fields)).alias("queries"))  # about block_rows at most
    every = packs.withColumn("block", F.explode(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")))
    if n * each <= broadcast_bytes:
        return every.join(F.broadcast(packed), "block")
    shares = max(1, -(-2 * shuffle_partitions(spark) // max(1, len(names))))
    left = every.withColumn("share", F.pmod(F.xxhash64(spread), F.lit(shares)))
    right = packed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)).cast("array<bigint>")))
    return left.join(right.hint("shuffle_hash"), ["block", "share"])
