"""Connected components over an edge table, distributed, without collecting any of it.

Each round hooks every node's root to the smallest root next to it and then jumps
pointers, so rounds grow with the logarithm of the longest chain.  Sums are minima, so
a node with very many edges is combined before the shuffle; joins on a node or root that
many rows share are spread.  Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_among, hot_keys, spread_join, staged


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(src, dst)``; root is the least node reachable.

    Self-loops, repeated edges and either direction are fine; null ends are ignored.
    An empty table gives no rows.
    """
    pairs = edges.select("src", "dst").where("src is not null and dst is not null")
    both = staged(pairs.unionAll(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    hubs = hot_keys(both, "dst")
    roots = staged(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("node"), F.least("src", "m").alias("root")), "roots")
    for _ in range(max_rounds):
        near = spread_join(both, roots, "dst", "node", "src", hot=hubs).groupBy("src").agg(F.min("root").alias("low"))
        own = roots.join(near, roots.node == near.src).select("node", "root", F.least("root", "low").alias("low"))
        # Hook: the old root, too, learns the lowest root that any of its nodes has seen.
        low = own.select("node", F.col("low").alias("root"), F.col("root").alias("old"))
        hooks = own.where("low < root").select(F.col("root").alias("node"), F.col("low").alias("root"), F.lit(None).cast("long").alias("old"))
        hooked = staged(low.unionAll(hooks).groupBy("node").agg(F.min("root").alias("root"), F.max("old").alias("old")), "hooked")
        # Jump: only roots that have got a root of their own are looked up.
        heads = hooked.groupBy(F.col("root").alias("head")).count()
        jumps = hooked.join(heads, F.col("node") == F.col("head")).where("root < head").select("head", F.col("root").alias("to"))
        jumped = spread_join(hooked, jumps, "root", "head", "node", hot=hot_among(heads, "head"), how="left")
        after = staged(jumped.select("node", F.coalesce("to", "root").alias("root"), "old"), "roots")
        roots = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return roots
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
