"""Exact percentiles of groups of any size by rank selection.

``F.percentile`` keeps a group's distinct values in one reducer.  Here a pass deals the values
that a wanted rank may lie among to ``bins`` bins (by logarithms while a range is wide, then
evenly) and counts them, combined before the shuffle; the bin that holds the rank is the next pass's range.
Once all these bins hold ``most`` values at most, or one value however often, the ranks are read
from the bins' own values.  So no task holds more than ``most`` values of a group, and a group
that holds all rows is spread over all tasks.  Results are bit-equal to ``F.percentile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checkpoints import written


def _bin(v: Column, low: Column, high: Column, bins: int) -> Column:
    """The bin of v within [low, high], which never falls as v rises: by logarithms in a wide range, else even."""
    unit = F.greatest(F.greatest(F.abs(low), F.abs(high)) * 2.0**-400, F.lit(5e-324))
    scaled = lambda x: F.signum(x) * F.log1p(F.abs(x) / unit)
    wide = (F.signum(low) * F.signum(high) <= 0) | (F.greatest(F.abs(low), F.abs(high)) > 4 * F.least(F.abs(low), F.abs(high)))

    def share(v: Column, low: Column, high: Column) -> Column:
        width = high / 2 - low / 2  # halves first, so that no difference overflows
        return F.when(width > 0, F.try_divide(v / 2 - low / 2, width)).otherwise(F.when(v > low, 1.0).otherwise(0.0))

    return F.least(F.floor(F.when(wide, share(scaled(v), scaled(low), scaled(high))).otherwise(share(v, low, high)) * bins), F.lit(bins - 1)).cast("int")


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), *, bins: int = 4096, most: int = 1 << 16, max_passes: int = 64) -> DataFrame:
    """``by`` columns and ``q``, an array of the percentiles at ``shares`` (linear interpolation) of finite ``value``s.

    Nulls and NaN take no part; a group without values has no row.  ``rows`` are read once a
    pass (three as a rule, a few more for values over hundreds of octaves), so an expensive plan should be written before.
    """
    keys = [*by] or ["_all"]
    data = rows.select(*[F.col(c) for c in by], F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    data = data if by else data.withColumn("_all", F.lit(0))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]

    # One row per group and wanted rank: the values at or around (n - 1) * share.
    whole = data.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    at = lambda share: (F.col("n") - 1) * F.lit(float(share))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(s)), F.ceil(at(s))) for s in shares])))
    want = written(whole.select(*keys, F.col("n").alias("held"), "low", "high", F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below")), "ranks")

    for _ in range(max_passes):
        open_ = want.where(f"held > {most} and low < high")
        if open_.isEmpty():
            break
        ranges = open_.groupBy(*keys).agg(F.collect_set(F.struct("low", "high")).alias("ranges"))  # two a share at most
        inside = lambda r: (F.col("_v") >= r["low"]) & (F.col("_v") <= r["high"])
        met = data.alias("d").join(ranges.alias("r"), same("d", "r")).select(*[F.col(f"d.{k}") for k in keys], "_v", F.explode(F.filter("ranges", inside)).alias("r"))
        bin_ = _bin(F.col("_v"), F.col("r.low"), F.col("r.high"), bins)
        counted = met.groupBy(*keys, F.col("r.low").alias("low"), F.col("r.high").alias("high"), bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("last"))
        upto = Window.partitionBy(*keys, "low", "high").orderBy("bin")  # ``bins`` rows at most
        placed = counted.withColumn("before", F.sum("n").over(upto) - F.col("n"))
        fit = [*same("w", "c"), F.col("w.low") == F.col("c.low"), F.col("w.high") == F.col("c.high"), F.col("rank") - F.col("below") >= F.col("before"), F.col("rank") - F.col("below") < F.col("before") + F.col("c.n")]
        next_ = open_.alias("w").join(placed.alias("c"), fit).select(*[F.col(f"w.{k}") for k in keys], F.col("c.n").alias("held"), F.col("least").alias("low"), F.col("last").alias("high"), "rank", (F.col("below") + F.col("before")).alias("below"))
        want = written(next_.unionAll(want.where(f"not (held > {most} and low < high)").select(next_.columns)), "ranks")
    else:
        raise RuntimeError(f"ranks did not settle in {max_passes} passes")

    # Bins of one value tell it; of the others the values themselves are ranked, ``most`` at most.
    known = want.where("low = high").select(*keys, "rank", F.col("low").alias("value"))
    small = want.where("low < high")
    ranges = small.groupBy(*keys).agg(F.collect_set(F.struct("low", "high", "below")).alias("ranges"))
    met = data.alias("d").join(ranges.alias("r"), same("d", "r")).select(*[F.col(f"d.{k}") for k in keys], "_v", F.explode(F.filter("ranges", lambda r: (F.col("_v") >= r["low"]) & (F.col("_v") <= r["high"]))).alias("r"))
    order = Window.partitionBy(*keys, "r.low", "r.high").orderBy("_v")
    ranked = met.select(*keys, (F.row_number().over(order) - 1 + F.col("r.below")).cast("long").alias("rank"), F.col("_v").alias("value"))
    found = ranked.alias("a").join(small.select(*keys, "rank").distinct().alias("b"), [*same("a", "b"), F.col("a.rank") == F.col("b.rank")]).select(*[F.col(f"a.{k}") for k in keys], F.col("a.rank").alias("rank"), "value")
    values = known.unionAll(found).groupBy(*keys).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("rank", "value")))).alias("values"))

    def share_of(share: float) -> Column:
        place = at(share)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.try_element_at("values", low), F.try_element_at("values", high)
        return F.when((low == high) | (a == b), a).otherwise((high - place) * a + (place - low) * b)

    done = whole.alias("w").join(values.alias("v"), same("w", "v")).select(*[F.col(f"w.{k}") for k in by], F.array(*map(share_of, shares)).alias("q"))
    return done
