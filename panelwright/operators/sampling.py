"""Weighted resampling with replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from panelwright.operators.quantiles import number, running_totals
from panelwright.session import cut_lineage


def weighted_resample(df: DataFrame, col: str, weight: str, n: int, seed: int, per_range: int = 1_000_000, arithmetic: bool = False) -> DataFrame:
    """``n`` draws of ``col`` with probability proportional to ``weight``.

    Equal values are merged into cumulative-weight intervals; each draw is a
    hash of its number, so results do not depend on partitioning. Draws and
    interval starts meet in slices of [0, 1) and each draw takes the interval
    that starts last before it; an interval is repeated at the start of every
    slice that it reaches into. There are as many slices as draws and distinct
    values need at ``per_range`` rows each. ``arithmetic`` uses a plain integer hash that any SQL engine can repeat.
    """
    x, w = number(col), number(weight)
    kept = df.filter(x.isNotNull() & (w > 0)).select(x.alias("v"), w.alias("w"))
    values = cut_lineage(kept.groupBy("v").agg(F.sum("w").alias("w")))
    distinct = values.count()
    ranges = max(1, -(-(n + distinct) // per_range))
    cum = running_totals(values, "v", "w", per_range=per_range)
    start = (F.col("cum") - F.col("w")) / F.col("total")
    end = F.col("cum") / F.col("total")
    slice_of = lambda u: F.least(F.floor(u * ranges), F.lit(ranges - 1)).cast("int")
    starts = cum.select(
        "v", start.alias("s"), F.explode(F.sequence(slice_of(start), slice_of(end))).alias("slice")
    ).select("slice", F.greatest(F.col("s"), F.col("slice") / F.lit(float(ranges))).alias("u"), "v", F.lit(None).cast("bigint").alias("draw"))
    # a later interval wins when two start at the same point
    hashed = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    if arithmetic:
        hashed = (F.col("id") * F.lit(2654435761) + F.lit(seed)) % F.lit(2**32) / F.lit(float(2**32))
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), hashed.alias("u")).select(slice_of(F.col("u")).alias("slice"), "u", F.lit(None).cast("double").alias("v"), "draw")
    order = W.partitionBy("slice").orderBy(F.col("u"), F.col("draw").isNotNull(), F.col("v")).rowsBetween(
        W.unboundedPreceding, 0
    )
    met = starts.unionByName(draws).withColumn("value", F.last("v", ignorenulls=True).over(order))
    return met.filter(F.col("draw").isNotNull()).select("draw", F.col("value").alias(col))
