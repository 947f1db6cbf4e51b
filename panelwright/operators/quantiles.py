"""Exact quantiles, ranks by weight and bins that hold at any cardinality.

Equal values are merged once, into a counted table that every later step of a call reads. Order statistics are found by radix
selection on the order-preserving 64-bit image of a double: a histogram of the leading 16 bits tells which bucket holds a wanted
rank, the next 16 bits are counted inside those buckets only, and so on until the wanted buckets hold ``per_range`` values or
less; these are put in order. All groups, columns and ranks go through the same rounds, no list of cut points is kept, and no
task sorts more than ``per_range`` values of a bucket. Running totals split values by the same leading bits. NaN is
missing, as NULL is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwright.functions.codes import as_lit, nan_to_null, quoted
from panelwright.session import cut_lineage

PER_RANGE = 1 << 16
_DIGIT = 16  # bits a round: at most 65,536 buckets below a bucket
_BROADCAST_ROWS = 50_000  # wanted ranks up to this number are sent to all tasks; more are joined


def number(col: str) -> Column:
    """The column as a double, NaN as NULL."""
    return nan_to_null(F.col(quoted(col)).cast("double"))


def _ordered_bits(v: pd.Series) -> pd.Series:
    bits = (v.to_numpy(float) + 0.0).view(np.int64)  # -0.0 is 0.0
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def order_image(col: str) -> Column:
    """Whole numbers in the order of the doubles (not NULL, not NaN)."""
    return F.pandas_udf(_ordered_bits, "long")(F.col(quoted(col)))


def _leading(bits: str, shift: int) -> Column:
    """The bits from ``shift`` on; 64 puts everything into one bucket."""
    return F.lit(0).cast("bigint") if shift >= 64 else F.shiftright(bits, shift)


def _range_shift(values: DataFrame, by: Sequence[str], per_range: int) -> int:
    """How many trailing bits a bucket may span so that none holds more than ``per_range`` rows."""
    for shift in range(64, 0, -_DIGIT):
        sizes = values.groupBy(*by, _leading("_bits", shift).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= per_range:
            return shift
    return 0


def _ranged(values: DataFrame, col: str, by: Sequence[str], per_range: int) -> tuple[DataFrame, int]:
    """The rows with ``_range``, their bucket: a pure function of the value, so that a recomputed task agrees with the first attempt."""
    imaged = values.withColumn("_bits", order_image(col))
    shift = _range_shift(imaged, by, per_range)
    return imaged.withColumn("_range", _leading("_bits", shift)).drop("_bits"), shift


def _across(ranges: DataFrame, amount: str, fold, by: Sequence[str], shift: int, later: bool) -> DataFrame:
    """(by, _range, _0, _1, ...): ``fold`` of ``amount`` over the buckets before (``later``: after) each one, level by level.

    A level's window holds the buckets below one bucket of the level above: 65,536 rows at most.
    """
    out = ranges.select(*by, "_range")
    for k, s in enumerate(range(64 - _DIGIT, shift - 1, -_DIGIT)):
        here, above = F.shiftright("_range", s - shift), F.lit(0) if k == 0 else F.shiftright("_range", s + _DIGIT - shift)
        level = ranges.groupBy(*by, here.alias("_here"), above.alias("_above")).agg(fold(amount).alias("_a"))
        order = F.desc("_here") if later else F.col("_here")
        side = W.partitionBy(*by, "_above").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        level = level.select(*by, "_here", fold("_a").over(side).alias(f"_{k}"))
        out = join_null_safe(out.withColumn("_here", here), level, [*by, "_here"]).drop("_here")
    return out


def _levels(shift: int) -> list[str]:
    return [f"_{k}" for k in range((64 - shift) // _DIGIT)]


def _inside(col: str, by: Sequence[str]) -> W:
    return W.partitionBy(*by, "_range").orderBy(col).rowsBetween(W.unboundedPreceding, 0)


def ranked(df: DataFrame, bits: Column, ties: Sequence[Column], out: str, per_range: int = PER_RANGE) -> DataFrame:
    """Add ``out``, the place (from 0) of each row in the order of a whole number and then ``ties``; store the rows first."""
    imaged = df.withColumn("_bits", bits)
    shift = _range_shift(imaged, (), per_range)
    ranged = imaged.withColumn("_range", _leading("_bits", shift))
    sums = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in _levels(shift)], F.lit(0))
    offsets = _across(sums, "_n", F.sum, (), shift, later=False).select("_range", before.alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy("_bits", *ties)))
    return placed.join(offsets, "_range").withColumn(out, F.col("_before") + F.col("_place") - 1).drop("_range", "_bits", "_before", "_place")


def running_totals(values: DataFrame, col: str, amount: str, by: Sequence[str] = (), per_range: int = PER_RANGE) -> DataFrame:
    """Add ``cum`` (inclusive running sum of ``amount`` in value order) and ``total``.

    ``values`` holds one row per (by, value) and is read several times: store it first. The running sum is taken inside each bucket of
    values and shifted by the totals of the buckets before it, so no task sees more than one bucket of one group.
    """
    by = list(by)
    ranged, shift = _ranged(values, col, by, per_range)
    sums = ranged.groupBy(*by, "_range").agg(F.sum(amount).alias("_sum"))
    before = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in _levels(shift)], F.lit(0))
    offsets = _across(sums, "_sum", F.sum, by, shift, later=False).select(*by, "_range", before.alias("_before"))
    totals = sums.groupBy(*by).agg(F.sum("_sum").alias("total"))
    summed = ranged.withColumn("_cum", F.sum(amount).over(_inside(col, by)))
    placed = join_null_safe(summed, offsets, [*by, "_range"]).withColumn("cum", F.col("_cum") + F.col("_before"))
    placed = join_null_safe(placed, totals, by) if by else placed.withColumn("total", totals.scalar())
    return placed.drop("_range", "_cum", "_before")


def suffix_min(values: DataFrame, col: str, amount: str, out: str, by: Sequence[str] = (), per_range: int = PER_RANGE) -> DataFrame:
    """Add the smallest ``amount`` at this or any later value, split by buckets alike."""
    by = list(by)
    ranged, shift = _ranged(values, col, by, per_range)
    lows = ranged.groupBy(*by, "_range").agg(F.min(amount).alias("_low"))
    none = F.lit(None).cast("double")
    after = _across(lows, "_low", F.min, by, shift, later=True).select(*by, "_range", F.least(none, none, *_levels(shift)).alias("_after"))
    inside = W.partitionBy(*by, "_range").orderBy(F.desc(col)).rowsBetween(W.unboundedPreceding, 0)
    here = ranged.withColumn("_here", F.min(amount).over(inside))
    return join_null_safe(here, after, [*by, "_range"]).withColumn(out, F.least("_here", "_after")).drop("_range", "_here", "_after")


def _sent(wanted: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(wanted) if rows <= _BROADCAST_ROWS else wanted


def _narrowed(values: DataFrame, wanted: DataFrame, keys: Sequence[str], amount: str, hits, per_range: int) -> tuple[DataFrame, int, int]:
    """Radix rounds: (wanted buckets with what is wanted in them, their trailing bits, their number).

    ``wanted``: keys, ``_p`` (bucket), ``_c`` (values in it) and ``_want``. ``hits(hist)`` turns the buckets (with ``_before``, what lies before
    each inside its bucket above, and ``_in``) into the next wanted ones. Each round is stored: a row for each wanted bucket.
    """
    shift, wanted = 64, cut_lineage(wanted)
    while True:
        facts = wanted.agg(F.max("_c").alias("most"), F.count(F.lit(1)).alias("rows")).first()
        if (facts["most"] or 0) <= per_range or shift == 0:
            return wanted, shift, facts["rows"]
        below = values.withColumn("_p", _leading("_bits", shift)).withColumn("_q", _leading("_bits", shift - _DIGIT))
        below = join_null_safe(below, _sent(wanted.select(*keys, "_p"), facts["rows"]), [*keys, "_p"])
        hist = below.groupBy(*keys, "_p", "_q").agg(F.sum(amount).alias("_in"), F.count(F.lit(1)).alias("_c"))
        earlier = W.partitionBy(*keys, "_p").orderBy("_q").rowsBetween(W.unboundedPreceding, -1)
        hist = hist.withColumn("_before", F.coalesce(F.sum("_in").over(earlier), F.lit(0)))
        hist = join_null_safe(hist, _sent(wanted.select(*keys, "_p", "_want"), facts["rows"]), [*keys, "_p"])
        wanted, shift = cut_lineage(hits(hist)), shift - _DIGIT


def _selected(counted: DataFrame, probs: Sequence[float], keys: Sequence[str], out: str, per_range: int) -> DataFrame:
    """Order statistics around each position of (keys, _v, _n, _bits), interpolated linearly."""
    ranks = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("total") - 1)
        for side in (F.floor(position), F.ceil(position)):
            ranks.append(F.struct(F.lit(i).alias("i"), position.alias("pos"), side.cast("bigint").alias("rank")))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("total"), F.count(F.lit(1)).alias("_c"))
    wanted = sizes.select(*keys, F.lit(0).cast("bigint").alias("_p"), "_c", F.array(*ranks).alias("_want"))

    def hits(hist: DataFrame) -> DataFrame:
        held = F.filter("_want", lambda r: (F.col("_before") <= r["rank"]) & (r["rank"] < F.col("_before") + F.col("_in")))
        own = F.transform(held, lambda r: F.struct(r["i"].alias("i"), r["pos"].alias("pos"), (r["rank"] - F.col("_before")).alias("rank")))
        return hist.select(*keys, F.col("_q").alias("_p"), "_c", own.alias("_want")).filter(F.size("_want") > 0)

    wanted, shift, rows = _narrowed(counted, wanted, keys, "_n", hits, per_range)
    inside = join_null_safe(counted.withColumn("_p", _leading("_bits", shift)), _sent(wanted.drop("_c"), rows), [*keys, "_p"])
    cum = F.sum("_n").over(W.partitionBy(*keys, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked, first = inside.withColumn("cum", cum), F.col("cum") - F.col("_n")
    hit = ranked.select(*keys, "_v", F.explode(F.filter("_want", lambda r: (first <= r["rank"]) & (r["rank"] < F.col("cum")))).alias("r"))
    pairs = hit.groupBy(*keys, "r.i").agg(F.first("r.pos").alias("pos"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    frac = F.col("pos") - F.floor("pos")
    at = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise((1 - frac) * F.col("lo") + frac * F.col("hi"))
    return pairs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", at.alias("q")))), lambda s: s["q"]).alias(out))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join where NULL keys meet; the right side's keys are dropped."""
    named = right.select(*[F.col(quoted(c)).alias(f"_on_{i}" if c in on else c) for i, c in enumerate(right.columns)])
    where = {c: f"_on_{i}" for i, c in enumerate(right.columns) if c in on}
    test = reduce(lambda a, b: a & b, [F.col(quoted(c)).eqNullSafe(F.col(where[c])) for c in on])
    return left.join(named, test).drop(*where.values())


def counted_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, _i, _v, _n, _bits): how often each value of column number ``_i`` occurs, NULL included; one pass, then a stored table."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), number(c).alias("v")) for i, c in enumerate(cols)])
    long = df.select(*[F.col(quoted(b)) for b in by], F.explode(pairs).alias("_p"))
    counted = long.groupBy(*[quoted(b) for b in by], F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(counted.withColumn("_bits", order_image("_v")))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), per_range: int = PER_RANGE
) -> DataFrame:
    """Linear-interpolated quantiles as ``array<double>``, one column per input column; NULL for a group without values."""
    by, cols = list(by), list(cols)
    counted = counted_values(df, cols, by)
    found = _selected(counted.filter(F.col("_v").isNotNull()), probs, [*by, "_i"], "_q", per_range)
    none = F.lit(None).cast("array<double>").alias("_q")
    every = counted.select(*by, F.lit(-1).alias("_i"), none).distinct().unionByName(found.select(*by, "_i", "_q"))  # every group has its row
    return every.groupBy(*by).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(c) for i, c in enumerate(cols)])


def moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sample sd and median of a score."""
    c = number(col)
    base = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    med = exact_quantiles(df, [col], [0.5], by).withColumnRenamed(col, "_q")
    if by:
        return base.join(med, list(by)).withColumn("median", F.col("_q")[0]).drop("_q")
    return base.withColumn("median", med.scalar()[0])


def as_literal(value, kind) -> Column:
    """A driver-side statistic (number or short list of numbers) as a column."""
    if isinstance(value, list):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value).cast(kind)


def with_stats(df: DataFrame, stats: DataFrame, by: Sequence[str], fn) -> DataFrame:
    """Apply ``fn(df, get)`` where ``get(name)`` is a group statistic as a column.

    Without groups the single row of statistics is fetched and enters the plan
    as constants, so every later query on the result reuses it; with groups
    the statistics are joined on the group keys.
    """
    by = list(by)
    if not by:
        row = stats.first()
        return fn(df, lambda name: as_literal(row[name], stats.schema[name].dataType))
    packed = stats.select(*by, F.struct(*[F.col(quoted(c)) for c in stats.columns if c not in by]).alias("_stats"))
    return fn(df.join(packed, by, "left"), lambda name: F.col("_stats")[name]).drop("_stats")


def score_stats(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """One row: mean, sample sd and the quantiles ``q`` of a score."""
    q = exact_quantiles(df, [col], probs)
    return df.agg(F.avg(number(col)).alias("mean"), F.stddev_samp(number(col)).alias("sd")).withColumn("q", q.scalar())


def zscore(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """(x - mean) / sample sd over the whole frame: score first, join later."""
    c = number(col)
    stats = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("sd"))
    return with_stats(df, stats, by, lambda d, s: d.withColumn(out, F.try_divide(c - s("mean"), s("sd"))))


def bin_of(c: Column, edges: Column, q: int) -> Column:
    """Right-closed quantile bin 1..q, lowest edge included, equal edges merged."""
    out = F.when(c.isNull() | edges.isNull(), F.lit(None).cast("int"))
    label = F.lit(0)
    for i in range(1, q):
        step = (edges[i] > edges[i - 1]).cast("int")
        label = label + step
        out = out.when((c <= edges[i]) & (step == 1), label)
    return out.otherwise(label + (edges[q] > edges[q - 1]).cast("int")).cast("int")


def qcut(df: DataFrame, col: str, q: int, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Quantile bins from exact edges; tied values always share a bin (unlike ``ntile``)."""
    edges = exact_quantiles(df, [col], [i / q for i in range(q + 1)], by).withColumnRenamed(col, "edges")
    return with_stats(df, edges, by, lambda d, s: d.withColumn(out, bin_of(number(col), s("edges"), q)))


def median_split(
    df: DataFrame, col: str, out: str, by: Sequence[str] = (), null_as_low: bool = True, strict: bool = False
) -> DataFrame:
    """1.0 at or above the median (``strict``: above). A missing score counts as
    0.0 unless ``null_as_low`` is off."""
    med = exact_quantiles(df, [col], [0.5], by).withColumnRenamed(col, "med")
    c = number(col)

    def flag(d, s):
        hit = (c > s("med")[0]) if strict else (c >= s("med")[0])
        hit = hit.cast("double")
        return d.withColumn(out, F.coalesce(hit, F.lit(0.0)) if null_as_low else hit)

    return with_stats(df, med, by, flag)


def weighted_quantile(
    df: DataFrame, col: str, weight: str, q: float = 0.5, by: Sequence[str] = (), per_range: int = PER_RANGE
) -> DataFrame:
    """First value, in order, whose cumulative weight reaches ``q`` of the total."""
    by = list(by)
    c, w = number(col), number(weight)
    kept = df.filter(c.isNotNull() & w.isNotNull()).select(*by, c.alias("_v"), w.alias("_w"))
    values = cut_lineage(kept.groupBy(*by, "_v").agg(F.sum("_w").alias("_w")).withColumn("_bits", order_image("_v")))
    goal = F.struct(F.lit(0.0).alias("before"), (as_lit(q) * F.col("total")).alias("goal"), F.col("total").alias("total"))
    sizes = values.groupBy(*by).agg(F.sum("_w").alias("total"), F.count(F.lit(1)).alias("_c"))
    wanted = sizes.select(*by, F.lit(0).cast("bigint").alias("_p"), "_c", goal.alias("_want"))

    def hits(hist: DataFrame) -> DataFrame:
        """The first bucket whose end reaches the goal; the last one if rounding keeps all below it."""
        before = F.col("_want.before") + F.col("_before")
        own = F.struct("_q", F.struct(before.alias("before"), F.col("_want.goal").alias("goal"), F.col("_want.total").alias("total")).alias("_want"), "_c")
        first = F.min(F.when(before + F.col("_in") >= F.col("_want.goal"), own))
        chosen = hist.groupBy(*by, "_p").agg(F.coalesce(first, F.max(own)).alias("h"))
        return chosen.select(*by, F.col("h._q").alias("_p"), "h._c", "h._want")

    wanted, shift, rows = _narrowed(values, wanted, by, "_w", hits, per_range)
    inside = join_null_safe(values.withColumn("_p", _leading("_bits", shift)), _sent(wanted.drop("_c"), rows), [*by, "_p"])
    cum = F.col("_want.before") + F.sum("_w").over(W.partitionBy(*by, "_p").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    ranked = inside.withColumn("cum", cum)
    reached = F.when(F.col("cum") >= F.col("_want.goal"), F.col("_v"))
    return ranked.groupBy(*by).agg(
        F.coalesce(F.min(reached), F.max("_v")).alias("quantile"), F.first("_want.total").alias("sum_weights")
    )
