"""Multiple-testing control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.codes import as_col, nan_to_null
from panelwright.operators.quantiles import PER_RANGE, running_totals, suffix_min
from panelwright.session import cut_lineage


def fdr_bh(
    df: DataFrame, p: str = "p", family: Sequence[str] = (), alpha: float = 0.05, per_range: int = PER_RANGE
) -> DataFrame:
    """Step-up q-values and reject flags.

    Tests are first merged by equal p (equal p-values share a q-value), then ranked per family over buckets of p's
    leading bits. NaN is no test, as NULL is.
    """
    family = list(family)
    value = nan_to_null(as_col(p))
    by_p = cut_lineage(df.filter(value.isNotNull()).groupBy(*family, value.alias(p)).agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_totals(by_p, p, "_n", family, per_range).withColumn("_raw", F.col(p) * F.col("total") / F.col("cum"))
    lowest = suffix_min(ranked, p, "_raw", "_q", family, per_range)
    q = lowest.select(*family, p, F.least(F.col("_q"), F.lit(1.0)).alias("FDR_q"))
    out = df.join(q, [*family, p], "left")
    return out.select(*df.columns, "FDR_q", (F.col("FDR_q") <= alpha).alias("FDR_reject"))


def bonferroni(df: DataFrame, p: str = "p", family: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Threshold alpha / m and flag, m being the size of the family."""
    family = list(family)
    sizes = df.groupBy(*family).agg((F.lit(alpha) / F.count(F.lit(1))).alias("Bonf_threshold"))
    out = df.join(sizes, family, "left") if family else df.withColumn("Bonf_threshold", sizes.scalar())
    return out.select(*df.columns, "Bonf_threshold", (as_col(p) < F.col("Bonf_threshold")).alias("Bonf_reject"))
