"""Pooling across imputations and effect measures on estimate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.codes import as_col
from panelwright.functions.tails import chi2_sf, normal_p

# Fixed value: normal quantile used for every 95% interval.
Z95 = 1.96


def rubin_pool(est: DataFrame, by: Sequence[str], b: str = "b", se: str = "se") -> DataFrame:
    """Combine estimates over imputations: within + (1 + 1/m) between variance."""
    pooled = est.groupBy(*by).agg(
        F.count(b).alias("m"),
        F.avg(b).alias("beta_bar"),
        F.avg(F.col(se) * F.col(se)).alias("W"),
        F.coalesce(F.var_samp(b), F.lit(0.0)).alias("B"),
    )
    return pooled.withColumn("T", F.col("W") + (1 + 1 / F.col("m")) * F.col("B")).withColumn(
        "se_bar", F.sqrt(F.greatest(F.col("T"), F.lit(0.0)))
    )


def risk_ratio(pooled: DataFrame, with_p: bool = True) -> DataFrame:
    b, se = F.col("beta_bar"), F.col("se_bar")
    out = (
        pooled.withColumn("RR", F.exp(b))
        .withColumn("LCL", F.exp(b - Z95 * se))
        .withColumn("UCL", F.exp(b + Z95 * se))
    )
    return out.withColumn("p", wald_p("beta_bar", "se_bar")) if with_p else out


def wald_p(b: str, se: str):
    z = F.when(F.col(se) > 0, F.col(b) / F.col(se)).otherwise(F.lit(1e6))
    return normal_p(z)


def percent_difference(pooled: DataFrame) -> DataFrame:
    """Pooled risk difference and interval in percentage points."""
    b, se = F.col("beta_bar"), F.col("se_bar")
    return pooled.select(
        *[c for c in pooled.columns if c not in ("m", "beta_bar", "W", "B", "T", "se_bar")],
        (b * 100).alias("aRD"),
        ((b - Z95 * se) * 100).alias("aRD_LCL"),
        ((b + Z95 * se) * 100).alias("aRD_UCL"),
    )


def _e(x):
    return x + F.sqrt(x * (x - 1))


def e_value(df: DataFrame, rr: str = "RR", lcl: str = "LCL", ucl: str = "UCL") -> DataFrame:
    """E-values of the point and both limits; protective ratios are inverted and
    their limits swapped; a limit at or under 1 gives 1."""
    r, lo, hi = as_col(rr), as_col(lcl), as_col(ucl)
    inverse = lambda v: F.when(v > 0, F.try_divide(F.lit(1.0), v)).otherwise(F.lit(float("inf")))
    point = F.when(r < 1, F.try_divide(F.lit(1.0), r)).otherwise(r)
    low = F.when(r < 1, inverse(hi)).otherwise(lo)
    high = F.when(r < 1, inverse(lo)).otherwise(hi)
    limit = lambda v: F.when(v > 1, _e(v)).when(v.isNotNull(), F.lit(1.0))
    return (
        df.withColumn("E_value_point", _e(point))
        .withColumn("E_value_CI_lower", limit(low))
        .withColumn("E_value_CI_upper", limit(high))
    )


def cochran_q(df: DataFrame, by: Sequence[str], rr: str = "RR", lcl: str = "LCL", ucl: str = "UCL",
              with_p: bool = True) -> DataFrame:
    """Heterogeneity of log ratios across strata, for groups of at least two."""
    width = (F.log(as_col(ucl)) - F.log(as_col(lcl))) / 3.92
    rows = df.withColumn("_l", F.log(as_col(rr))).withColumn("_w", 1 / (width * width))
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("_w").alias("_sw"),
        F.sum(F.col("_w") * F.col("_l")).alias("_swl"),
        F.sum(F.col("_w") * F.col("_l") * F.col("_l")).alias("_swll"),
    ).filter(F.col("k") >= 2)
    out = sums.select(
        *by, "k", (F.col("_swl") / F.col("_sw")).alias("pooled_log_RR"),
        F.greatest(F.col("_swll") - F.col("_swl") * F.col("_swl") / F.col("_sw"), F.lit(0.0)).alias("Q"),
        (F.col("k") - 1).alias("df"),
    )
    return out.withColumn("p_heterogeneity", chi2_sf("Q", F.col("df").cast("double"))) if with_p else out
