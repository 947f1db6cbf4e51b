"""Cubic spline dose-response of a weighted Poisson model."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.codes import clip, quoted
from panelwright.operators.glm import GlmBatch, ModelSpec
from panelwright.operators.quantiles import exact_quantiles, qcut

Z95 = 1.96
CURVE_SCHEMA = "x double, RR double, LCL double, UCL double, status string"


def knot_vector(interior: Sequence[float], lo: float, hi: float) -> list[float]:
    return [lo] * 4 + [float(k) for k in interior] + [hi] * 4


def basis_columns(x: Column, interior: Sequence[float], lo: float, hi: float) -> list[Column]:
    """Cubic B-spline columns on [lo, hi] without the first one.

    Without interior knots these are the Bernstein terms 3u(1-u)^2, 3u^2(1-u), u^3.
    """
    if not interior:
        u = (x - lo) / (hi - lo)
        v = 1 - u
        return [3 * u * v * v, 3 * u * u * v, u * u * u]
    t = knot_vector(interior, lo, hi)
    last = max(i for i in range(len(t) - 1) if t[i] < t[i + 1])
    level = [
        ((x >= t[i]) & ((x <= t[i + 1]) if i == last else (x < t[i + 1]))).cast("double") if t[i] < t[i + 1] else None
        for i in range(len(t) - 1)
    ]
    for d in range(1, 4):
        nxt = []
        for i in range(len(t) - d - 1):
            parts = []
            if level[i] is not None and t[i + d] > t[i]:
                parts.append((x - t[i]) / (t[i + d] - t[i]) * level[i])
            if level[i + 1] is not None and t[i + d + 1] > t[i + 1]:
                parts.append((t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * level[i + 1])
            nxt.append(sum(parts[1:], parts[0]) if parts else None)
        level = nxt
    return [b if b is not None else F.lit(0.0) for b in level[1:]]


def spline_terms(df: DataFrame, x: str, lo: float, hi: float, df_spline: int = 3, prefix: str = "bs") -> tuple[DataFrame, list[str], list[float]]:
    """Add clipped spline columns; interior knots at even quantiles of the clipped x."""
    clipped = df.withColumn(f"{prefix}_x", clip(F.col(quoted(x)).cast("double"), lo, hi))
    interior: list[float] = []
    if df_spline > 3:
        count = df_spline - 3
        probs = [(i + 1) / (count + 1) for i in range(count)]
        interior = list(exact_quantiles(clipped, [f"{prefix}_x"], probs).first()[0])
    cols = basis_columns(F.col(f"{prefix}_x"), interior, lo, hi)
    names = [f"{prefix}{i + 1}" for i in range(len(cols))]
    return clipped.withColumns(dict(zip(names, cols))), names, interior


def spline_rr(
    df: DataFrame, outcome: str, x: str, weight: str, adjust: Sequence[str], lo: float = 13, hi: float = 52,
    ref: float = 29, df_spline: int = 3, min_n: int = 100, step: float = 1.0, compress: bool = False,
) -> DataFrame:
    """Ratio at every grid point against ``ref``. Covariates cancel in the
    contrast, so only the spline block of the covariance matters. With fewer
    than ``min_n`` complete rows the curve is empty but for its status."""
    spark = df.sparkSession
    needed = F.col(quoted(outcome)).isNotNull() & F.col(quoted(x)).isNotNull() & F.col(quoted(weight)).isNotNull()
    for a in adjust:
        needed = needed & F.col(quoted(a)).isNotNull()
    wide, names, interior = spline_terms(df.filter(needed), x, lo, hi, df_spline)
    batch = GlmBatch(wide, [ModelSpec("spline", outcome, (*names, *adjust))], weight, compress=compress, min_n=min_n)
    fit = batch.fit()[0]
    batch.close()
    if not fit.usable:
        return spark.createDataFrame([(None, None, None, None, fit.status)], CURVE_SCHEMA)
    k = len(names)
    b, v = fit.beta[1 : k + 1], fit.cov[1 : k + 1, 1 : k + 1]
    points = np.arange(0, round((hi - lo) / step) + 1) * step + lo
    grid = spark.createDataFrame([(float(p),) for p in points], "x double")
    at = lambda c: basis_columns(c, interior, lo, hi)
    diff = [a - r for a, r in zip(at(F.col("x")), at(F.lit(float(ref))))]
    log_rr = sum((d * float(c) for d, c in zip(diff, b)), F.lit(0.0))
    var = sum((diff[i] * diff[j] * float(v[i, j]) for i in range(k) for j in range(k)), F.lit(0.0))
    se = F.sqrt(F.greatest(var, F.lit(0.0)))
    return grid.select(
        "x", F.exp(log_rr).alias("RR"), F.exp(log_rr - Z95 * se).alias("LCL"), F.exp(log_rr + Z95 * se).alias("UCL"),
        F.lit(fit.status).alias("status"),
    )


def quantile_means(df: DataFrame, outcome: str, x: str, q: int = 4) -> DataFrame:
    """Fallback curve: plain mean of score and outcome per quantile bin."""
    kept = df.filter(F.col(quoted(outcome)).isNotNull() & F.col(quoted(x)).isNotNull())
    return qcut(kept, x, q, "bin").groupBy("bin").agg(
        F.avg(quoted(x)).alias("mean_x"), F.avg(quoted(outcome)).alias("mean_y"), F.count(F.lit(1)).alias("n")
    )
