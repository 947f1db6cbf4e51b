"""Inverse-probability-of-censoring weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.codes import quoted, to_num
from panelwright.operators.glm import GlmBatch, ModelSpec
from panelwright.operators.panel import membership_flag
from panelwright.operators.quantiles import exact_quantiles, number, with_stats
from panelwright.operators.sums import keep_for_passes
from panelwright.session import cut_lineage

# Probability clip and the trimming percentiles of followed rows.
CLIP = 1e-6
TRIM = (0.01, 0.99)


def median_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace missing values by the exact column median."""
    med = exact_quantiles(df, cols, [0.5])
    return with_stats(
        df, med, (), lambda d, s: d.withColumns({c: F.coalesce(number(c), s(c)[0]) for c in cols})
    )


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population sd; a constant column is only centred."""
    stats = df.agg(
        *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(quoted(c)).alias(f"s{i}") for i, c in enumerate(cols)],
    )

    def scaled(d, s):
        sd = lambda i: F.when(s(f"s{i}") == 0, F.lit(1.0)).otherwise(s(f"s{i}"))
        return d.withColumns({c: (F.col(quoted(c)) - s(f"m{i}")) / sd(i) for i, c in enumerate(cols)})

    return with_stats(df, stats, (), scaled)


def stabilised(p: Column, p_bar: Column, followed: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
    return F.when(followed == 1, p_bar / p).otherwise((1 - p_bar) / (1 - p))


def trim(df: DataFrame, weight: str, followed: str, out: str, probs: tuple[float, float] = TRIM) -> DataFrame:
    """Clip all weights to quantiles of the followed rows' weights."""
    bounds = exact_quantiles(df.filter(F.col(followed) == 1), [weight], probs).withColumnRenamed(weight, "q")
    return with_stats(
        df, bounds, (), lambda d, s: d.withColumn(out, F.least(F.greatest(F.col(weight), s("q")[0]), s("q")[1]))
    )


def ipcw(
    wave: DataFrame, followed_ids: DataFrame, key: Sequence[str], covars: Sequence[str],
    weight: str = "ipcw_weight", flag: str = "complete3", penalty: float = 1.0, compress: bool = False,
) -> DataFrame:
    """Key, trimmed stabilised weight and follow-up flag for the first wave.

    The follow-up model is logistic on median-filled, standardised covariates
    with an L2 penalty of ``penalty`` (intercept unpenalised). Without any
    covariate present every weight is 1. Raw answers rarely repeat as a whole,
    so rows are not merged by default.
    """
    covars = [c for c in covars if c in wave.columns]
    flagged = membership_flag(wave.select(*key, *[quoted(c) for c in covars]), followed_ids, key, flag)
    if not covars:
        return flagged.select(*key, F.lit(1.0).alias(weight), flag)
    names = [f"c{i}" for i in range(len(covars))]
    raw = flagged.select(*key, flag, *[to_num(F.col(quoted(c))).alias(n) for c, n in zip(covars, names)])
    raw = keep_for_passes(raw)  # read by the median, moment and model passes
    med = exact_quantiles(raw, names, [0.5]).first()
    names = [n for n in names if med[n] is not None]
    ready = standardise(raw.fillna({n: med[n][0] for n in names}), names)
    batch = GlmBatch(ready, [ModelSpec("followed", flag, tuple(names))], family="binomial", ridge=penalty, compress=compress)
    fit = batch.fit()[0]
    batch.close()
    if not fit.usable:
        raise ValueError(f"follow-up model: {fit.status}")
    eta = F.lit(float(fit.beta[0]))
    for b, n in zip(fit.beta[1:], names):
        eta = eta + F.lit(float(b)) * F.col(n)
    scored = cut_lineage(ready.select(
        *key, flag,
        stabilised(1 / (1 + F.exp(-eta)), F.lit(fit.events / fit.n), F.col(flag)).alias("_raw"),
    ))
    raw.unpersist()
    return trim(scored, "_raw", flag, weight).select(*key, weight, flag)
