"""From raw survey waves to typed tables: one ``select`` per wave."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.codes import (
    all_of_strict, body_mass_index, multiselect_status, recode, reverse_code, row_sum, threshold,
)
from panelwright.operators.quantiles import bin_of, score_stats, with_stats
from panelwright.plans import codebook as cb
from panelwright.sources.columns import numeric, require_columns

log = logging.getLogger(__name__)


def _or_missing(c: Column | None) -> Column:
    return F.lit(None).cast("double") if c is None else c


def _coded(df: DataFrame, rule) -> Column:
    name, candidates, ones, zeros = rule
    c = numeric(df, *candidates)
    return _or_missing(None if c is None else recode(c, ones, zeros)).alias(name)


def _item(df: DataFrame, question: str, i: int) -> Column | None:
    return numeric(df, f"{question}.{i}", f"{question}_{i}")


def baseline(df: DataFrame) -> DataFrame:
    """Key and the twelve covariates of the first wave."""
    require_columns(df, [cb.KEY], "baseline wave")
    cols = {rule[0]: _coded(df, rule) for rule in cb.BASELINE_CODES}
    cols["age"] = _or_missing(numeric(df, *cb.AGE))

    def both(a, b, make):
        x, y = numeric(df, *a), numeric(df, *b)
        return _or_missing(None if x is None or y is None else make(x, y))

    cols["heavy_drinking"] = both(
        cb.DRINK_FREQUENCY, cb.DRINK_AMOUNT, lambda f, a: all_of_strict([f >= 5, a >= 3], [f, a])
    )
    cols["low_physical_activity"] = both(
        cb.WALKING, cb.VIGOROUS, lambda w, v: all_of_strict([w <= 2, v == 1], [w, v])
    )
    cols["bmi"] = both(cb.HEIGHT_CM, cb.WEIGHT_KG, lambda h, w: body_mass_index(h, w, *cb.BMI_RANGE))
    return df.select(cb.KEY, *[cols[c].alias(c) for c in cb.COVARIATES])


def exposure(df: DataFrame) -> DataFrame:
    """Key, score, z-score, quantile bins and median split of the second wave.

    Cut-offs come from the whole wave, before any join.
    """
    require_columns(df, [cb.KEY], "exposure wave")
    items = {i: _item(df, cb.SCORE_QUESTION, i) for i in cb.SCORE_ITEMS}
    found = {i: c for i, c in items.items() if c is not None}
    if len(found) < len(items):
        log.warning("only %d score items found (expected %d)", len(found), len(items))
    if not found:
        return df.select(cb.KEY, *[F.lit(None).cast("double").alias(c) for c in (cb.SCORE, cb.SCORE_Z)],
                         *[F.lit(None).cast("int").alias(c) for c in (cb.SCORE_QUARTILE, cb.SCORE_TERTILE)],
                         F.lit(None).cast("double").alias(cb.SCORE_HIGH))
    scored = [reverse_code(c, cb.SCORE_TOP) if i in cb.SCORE_REVERSED else c for i, c in found.items()]
    out = df.select(cb.KEY, row_sum(scored, cb.SCORE_MIN_ANSWERED).alias(cb.SCORE))
    c = F.col(cb.SCORE)
    quarters, thirds = [0.0, 0.25, 0.5, 0.75, 1.0], [0.0, 1 / 3, 2 / 3, 1.0]
    cuts = score_stats(out, cb.SCORE, [*quarters, *thirds])

    def derive(d, s):
        q = s("q")
        return d.select(
            cb.KEY, c, F.try_divide(c - s("mean"), s("sd")).alias(cb.SCORE_Z),
            bin_of(c, F.slice(q, 1, 5), 4).alias(cb.SCORE_QUARTILE), bin_of(c, F.slice(q, 6, 4), 3).alias(cb.SCORE_TERTILE),
            F.coalesce((c >= q[2]).cast("double"), F.lit(0.0)).alias(cb.SCORE_HIGH),
        )

    return with_stats(out, cuts, (), derive)


def _infection(df: DataFrame) -> Column:
    def flags(item, options):
        cols = [numeric(df, f"{cb.INFECTION_QUESTION}.{item}-{o}") for o in options]
        return [c for c in cols if c is not None]

    recent = [c for i in cb.INFECTION_ITEMS for c in flags(i, cb.INFECTION_RECENT)]
    past = [c for i in cb.INFECTION_ITEMS for c in flags(i, cb.INFECTION_NOT_RECENT)]
    if not recent and not past:
        log.error("no infection columns found")
        return _or_missing(None)
    groups = [flags(i, [*cb.INFECTION_RECENT, *cb.INFECTION_NOT_RECENT]) for i in cb.INFECTION_ITEMS]
    return multiselect_status(recent, past, groups)


def outcomes(df: DataFrame) -> DataFrame:
    """Key and the 0/1 outcomes of the third wave."""
    require_columns(df, [cb.KEY], "outcome wave")
    cols = [_coded(df, rule) for rule in (cb.HOSPITAL, cb.COVID_VACCINE, cb.FLU_VACCINE)]
    cols.append(_infection(df).alias(cb.INFECTION))
    for name, i in cb.DISEASES.items():
        c = _item(df, "Q89", i)
        cols.append(_or_missing(None if c is None else recode(c, [3, 4, 5], [1, 2])).alias(name))
    for name, i in cb.SYMPTOMS.items():
        c = _item(df, "Q26", i)
        cols.append(_or_missing(None if c is None else threshold(c, ">=", 3)).alias(name))
    return df.select(cb.KEY, *cols)
