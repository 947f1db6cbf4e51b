"""Display strings next to the numeric columns they are made from.

Rounding follows the JVM (half-up on the decimal value); compare the numeric
columns, not these strings.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from panelwright.functions.codes import as_col


def fmt_ci(lcl: Column | str, ucl: Column | str) -> Column:
    lcl, ucl = as_col(lcl), as_col(ucl)
    return F.when(lcl.isNotNull() & ucl.isNotNull(), F.format_string("%.2f-%.2f", lcl, ucl))


def fmt_risk(risk: Column | str, lcl: Column | str, ucl: Column | str) -> Column:
    risk, lcl, ucl = as_col(risk), as_col(lcl), as_col(ucl)
    return F.when(risk.isNull(), F.lit(None).cast("string")).when(
        lcl.isNull(), F.format_string("%.1f", risk)
    ).otherwise(F.format_string("%.1f (%.1f-%.1f)", risk, lcl, ucl))


def fmt_count_pct(n: Column | str, pct: Column | str) -> Column:
    n, pct = as_col(n), as_col(pct)
    return F.when(pct.isNull(), F.lit("NA")).otherwise(
        F.format_string("%,d (%.1f)", n.cast("bigint"), pct)
    )


def fmt_mean_sd(mean: Column | str, sd: Column | str) -> Column:
    mean, sd = as_col(mean), as_col(sd)
    return F.when(mean.isNull(), F.lit("NA")).otherwise(F.format_string("%.1f ± %.1f", mean, sd))


def fmt_p(p: Column | str) -> Column:
    p = as_col(p)
    return F.when(p.isNull(), F.lit("NA")).when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


def fmt_smd(smd: Column | str) -> Column:
    smd = as_col(smd)
    return F.when(smd.isNull(), F.lit("NA")).otherwise(F.format_string("%.3f", smd))


def fmt_pct(pct: Column | str) -> Column:
    pct = as_col(pct)
    return F.when(pct.isNotNull(), F.format_string("%.1f%%", pct))


def fmt_n(n: Column | str) -> Column:
    return F.format_string("(n=%,d)", as_col(n).cast("bigint"))
