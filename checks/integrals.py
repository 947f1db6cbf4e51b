"""Tail probabilities in SQL by Simpson's rule, to check the operators' own."""

from __future__ import annotations


def _simpson(density: str, start: str, width: str, steps: int = 8000) -> str:
    """Integral of ``density`` (in x) over [start, start + width]."""
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(SELECT sum({weight} * ({density})) * ({width}) / {steps} / 3 FROM (SELECT i, {start} + ({width}) * i / {steps}.0::DOUBLE AS x FROM range({steps + 1}) r(i)))"


def normal_tail(z: str) -> str:
    """Two-sided normal tail."""
    return _simpson("2 * exp(-0.5 * x * x) / sqrt(2 * pi())", f"abs({z})", "14.0")


def student_tail(t: str, df: str) -> str:
    """Two-sided t tail; for degrees of freedom large enough that nothing is left 60 further out."""
    return _simpson(f"2 * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2) - ({df} + 1) / 2 * ln(1 + x * x / {df})) / sqrt({df} * pi())", f"abs({t})", "60.0")


def chi2_tail(q: str, df: str) -> str:
    """Upper chi-square tail, two or more degrees of freedom."""
    return _simpson(f"CASE WHEN x > 0 THEN exp(({df} / 2 - 1) * ln(x) - x / 2 - {df} / 2 * ln(2) - lgamma({df} / 2)) ELSE 0 END", q, f"(200 + 20 * sqrt(2 * {df}))")
