"""Recodes of coded answers as native column expressions.

Missing is always NULL. NaN never survives :func:`to_num`, so aggregates and
comparisons downstream see one representation of "missing" only.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, functions as F

# Fixed value: what counts as a number in a text column.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_col(c: Column | str) -> Column:
    return F.col(quoted(c)) if isinstance(c, str) else c


def to_num(c: Column | str) -> Column:
    """Text to double; anything that is not a plain number becomes NULL."""
    text = as_col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def recode(c: Column | str, ones: Iterable, zeros: Iterable | str) -> Column:
    """1.0 for codes in ``ones``; 0.0 for codes in ``zeros`` or, with
    ``zeros="other_non_null"``, for every other answered code; else NULL."""
    c = as_col(c)
    hit = F.when(c.isin(*ones), 1.0)
    rest = c.isNotNull() if zeros == "other_non_null" else c.isin(*zeros)
    return hit.when(rest, 0.0)


def threshold(c: Column | str, op: str, cut: float) -> Column:
    c = as_col(c)
    test = {">=": c >= cut, ">": c > cut, "<=": c <= cut, "<": c < cut, "=": c == cut}[op]
    return test.cast("double")


def all_of_strict(conditions: Sequence[Column], inputs: Sequence[Column | str]) -> Column:
    """Conjunction that is NULL as soon as any input is NULL.

    Plain SQL would let ``false AND NULL`` collapse to false.
    """
    answered = reduce(and_, [as_col(i).isNotNull() for i in inputs])
    return F.when(answered, reduce(and_, conditions).cast("double"))


def clip(c: Column | str, lo, hi) -> Column:
    """Clamp that keeps NULL (``greatest``/``least`` alone would skip it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, as_lit(lo)), as_lit(hi)))


def as_lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def body_mass_index(height_cm: Column | str, weight_kg: Column | str, lo=10.0, hi=60.0) -> Column:
    """kg / m^2 clamped to [lo, hi]; a zero height with a positive weight is an
    infinite ratio and therefore ``hi``."""
    h, w = as_col(height_cm) / 100.0, as_col(weight_kg)
    ratio = F.try_divide(w, h * h)
    return F.when((h == 0) & (w > 0), as_lit(hi)).when((h == 0) & (w < 0), as_lit(lo)).otherwise(clip(ratio, lo, hi))


def reverse_code(c: Column | str, hi: float) -> Column:
    return F.lit(float(hi)) - as_col(c)


def row_sum(cols: Sequence[Column | str], min_count: int) -> Column:
    """Sum over answered items, NULL when fewer than ``min_count`` are answered."""
    cs = [as_col(c) for c in cols]
    answered = reduce(add, [c.isNotNull().cast("int") for c in cs])
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cs])
    return F.when(answered >= min_count, total)


def multiselect_status(
    positive: Sequence[Column | str],
    negative: Sequence[Column | str],
    item_groups: Sequence[Sequence[Column | str]],
) -> Column:
    """1 if any positive flag is set, else 0 if any negative flag is set; NULL
    for everyone who left one of the item groups without any flag."""

    def any_flag(cols):
        if not cols:
            return F.lit(False)
        return reduce(or_, [F.coalesce(as_col(c) == 1, F.lit(False)) for c in cols])

    groups = [any_flag(g) for g in item_groups if g]
    complete = reduce(and_, groups) if groups else F.lit(True)
    return F.when(complete & any_flag(positive), 1.0).when(complete & any_flag(negative), 0.0)


def cut(c: Column | str, edges: Sequence[float], labels: Sequence[int] | None = None,
        include_lowest: bool = False) -> Column:
    """Right-closed bins ``(edges[i], edges[i+1]]``; NULL outside all bins."""
    c = as_col(c)
    labels = list(labels) if labels is not None else list(range(len(edges) - 1))
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, (lo, hi, label) in enumerate(zip(edges, edges[1:], labels)):
        above = (c >= as_lit(lo)) if (include_lowest and i == 0) else (c > as_lit(lo))
        out = out.when(above & (c <= as_lit(hi)), F.lit(label))
    return out


def bin_indicator(c: Column | str, level, null_in_reference: bool = True) -> Column:
    """1.0 in the bin, 0.0 elsewhere. With ``null_in_reference`` an unbinned row
    joins the reference group (parity default), otherwise it stays NULL."""
    flag = (as_col(c) == F.lit(level)).cast("double")
    return F.coalesce(flag, F.lit(0.0)) if null_in_reference else flag


def product(a: Column | str, b: Column | str) -> Column:
    return as_col(a) * as_col(b)


def at_least(c: Column | str, value: float, null_as_low: bool = True) -> Column:
    flag = (as_col(c) >= F.lit(float(value))).cast("double")
    return F.coalesce(flag, F.lit(0.0)) if null_as_low else flag


def tier(var: Column | str, exposures: Sequence[str], outcome_mark: str = "_23") -> Column:
    """0 baseline, 1 exposure, 2 outcome, told apart by variable name."""
    var = as_col(var)
    return F.when(var.isin(*exposures), 1).when(F.contains(var, F.lit(outcome_mark)), 2).otherwise(0)
