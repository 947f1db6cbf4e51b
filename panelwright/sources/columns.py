"""Column resolution and input contracts; no job is started here."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from panelwright.functions.codes import quoted, to_num


def resolve(df: DataFrame, *candidates: str) -> str | None:
    """First candidate name present in the frame (exact match), else None."""
    have = set(df.columns)
    return next((c for c in candidates if c in have), None)


def require_columns(df: DataFrame, cols: Sequence[str], what: str = "input") -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"[{what}] missing columns: {', '.join(missing)}")
    return df


def numeric(df: DataFrame, *candidates: str) -> Column | None:
    """Numeric reading of the first candidate column, or None when absent."""
    name = resolve(df, *candidates)
    return None if name is None else to_num(F.col(quoted(name)))


def unique_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Repeated or missing key values with their row counts (empty when clean)."""
    counts = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))
    null_key = F.lit(False)
    for k in key:
        null_key = null_key | F.col(quoted(k)).isNull()
    return counts.filter((F.col("n_rows") > 1) | null_key)


@dataclass
class Contract:
    """A frame whose key and columns are counted while something else reads it, and what was counted."""

    df: DataFrame
    observation: Observation
    key: list[str]
    columns: list[str]
    absent: list[str]

    def violations(self) -> dict[str, int]:
        """rows, null_keys, repeated_keys (about, from a sketch: exact to some per cent), missing_<column> values; absent columns miss in every row.

        Waits for the first action on ``df``.
        """
        got = self.observation.get
        rows, nulls = got["rows"], got["null_keys"]
        repeated = max(0, rows - nulls - (got["distinct_keys"] or 0))
        told = {"rows": rows, "null_keys": nulls, "repeated_keys": repeated}
        told |= {f"missing_{c}": got[f"missing_{i}"] for i, c in enumerate(self.columns)}
        return told | {f"missing_{c}": rows for c in self.absent}


def observed(df: DataFrame, key: Sequence[str], columns: Sequence[str] = ()) -> Contract:
    """Count violations of the key and of required columns in the same job that writes or aggregates the frame.

    The counts are combined like any partial aggregate (keys by a mergeable sketch of 2^16 registers), so no row moves for them.
    """
    key, have = list(key), [c for c in columns if c in df.columns]
    no_key = reduce(lambda a, b: a | b, [F.col(quoted(k)).isNull() for k in key])
    hashed = F.when(~no_key, F.xxhash64(*[F.col(quoted(k)) for k in key]))
    seen = Observation()
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(no_key).alias("null_keys"), F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(16))).alias("distinct_keys"),
        *[F.count_if(F.col(quoted(c)).isNull()).alias(f"missing_{i}") for i, c in enumerate(have)],
    )
    return Contract(counted, seen, key, have, [c for c in columns if c not in df.columns])
