"""Wave joins (heavy keys too), follow-up flags, listwise deletion and size gates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.codes import quoted
from panelwright.session import cut_lineage

_BLOCK_ROWS, _PARTITION_ROWS = 1000, 200_000  # of a heavy key's rows in skewed_join


def panel_join(frames: Sequence[DataFrame], key: Sequence[str], how: str = "inner") -> DataFrame:
    """Join the waves on one key. Every join uses the same key, so the output
    partitioning of the first serves the next. NULL keys never match."""
    return reduce(lambda a, b: a.join(b, list(key), how), frames)


def _key_of(key: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(quoted(k)) for k in key])


def heavy_keys(df: DataFrame, key: Sequence[str], share: float) -> list[int]:
    """Hashes of the keys with about ``share`` of the rows or more, from one mergeable sketch of the key hashes: 1 / share of them at most."""
    track = max(1024, 1 << (int(16 / share) - 1).bit_length())
    sketch = F.expr(f"approx_top_k(_h, {int(1 / share) + 1}, {track})")
    hashed = df.filter(reduce(lambda a, b: a & b, [F.col(quoted(k)).isNotNull() for k in key])).select(_key_of(key).alias("_h"))
    row = hashed.agg(F.count(F.lit(1)).alias("n"), sketch.alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] >= share * row["n"]]


def _block_pairs(left: DataFrame, right: DataFrame, grid: DataFrame, on: Sequence[str]) -> DataFrame:
    """``_lefts``, ``_rights``: every left block of a key beside every right block of it.

    The product has as many tasks as the session's shuffles, more when a partition would hold over ``_PARTITION_ROWS`` rows.
    """
    total = grid.filter("_r > 0").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_l", "_r", "_lines", "_columns")]).first()
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across = math.sqrt(tasks * total["_l"] / max(total["_r"], 1))
    parts = [max(1, min(math.ceil(across), total["_lines"], tasks), -(-total["_l"] // _PARTITION_ROWS))]
    parts.append(max(1, min(-(-tasks // parts[0]), total["_columns"]), -(-total["_r"] // _PARTITION_ROWS)))
    sides = []
    for side, own, n, name in ((left, "_lines", parts[0], "_lefts"), (right, "_columns", parts[1], "_rights")):
        placed = side.join(F.broadcast(grid.filter("_r > 0").select(*on, own)), on).withColumn("_own", F.pmod(F.xxhash64("_number"), F.col(own)).cast("int"))
        blocks = placed.groupBy(*on, "_own").agg(F.collect_list("_row").alias(name))
        # by the hash of its place a block of any key may lie in any partition, and all partitions get as many
        sides.append(blocks.withColumn("_place", F.xxhash64(*on, "_own")).repartitionByRange(n, "_place").select(*on, name))
    return sides[0].join(sides[1].hint("shuffle_replicate_nl"), list(on)).select("_lefts", "_rights")


def skewed_join(
    left: DataFrame, right: DataFrame, key: Sequence[str], how: str = "inner", share: float = 0.005, cell_rows: int = 1_000_000
) -> DataFrame:
    """The inner or left join on one key, for keys that repeat on both sides.

    A sketch of each side names its heavy keys (``share`` of the rows or more). All other rows meet in the plain join. The rows of
    a heavy key are numbered, stored and dealt once into blocks, left and right, so small that two of them make at most about ``cell_rows``
    rows. Every left block then meets every right block of its key in a product of the two sides' partitions: tasks read the same blocks
    again instead of getting copies, so disk grows with the rows and not with the pairs, no task holds the key, and the joined rows are
    made one after the other. A row's block is a function of stored numbers: a repeated task deals rows as before. NULL keys never match;
    in a left join their rows are added without a partner.
    """
    if how not in ("inner", "left"):
        raise ValueError("inner or left")
    key = list(key)
    whole = reduce(lambda a, b: a & b, [F.col(quoted(k)).isNotNull() for k in key])
    rest = [c for c in right.columns if c not in key]
    hot = sorted(set(heavy_keys(left, key, share)) | set(heavy_keys(right, key, share)))  # 2 / share at most
    is_hot = _key_of(key).isin(hot) if hot else F.lit(False)
    out = left.filter(whole & ~is_hot).join(right.filter(whole & ~is_hot), key, how)
    alone = left.filter(~whole) if how == "left" else None
    if hot:
        sides = []
        for side in (left, right):
            numbered = side.filter(whole & is_hot).select(F.struct(*[F.col(quoted(c)) for c in side.columns]).alias("_row"), *[F.col(quoted(k)).alias(f"_k{i}") for i, k in enumerate(key)])
            sides.append(cut_lineage(numbered.withColumn("_number", F.monotonically_increasing_id())))
        on = [f"_k{i}" for i in range(len(key))]
        counts = [s.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for s, n in zip(sides, ("_l", "_r"))]
        grid = counts[0].join(counts[1], on, "left").na.fill(0, ["_r"])  # a row for each heavy key
        cells = F.ceil(F.col("_l") * F.col("_r") / F.lit(float(cell_rows)))
        lines = F.least(F.greatest(F.ceil(F.sqrt(cells * F.col("_l") / F.greatest("_r", F.lit(1)))), F.lit(1)), F.greatest(cells, F.lit(1)))
        grid = grid.withColumn("_lines", lines.cast("int")).withColumn("_columns", F.greatest(F.ceil(cells / F.col("_lines")), F.lit(1)).cast("int"))
        for own, n in (("_lines", "_l"), ("_columns", "_r")):
            grid = grid.withColumn(own, F.greatest(own, F.ceil(F.col(n) / _BLOCK_ROWS)).cast("int"))
        grid = cut_lineage(grid)
        met = _block_pairs(*sides, grid, on).select(F.explode("_lefts").alias("_left"), "_rights").select("_left", F.explode("_rights").alias("_right"))
        out = out.unionByName(met.select(*[F.col("_left")[k].alias(k) for k in key], *[F.col("_left")[c].alias(c) for c in left.columns if c not in key], *[F.col("_right")[c].alias(c) for c in rest]))
        if how == "left":
            alone = alone.unionByName(sides[0].join(F.broadcast(grid), on).filter("_r = 0").select("_row.*"))
    if alone is not None:
        kinds = {f.name: f.dataType for f in right.schema}
        out = out.unionByName(alone.select(*[F.col(quoted(c)) for c in left.columns], *[F.lit(None).cast(kinds[c]).alias(c) for c in rest]))
    return out


def membership_flag(df: DataFrame, ids: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    """1 where the key occurs in ``ids``, else 0; row count is unchanged."""
    present = ids.select(*key).distinct().withColumn(flag, F.lit(1))
    return df.join(present, list(key), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def attach(df: DataFrame, extra: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(extra, list(key), "left")


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=[quoted(c) for c in cols])


def followed_up(df: DataFrame, flag: str) -> DataFrame:
    return df.filter(F.col(flag) == 1).drop(flag)


def gate(df: DataFrame, by: Sequence[str], min_n: int) -> tuple[DataFrame, DataFrame]:
    """Rows of groups with more than ``min_n`` rows, and a report of every group.

    The count is combined before the shuffle; the rows themselves are only
    semi-joined with the surviving group keys.
    """
    report = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "status", F.when(F.col("n") > min_n, "ok").otherwise("too_few")
    )
    passed = report.filter(F.col("status") == "ok").select(*by)
    cond = reduce(lambda a, b: a & b, [df[b].eqNullSafe(passed[b]) for b in by])
    return df.join(passed, cond, "left_semi"), report


def shared_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys present in both result tables."""
    return a.select(*key).intersect(b.select(*key))


def restrict_to_shared(a: DataFrame, b: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return a.join(b, list(key), "left_semi"), b.join(a, list(key), "left_semi")


def replicate(df: DataFrame, m: int, column: str = "mi_id") -> DataFrame:
    """m tagged copies of every row, made in place without a shuffle."""
    return df.withColumn(column, F.explode(F.sequence(F.lit(1), F.lit(m))))


def tag_union(frames: dict[str, DataFrame], column: str) -> DataFrame:
    """Stack result tables of the same shape with a tag column."""
    tagged = [df.withColumn(column, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), tagged)
