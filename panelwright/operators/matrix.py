"""Design matrices, folds and per-fold moments.

Moments are (n, means, co-moments): sums of products around the means, merged pairwise by the means' differences (Chan, Golub
and LeVeque 1979), in a task, across tasks and across folds. No step subtracts large sums, so large means cost no digits. Packed
they are the upper triangle of a (d + 1) x (d + 1) matrix: n, the means, then the co-moments, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from panelwright.functions.codes import quoted
from panelwright.operators.panel import complete_cases
from panelwright.operators.quantiles import exact_quantiles, ranked, with_stats
from panelwright.operators.sums import Columns
from panelwright.session import cut_lineage

MOMENT_SCHEMA = "fold int, n double, mean array<double>, comoment array<double>"


def binary_columns(df: DataFrame, cols: Sequence[str]) -> set[str]:
    flags = df.agg(*[F.bool_and(F.col(quoted(c)).isin(0.0, 1.0)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    return {c for i, c in enumerate(cols) if flags[f"b{i}"]}


def prepare_matrix(
    df: DataFrame, vars: Sequence[str], keep: Sequence[str] = ()
) -> tuple[DataFrame, list[str]]:
    """Complete rows of the variables that exist, non-binary ones centred on the
    median and divided by the interquartile range (1 when that is 0)."""
    use = [v for v in vars if v in df.columns]
    rows = complete_cases(df, use).select(*[quoted(k) for k in keep], *[F.col(quoted(v)).cast("double").alias(v) for v in use])
    binary = binary_columns(rows, use)
    cont = [v for v in use if v not in binary]
    if not cont:
        return rows, use
    q = exact_quantiles(rows, cont, [0.25, 0.5, 0.75])

    def scaled(d, s):
        def one(c):
            width = s(c)[2] - s(c)[0]
            return (F.col(quoted(c)) - s(c)[1]) / F.when(width == 0, F.lit(1.0)).otherwise(width)

        return d.withColumns({c: one(c) for c in cont})

    return with_stats(rows, q, (), scaled), use


def kfold(df: DataFrame, key: Sequence[str], k: int, seed: int, out: str = "fold", arithmetic: bool = False) -> DataFrame:
    """Fold 0..k-1 from a hash of the key: near-equal sizes, and the same fold
    on every retry. ``arithmetic`` uses a plain integer hash of a single
    integer key that any SQL engine can repeat."""
    if arithmetic:
        h = (F.col(quoted(key[0])).cast("bigint") * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)
        return df.withColumn(out, (h % F.lit(k)).cast("int"))
    return df.withColumn(out, F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in key], F.lit(seed)), F.lit(k)).cast("int"))


def exact_folds(df: DataFrame, key: Sequence[str], k: int, seed: int, out: str = "fold", arithmetic: bool = False, per_range: int = 1 << 16) -> DataFrame:
    """Fold 0..k-1 of shuffled rows, sizes differing by one row at most: the rank of a row's hash, modulo k.

    Ranks come from totals of hash buckets and places inside them, so no task orders more than a bucket. Rows with
    equal hashes (repeated keys) are ordered by the rest of ``key`` and then by their values. Store the rows first: they are read more than
    once. ``arithmetic`` hashes the first key column alone, a whole number, as any SQL engine can.
    """
    if arithmetic:
        h = (F.col(quoted(key[0])).cast("bigint") * F.lit(2654435761) + F.lit(seed)) % F.lit(4294967296)
    else:
        h = F.xxhash64(*[F.col(quoted(c)) for c in key], F.lit(seed))
    ties = [F.col(quoted(c)) for c in key] + [F.xxhash64(*[F.col(quoted(c)) for c in df.columns])]
    return ranked(df, h, ties, "_rank", per_range).withColumn(out, (F.col("_rank") % k).cast("int")).drop("_rank")


def _merge(a: tuple | None, b: tuple) -> tuple:
    """(n, means, co-moments) of two sets of rows together."""
    if a is None or not a[0]:
        return b
    if not b[0]:
        return a
    n, d = a[0] + b[0], b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _merged(parts: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    """The same over stored parts: their common means first, then each part's co-moments moved to them."""
    rows, cols = (F.array(*[F.lit(int(i)) for i in x]) for x in np.triu_indices(d))
    one = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c])
    sums = parts.select(*by, "n", F.posexplode("mean").alias("pos", "m")).groupBy(*by, "pos").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m"))
    means = sums.groupBy(*by).agg(one("m").alias("mean"))
    moved = parts.withColumnRenamed("mean", "_own").join(means, list(by)).withColumn("_d", F.zip_with("_own", "mean", lambda x, y: x - y))
    cells = moved.select(*by, "n", "_d", F.posexplode("comoment").alias("pos", "c"))
    shift = F.col("n") * F.get("_d", F.get(rows, F.col("pos"))) * F.get("_d", F.get(cols, F.col("pos")))
    total = cells.groupBy(*by, "pos").agg(F.sum(F.col("c") + shift).alias("c")).groupBy(*by).agg(one("c").alias("comoment"))
    size = parts.groupBy(*by).agg(F.sum("n").alias("n"))
    return size.join(means, list(by)).join(total, list(by)).select(*by, "n", "mean", "comoment")


def fold_gram(df: DataFrame, vars: Sequence[str], fold: str = "fold") -> DataFrame:
    """fold, n, mean, comoment (upper triangle, row by row) of each fold, in one pass over the rows."""
    upper, names = np.triu_indices(len(vars)), list(vars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            cols = Columns(batch)
            folds, x = cols["_f"], cols.matrix(names)
            for f in np.unique(folds):
                part = x[folds == f]
                mean = part.mean(0)
                total[int(f)] = _merge(total.get(int(f)), (float(len(part)), mean, (part - mean).T @ (part - mean)))
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([n for n, _, _ in total.values()]), pa.array([m.tolist() for _, m, _ in total.values()]),
                 pa.array([c[upper].tolist() for _, _, c in total.values()])],
                names=["fold", "n", "mean", "comoment"])

    rows = df.select(F.col(fold).cast("int").alias("_f"), *[F.col(quoted(c)).cast("double").alias(c) for c in names])
    return cut_lineage(_merged(cut_lineage(rows.mapInArrow(run, MOMENT_SCHEMA)), ["fold"], len(names)))


def gram_entries(gram: DataFrame, vars: Sequence[str]) -> DataFrame:
    """Readable form: ``(fold, var_i, var_j, val)``, sums of products of [1, x]; variable "1" is the constant."""
    d = len(vars)
    rows, cols = np.triu_indices(d)
    told = [("1", "1", F.col("n"))] + [("1", v, F.col("n") * F.col("mean")[i]) for i, v in enumerate(vars)]
    told += [(vars[i], vars[j], F.col("comoment")[p] + F.col("n") * F.col("mean")[int(i)] * F.col("mean")[int(j)]) for p, (i, j) in enumerate(zip(rows, cols))]
    entries = F.array(*[F.struct(F.lit(a).alias("var_i"), F.lit(b).alias("var_j"), v.alias("val")) for a, b, v in told])
    return gram.select("fold", F.explode(entries).alias("e")).select("fold", "e.*")


def training_moments(gram: DataFrame, subset: str, vars: Sequence[str]) -> DataFrame:
    """One row per fold with the packed moments of the other folds, merged (never the total minus the fold)."""
    folds = gram.agg(F.collect_set("fold").alias("f")).scalar()
    others = gram.select(F.explode(F.array_except(folds, F.array("fold"))).alias("out"), "n", "mean", "comoment")  # folds squared
    whole = _merged(others, ["out"], len(vars))
    return whole.select(
        F.lit(subset).alias("subset"), F.col("out").alias("fold"), F.array(*[F.lit(v) for v in vars]).alias("names"),
        F.concat(F.array("n"), "mean", "comoment").alias("gram"))


def unpack(gram: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """n, mean and covariance from packed moments."""
    full = np.zeros((d, d))
    full[np.triu_indices(d)] = gram[d + 1 :]
    return gram[0], gram[1 : d + 1], (full + np.triu(full, 1).T) / gram[0]


def merge_packed(parts: Sequence[np.ndarray], d: int) -> np.ndarray:
    """Packed moments of several sets of rows together."""
    total = None
    for gram in parts:
        n, mean, cov = unpack(np.asarray(gram, float), d)
        total = _merge(total, (n, mean, cov * n))
    return np.concatenate([[total[0]], total[1], total[2][np.triu_indices(d)]])


#: Variance above which a column is informative.
INFORMATIVE = 1e-10


def informative(cov: np.ndarray, floor: float = INFORMATIVE) -> np.ndarray:
    """Columns whose variance exceeds ``floor``."""
    return np.flatnonzero(np.diag(cov) > floor)
