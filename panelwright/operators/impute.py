"""Multiple imputation by chained equations.

Each column with gaps is regressed on all the others and its missing cells are
redrawn, round after round. The regressions need only sums of products, so

* rows without any gap contribute one constant matrix, computed once;
* rows with gaps exist once per chain, and one pass per (round, column) over
  them adds their current products for all chains;
* a pass rebuilds the current cells from the last checkpoint by replaying the
  few fitted regressions since then; every round ends with a checkpoint, so a
  pass never replays more than one round.

All sums are taken around the columns' means. Rows with gaps get a number and
are stored once; the rounds carry numbers only (row number, gaps, current cells),
in packed blocks that a round's checkpoint rewrites as blocks,
and the other columns meet them once, at the end. A key may repeat.

Draws are counter-based: an integer hash of (row identity, chain, round, column,
seed), so results depend neither on partitioning nor on retries.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import numpy as np
from pyspark.sql import DataFrame, functions as F

from panelwright.functions.codes import quoted
from panelwright.operators.panel import replicate
from panelwright.operators.quantiles import number
from panelwright.operators.sums import Columns, keep_blocks, vector_sums
from panelwright.session import cut_lineage

# Shape and rate of the gamma priors of the ridge regression.
PRIOR = 1e-6


@dataclass
class Regression:
    """Posterior of one column on the others, in original units."""

    intercept: float
    coef: np.ndarray
    center: np.ndarray
    sigma: np.ndarray
    noise: float


def ridge_from_moments(gram: np.ndarray, target: int, tol: float = 1e-3, max_iter: int = 300) -> Regression:
    """Bayesian ridge regression by evidence maximisation (MacKay 1992; Tipping
    2001) from the sums of products of [1, x1..xp]; column ``target`` of x on
    the rest. Arrays are returned over all p columns with 0 at the target."""
    p = len(gram) - 1
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    rest = [i for i in range(p) if i != target]
    sxx, sxy, syy = centred[np.ix_(rest, rest)], centred[rest, target], max(centred[target, target], 0.0)
    eig, basis = np.linalg.eigh(sxx)
    eig = np.clip(eig, 0.0, None)
    rotated = basis.T @ sxy
    alpha, lam = 1.0 / (syy / n + np.finfo(float).eps), 1.0
    previous = None

    def coefficients():
        return basis @ (rotated / (eig + lam / alpha))

    for _ in range(max_iter):
        coef = coefficients()
        residual = max(syy - 2.0 * coef @ sxy + coef @ sxx @ coef, 0.0)
        used = float(np.sum(alpha * eig / (lam + alpha * eig)))
        lam = (used + 2 * PRIOR) / (coef @ coef + 2 * PRIOR)
        alpha = (n - used + 2 * PRIOR) / (residual + 2 * PRIOR)
        if previous is not None and np.abs(previous - coef).sum() < tol:
            break
        previous = coef
    coef = coefficients()
    full, sigma, center = np.zeros(p), np.zeros((p, p)), mean.copy()
    full[rest] = coef
    sigma[np.ix_(rest, rest)] = (basis / (eig + lam / alpha)) @ basis.T / alpha
    return Regression(float(mean[target] - mean[rest] @ coef), full, center, sigma, 1.0 / alpha)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    """64-bit avalanche of a row hash and a salt (splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def hashed_normal(h: np.ndarray, salt: int) -> np.ndarray:
    """Standard normal draws from row hashes (Box-Muller)."""
    first = _mix(h.astype(np.uint64), 2 * salt + 1)
    second = _mix(first, 2 * salt + 2)
    u = ((first >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    v = (second >> np.uint64(11)).astype(float) / 2.0**53
    return np.sqrt(-2.0 * np.log(u)) * np.cos(2.0 * np.pi * v)


@dataclass
class _Update:
    column: int
    salt: int
    models: list[Regression]


def _replay(x: np.ndarray, chain: np.ndarray, missing: np.ndarray, h: np.ndarray, updates: Sequence[_Update], sample: bool) -> np.ndarray:
    """Redraw missing cells, in order, with the fitted regressions."""
    for u in updates:
        hole = (missing >> u.column) & 1 == 1
        for k, model in enumerate(u.models):
            rows = np.flatnonzero(hole & (chain == k + 1))
            if not len(rows):
                continue
            sub = x[rows]
            value = model.intercept + sub @ model.coef
            if sample:
                d = sub - model.center
                spread = np.sqrt(np.einsum("ij,jk,ik->i", d, model.sigma, d) + model.noise)
                value = value + spread * hashed_normal(h[rows], u.salt)
            x[rows, u.column] = value
    return x


def _arrays(batch: Columns, p: int, seed: int):
    """Cells, chains, gaps and the hashes that the draws start from."""
    x = np.array(batch.matrix([f"x{i}" for i in range(p)]), order="F")  # a copy: cells get redrawn
    chain = batch["chain"]
    return x, chain, batch["missing"], _mix(batch["h"].view(np.uint64), seed) + chain.astype(np.uint64)


def mice(
    df: DataFrame,
    key: Sequence[str],
    cols: Sequence[str],
    m: int = 5,
    rounds: int = 25,
    seed: int = 2025,
    sample: bool = True,
    round_binary: bool = False,
    tol: float = 1e-3,
    checkpoint_every: int = 1,
    chain_col: str = "mi_id",
    draw_id: str | None = None,
) -> DataFrame:
    """``m`` completed copies of the frame, tagged ``mi_id`` = 1..m.

    ``key`` seeds the draws together with the row's values: it may repeat (rows equal in everything get equal draws)
    but not be NULL. ``draw_id`` names a column of whole numbers that seeds them instead (rows with equal numbers get
    equal draws; any engine with 64-bit integers can repeat them). With ``sample=False`` cells get their conditional mean and all copies agree. 0/1 columns get
    continuous values unless ``round_binary`` is set. Columns without any value stay missing; NaN is missing.
    """
    key, cols = list(key), list(cols)
    value = number
    no_key = reduce(or_, [F.col(quoted(k)).isNull() for k in [*key, *([draw_id] if draw_id else [])]])
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(no_key).alias("no_key"),
        *[F.count(value(c)).alias(f"n{i}") for i, c in enumerate(cols)],
        *[F.avg(value(c)).alias(f"m{i}") for i, c in enumerate(cols)],
    ).first()
    if counts["no_key"]:
        raise ValueError(f"{counts['no_key']} rows have no {', '.join(key)}")
    kept = [c for i, c in enumerate(cols) if counts[f"n{i}"] > 0]
    mean = {c: counts[f"m{i}"] for i, c in enumerate(cols)}
    gaps = {c: counts["rows"] - counts[f"n{i}"] for i, c in enumerate(cols) if c in kept}
    p = len(kept)
    order = [kept.index(c) for c in sorted(kept, key=lambda c: gaps[c]) if gaps[c] > 0]
    if not order:
        return replicate(df, m, chain_col)

    full = reduce(and_, [value(c).isNotNull() for c in kept])
    bits = reduce(lambda a, b: a + b, [F.when(value(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(kept)])
    centred = lambda c: value(c) - F.lit(mean[c])
    complete = df.filter(full).select(*[centred(c).alias(f"x{i}") for i, c in enumerate(kept)])
    open_rows = df.filter(~full)
    chains = m if sample else 1
    row = [F.col(quoted(c)) for c in df.columns]
    identity = F.col(quoted(draw_id)).cast("bigint") if draw_id else F.xxhash64(*[F.col(quoted(k)) for k in key], *[value(c) for c in kept])
    stored = cut_lineage(open_rows.select(
        F.monotonically_increasing_id().alias("number"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(row)]).alias("row"),
        identity.alias("h"), bits.cast("bigint").alias("missing"),
        *[F.coalesce(centred(c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(kept)],
    ))
    state = replicate(stored.drop("row"), chains, "chain")
    upper = np.triu_indices(p + 1)

    def products(x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), x])
        return (z.T @ z)[upper]

    def complete_products(batch, acc):
        acc[0] += products(batch.matrix([f"x{i}" for i in range(p)]))

    constant = vector_sums(complete, [len(upper[0])], complete_products)[0]
    passes = keep_blocks(state.select(*[f"x{i}" for i in range(p)], "chain", "missing", "h", "number"))
    pending: list[_Update] = []

    def observed_products(column: int):
        replayed = list(pending)

        def accumulate(batch, acc):
            x, chain, missing, h = _arrays(batch, p, seed)
            x = _replay(x, chain, missing, h, replayed, sample)
            seen = (missing >> column) & 1 == 0
            for k in range(chains):
                rows = seen & (chain == k + 1)
                if rows.any():
                    acc[k] += products(x[rows])

        return vector_sums(passes, [len(upper[0])] * chains, accumulate)

    def redrawn(replayed, batch) -> dict[str, np.ndarray]:
        x, chain, missing, h = _arrays(batch, p, seed)
        x = _replay(x, chain, missing, h, replayed, sample)
        return {f"x{i}": x[:, i] for i in range(p)}

    for r in range(rounds):
        for column in order:
            models = []
            for part in observed_products(column):
                gram = np.zeros((p + 1, p + 1))
                gram[upper] = constant + part
                gram = gram + np.triu(gram, 1).T
                models.append(ridge_from_moments(gram, column, tol))
            pending.append(_Update(column, r * p + column, models))
        if (r + 1) % checkpoint_every == 0 or r + 1 == rounds:
            passes, pending = passes.settled(functools.partial(redrawn, list(pending))), []

    binary = set()
    if round_binary:
        flags = df.agg(*[F.bool_and(value(c).isin(0.0, 1.0)).alias(f"b{i}") for i, c in enumerate(kept)]).first()
        binary = {c for i, c in enumerate(kept) if flags[f"b{i}"]}

    def cell(c):
        """A column of the completed rows: what was observed, else the current draw."""
        own = F.col(f"row.c{df.columns.index(c)}")
        if c not in kept:
            return own.alias(c)
        x = F.col(f"x{kept.index(c)}") + F.lit(mean[c])
        x = F.rint(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))) if c in binary else x
        return F.when(F.col("missing").bitwiseAND(F.lit(1 << kept.index(c))) != 0, x).otherwise(own.cast("double")).alias(c)

    drawn = passes.rows(["number", "chain", *[f"x{i}" for i in range(p)]])
    completed = drawn.join(stored.select("number", "row", "missing"), "number").select(*[cell(c) for c in df.columns], F.col("chain").alias(chain_col))
    if not sample:
        completed = replicate(completed.drop(chain_col), m, chain_col)
    as_double = df.select(*[value(c).alias(c) if c in kept else F.col(quoted(c)) for c in df.columns])
    whole = replicate(as_double.filter(full), m, chain_col)
    return whole.unionByName(completed)
