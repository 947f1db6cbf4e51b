"""Graph learners driven by distributed moments.

The linear learners read a covariance matrix per (subset, fold), so their cost
in rows is the single pass of ``fold_gram``; the d x d problems are spread over
tasks, one row each. The pairwise-likelihood learner needs non-linear moments:
one pass per ordering step serves all folds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from panelwright.functions.codes import quoted
from panelwright.operators.matrix import INFORMATIVE, informative, unpack
from panelwright.operators.sums import keep_blocks, vector_sums

EDGE_SCHEMA = "subset string, method string, fold int, src string, dst string, coef double"

# Learner settings.
LINGAM_THRESHOLD = 0.05
GOLEM = {"lambda_1": 1e-4, "lambda_1_first": 2e-2, "lambda_2": 1.0, "learning_rate": 1e-4, "num_iter": 10000, "threshold": 1e-3}
DAGMA = {"lambda_1": 1e-3, "learning_rate": 3e-4, "threshold": 0.1, "stages": 4, "mu_init": 0.1, "mu_factor": 0.1,
         "s": 1.0, "warm_iter": 1000, "max_iter": 8000, "checkpoint": 100}
ORDER_THRESHOLD = 1e-5
METHODS = ("DirectLiNGAM", "GOLEM", "ORDER_BIC", "DAGMA_LINEAR")
#: Informative columns that a learner needs; 2 for those not listed.
LEAST_COLUMNS = {"ORDER_BIC": 3}
# Constants of the maximum-entropy approximation of differential
# entropy (Hyvarinen & Smith 2013).
ENTROPY_K1, ENTROPY_K2, ENTROPY_GAMMA = 79.047, 7.4129, 0.37457


def _solve_rows(moments: DataFrame, method: str, forbidden: set[tuple[str, str]], threshold: float, learner) -> DataFrame:
    """Run ``learner(n, cov, allowed)`` on every moment row; matrix [i, j] is the
    effect of i on j."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                names = list(row.names)
                n, _, cov = unpack(np.asarray(row.gram, dtype=float), len(names))
                use = informative(cov)
                allowed = np.array(
                    [[i != j and (names[i], names[j]) not in forbidden for j in use] for i in use], dtype=float
                ).reshape(len(use), len(use))
                if len(use) < LEAST_COLUMNS.get(method, 2):
                    continue  # it has its row in learner_runs
                b = learner(n, cov[np.ix_(use, use)], allowed) * allowed
                src, dst = np.nonzero(np.abs(b) > threshold)
                yield pd.DataFrame(
                    {
                        "subset": row.subset, "method": method, "fold": np.int32(row.fold),
                        "src": [names[use[i]] for i in src], "dst": [names[use[j]] for j in dst], "coef": b[src, dst],
                    }
                )

    return moments.repartition("subset", "fold").mapInPandas(run, EDGE_SCHEMA)


def learner_runs(moments: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """subset, method, fold, n_rows, n_columns (informative), status: a row for every run, also those that have no edges to show.

    ``too_few``: fewer informative columns than the learner needs.
    """
    d = F.size("names")
    # the diagonal of the packed co-moments: row i of the triangle starts after the longer rows before it
    diagonal = F.transform(F.sequence(F.lit(0), d - 1), lambda i: F.get("gram", (d + 1 + i * d - i * (i - 1) / 2).cast("int")))
    wide = F.size(F.filter(diagonal, lambda v: v / F.col("gram")[0] > INFORMATIVE))
    least = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(LEAST_COLUMNS.get(m, 2)).alias("least")) for m in methods])
    runs = moments.select("subset", "fold", F.col("gram")[0].cast("bigint").alias("n_rows"), wide.alias("n_columns"), F.explode(least).alias("m"))
    return runs.select("subset", "m.method", "fold", "n_rows", "n_columns", F.when(F.col("n_columns") < F.col("m.least"), "too_few").otherwise("ok").alias("status"))


class _Adam:
    def __init__(self, shape, rate, b1=0.9, b2=0.999):
        self.m, self.v, self.t, self.rate, self.b1, self.b2 = np.zeros(shape), np.zeros(shape), 0, rate, b1, b2

    def step(self, g):
        self.t += 1
        self.m = self.b1 * self.m + (1 - self.b1) * g
        self.v = self.b2 * self.v + (1 - self.b2) * g * g
        return self.rate * (self.m / (1 - self.b1**self.t)) / (np.sqrt(self.v / (1 - self.b2**self.t)) + 1e-8)


def _expm(a: np.ndarray) -> np.ndarray:
    norm = np.abs(a).sum(axis=0).max()
    k = max(0, int(np.ceil(np.log2(norm))) + 2) if norm > 0.25 else 0
    scaled = a / 2.0**k
    term = out = np.eye(len(a))
    for i in range(1, 11):
        term = term @ scaled / i
        out = out + term
    for _ in range(k):
        out = out @ out
    return out


def _likelihood_dag(cov, allowed, equal_variance, lam1, lam2, rate, iters, start):
    """Gradient descent on the Gaussian likelihood of a linear DAG with an L1
    term and the trace-exponential acyclicity term (Ng et al. 2020)."""
    d = len(cov)
    b, eye, opt = start.copy(), np.eye(d), _Adam((d, d), rate)
    for _ in range(iters):
        rest = eye - b
        s_rest = cov @ rest
        var = np.maximum(np.einsum("ij,ij->j", rest, s_rest), 1e-12)
        fit = -d * s_rest / var.sum() if equal_variance else -s_rest / var
        grad = fit + np.linalg.pinv(rest).T + lam1 * np.sign(b) + lam2 * 2.0 * b * _expm(b * b).T
        b = (b - opt.step(grad * allowed)) * allowed
    return b


def golem(moments: DataFrame, forbidden: set[tuple[str, str]] = frozenset(), **settings) -> DataFrame:
    """Two stages: equal noise variances, then unequal ones from that start."""
    p = {**GOLEM, **settings}

    def learn(n, cov, allowed):
        first = _likelihood_dag(cov, allowed, True, p["lambda_1_first"], p["lambda_2"], p["learning_rate"], p["num_iter"], np.zeros_like(cov))
        return _likelihood_dag(cov, allowed, False, p["lambda_1"], p["lambda_2"], p["learning_rate"], p["num_iter"], first)

    return _solve_rows(moments, "GOLEM", set(forbidden), p["threshold"], learn)


def dagma_linear(moments: DataFrame, forbidden: set[tuple[str, str]] = frozenset(), **settings) -> DataFrame:
    """Least-squares linear DAG with the log-determinant acyclicity function on
    a central path (Bello et al. 2022)."""
    p = {**DAGMA, **settings}

    def learn(n, cov, allowed):
        d = len(cov)
        w, eye, mu = np.zeros((d, d)), np.eye(d), p["mu_init"]
        for stage in range(p["stages"]):
            rate, best = p["learning_rate"], None
            opt, previous = _Adam((d, d), rate, 0.99, 0.999), None
            for it in range(p["max_iter"] if stage == p["stages"] - 1 else p["warm_iter"]):
                inverse = np.linalg.inv(p["s"] * eye - w * w)
                if (inverse < -1e-12).any():  # left the feasible region: back up with a smaller step
                    if best is None or opt.rate < 1e-8:
                        break
                    w, rate = best.copy(), rate / 2
                    opt = _Adam((d, d), rate, 0.99, 0.999)
                    continue
                best = w
                grad = mu * (-cov @ (eye - w) + p["lambda_1"] * np.sign(w)) + 2.0 * w * inverse.T
                if it % p["checkpoint"] == 0:
                    rest = eye - w
                    sign, logdet = np.linalg.slogdet(p["s"] * eye - w * w)
                    value = mu * (0.5 * np.einsum("ij,ij->", rest, cov @ rest) + p["lambda_1"] * np.abs(w).sum()) - logdet
                    if previous is not None and abs(previous - value) <= 1e-6 * abs(previous):
                        break
                    previous = value
                w = (w - opt.step(grad * allowed)) * allowed
            w = best if best is not None else w
            mu *= p["mu_factor"]
        return w

    return _solve_rows(moments, "DAGMA_LINEAR", set(forbidden), p["threshold"], learn)


def _regress(cov, node, parents):
    """Coefficients and residual variance of a node on its parents."""
    if not len(parents):
        return np.zeros(0), cov[node, node]
    a = cov[np.ix_(parents, parents)]
    coef = np.linalg.lstsq(a, cov[parents, node], rcond=None)[0]
    return coef, max(cov[node, node] - coef @ cov[parents, node], 1e-12)


def order_search_bic(
    moments: DataFrame, forbidden: set[tuple[str, str]] = frozenset(), threshold: float = ORDER_THRESHOLD,
    seed: int = 2025, sweeps: int = 20,
) -> DataFrame:
    """Local search over orderings for the best equal-variance BIC; a parent is
    kept when dropping it would raise the score."""

    def learn(n, cov, allowed):
        d = len(cov)
        cache: dict = {}

        def residual(order, at):
            node = order[at]
            parents = [v for v in order[:at] if allowed[v, node]]
            spot = (node, frozenset(parents))
            if spot not in cache:
                cache[spot] = _regress(cov, node, parents)[1]
            return cache[spot], len(parents)

        def score(order):
            parts = [residual(order, i) for i in range(d)]
            return n * d * np.log(sum(r for r, _ in parts) / d) + np.log(n) * sum(k for _, k in parts)

        rng = np.random.default_rng(seed)
        order = list(np.argsort(np.diag(cov), kind="stable"))
        best = score(order)
        for _ in range(sweeps):
            improved = False
            for node in rng.permutation(d):
                rest = [v for v in order if v != node]
                trials = [rest[:i] + [int(node)] + rest[i:] for i in range(d)]
                values = [score(t) for t in trials]
                i = int(np.argmin(values))
                if values[i] < best - 1e-9 * abs(best):
                    order, best, improved = trials[i], values[i], True
            if not improved:
                break
        b = np.zeros((d, d))
        for at, node in enumerate(order):
            parents = [v for v in order[:at] if allowed[v, node]]
            while parents:
                coef, rss = _regress(cov, node, parents)
                loss = []
                for i in range(len(parents)):
                    without = _regress(cov, node, parents[:i] + parents[i + 1 :])[1]
                    loss.append(n * np.log(without / rss))
                weakest = int(np.argmin(loss))
                if loss[weakest] >= np.log(n):
                    b[parents, node] = coef
                    break
                parents.pop(weakest)
        return b

    return _solve_rows(moments, "ORDER_BIC", set(forbidden), threshold, learn)


def _candidates(left: list[int], blocked: np.ndarray) -> list[int]:
    """Variables that may come next: none of the others is allowed to cause
    them while they are not allowed to cause it."""
    return [i for i in left if not any(blocked[i, j] and not blocked[j, i] for j in left if j != i)]


def _entropy(log_cosh: np.ndarray, gauss: np.ndarray) -> np.ndarray:
    base = 0.5 * (1.0 + np.log(2.0 * np.pi))
    return base - ENTROPY_K1 * (log_cosh - ENTROPY_GAMMA) ** 2 - ENTROPY_K2 * gauss**2


def _ordering_passes(rows: DataFrame, names: Sequence[str], fold: str):
    """Blocks of rows in the order of their fold, so that the rows of all other folds are two slices of a block."""
    chosen = rows.select(*[F.col(quoted(v)).cast("double").alias(v) for v in names], F.col(fold).cast("int").alias(fold))
    return keep_blocks(chosen.sortWithinPartitions(fold))


def _fold_models(moments: DataFrame, d: int) -> list[dict]:
    models = []
    for r in moments.select("subset", "fold", "gram").toPandas().itertuples():  # one small row per fold
        n, mean, cov = unpack(np.asarray(r.gram, dtype=float), d)
        models.append({"subset": r.subset, "fold": int(r.fold), "n": n, "mean": mean, "cov": cov, "maps": np.eye(d),
                       "left": [int(i) for i in informative(cov)], "order": [], "rung": 0})
    return models


def _probes(f: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit combinations of the columns: what is left of each open variable, and its residual on each other one (i on j)."""
    c = f["maps"][f["left"]]
    cov = c @ f["cov"] @ c.T
    slope = cov / np.diag(cov)[None, :]  # slope[i, j]: regression of i on j
    i, j = np.nonzero(~np.eye(len(c), dtype=bool))
    probe = np.vstack([c, c[i] - slope[i, j][:, None] * c[j]])
    sd = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", probe, f["cov"], probe), 1e-300))
    return i, j, probe / sd[:, None]


def _merits(passes, names: Sequence[str], fold: str, jobs: list[tuple[dict, tuple]]) -> list[np.ndarray]:
    """How well each open variable of each fold model precedes the others; one pass over the rows for all of them."""
    packed = [(f["fold"], probe, probe @ f["mean"]) for f, (_, _, probe) in jobs]

    def accumulate(batch, acc):
        own, x = batch[fold], batch.matrix(names)
        for k, (number, probe, shift) in enumerate(packed):
            lo, hi = np.searchsorted(own, [number, number + 1])
            for a, b in ((0, lo), (hi, len(own))):
                for start in range(a, b, 2000):
                    v = x[start : min(b, start + 2000)] @ probe.T - shift
                    size = np.abs(v)
                    acc[k][: len(probe)] += (size + np.log1p(np.exp(-2.0 * size))).sum(axis=0) - len(v) * np.log(2.0)
                    acc[k][len(probe) :] += (v * np.exp(-0.5 * v * v)).sum(axis=0)

    out = []
    for (f, (i, j, probe)), total in zip(jobs, vector_sums(passes, [2 * len(p) for _, p, _ in packed], accumulate)):
        mean, u = total / f["n"], len(f["left"])
        h = _entropy(mean[: len(probe)], mean[len(probe) :])
        single, resid = h[:u], np.zeros((u, u))
        resid[i, j] = h[u:]
        gain = (single[None, :] + resid) - (single[:, None] + resid.T)  # > 0: i causes j
        np.fill_diagonal(gain, 0.0)
        out.append(-(np.minimum(0.0, gain) ** 2).sum(axis=1))
    return out


def first_merits(rows: DataFrame, moments: DataFrame, vars: Sequence[str], fold: str = "fold") -> DataFrame:
    """subset, fold, var, merit: the first step of the ordering (largest merit first); variables without variance have no row."""
    names, models = list(vars), _fold_models(moments, len(vars))
    passes = _ordering_passes(rows, names, fold)
    jobs = [(f, _probes(f)) for f in models if f["left"]]
    merits = _merits(passes, names, fold, jobs)
    passes.unpersist()
    told = [(f["subset"], f["fold"], names[v], float(m)) for (f, _), merit in zip(jobs, merits) for v, m in zip(f["left"], merit)]
    return rows.sparkSession.createDataFrame(told, "subset string, fold int, var string, merit double")


def direct_lingam(
    rows: DataFrame, moments: DataFrame, vars: Sequence[str], ladders: Sequence[set[tuple[str, str]]] = (),
    threshold: float = LINGAM_THRESHOLD, fold: str = "fold",
) -> DataFrame:
    """Causal ordering by pairwise likelihood ratios, then regression weights.

    ``rows`` are the prepared rows with their fold; a row counts for every fold
    model but its own. ``ladders`` are forbidden-edge sets from strict to
    loose; a looser one is used when no variable may come next.
    """
    names, d = list(vars), len(vars)
    place = {v: i for i, v in enumerate(names)}
    steps = [*ladders, set()]
    blocked = []
    for rung in steps:
        block = np.zeros((d, d), dtype=bool)
        for s, t in rung:
            if s in place and t in place:
                block[place[s], place[t]] = True
        blocked.append(block)
    folds = _fold_models(moments, d)
    passes = _ordering_passes(rows, names, fold)

    while any(len(f["left"]) > 1 for f in folds):
        jobs = []
        for f in folds:
            if len(f["left"]) < 2:
                continue
            left, rung = f["left"], f["rung"]
            while not (options := _candidates(left, blocked[rung])):
                rung += 1
            f["rung"], f["options"] = rung, options
            jobs.append((f, _probes(f)))
        for (f, _), merit in zip(jobs, _merits(passes, names, fold, jobs)):
            spots = [f["left"].index(o) for o in f["options"]]
            chosen = f["left"][max(spots, key=lambda s: merit[s])]
            c, cov = f["maps"], f["cov"]
            var = c[chosen] @ cov @ c[chosen]
            for v in f["left"]:
                if v != chosen:
                    c[v] = c[v] - (c[v] @ cov @ c[chosen]) / var * c[chosen]
            f["order"].append(chosen)
            f["left"] = [v for v in f["left"] if v != chosen]
    passes.unpersist()
    edges = []
    for f in folds:
        order = f["order"] + f["left"]
        for at, node in enumerate(order):
            parents = [v for v in order[:at] if not blocked[f["rung"]][v, node]]
            coef, _ = _regress(f["cov"], node, parents)
            edges += [
                (f["subset"], "DirectLiNGAM", f["fold"], names[v], names[node], float(w))
                for v, w in zip(parents, coef) if abs(w) > threshold
            ]
    return rows.sparkSession.createDataFrame(edges, EDGE_SCHEMA)
