"""Weighted Poisson (and logistic) models with robust errors, fitted together.

All models of an analysis share every pass over the rows: one pass per Newton
step, whatever the number of outcomes, imputations, levels and strata. A pass
returns, per model, the score, the information matrix and the squared-score
matrix, all sums over rows, so the d x d algebra is the only work left.

Rows with the same predictors can be merged before the first pass without
changing any of these sums, because they depend on the row only through
``sum(w), sum(w y), sum(w^2), sum(w^2 y), sum(w^2 y^2)`` of its pattern.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.functions.codes import quoted
from panelwright.operators.sums import BlockFrame, keep_blocks, vector_sums

FIT_SCHEMA = (
    "model_id string, outcome string, label string, rep int, status string, iters int, n bigint, "
    "events double, sum_w double, names array<string>, beta array<double>, cov array<double>"
)
RD_SCHEMA = "model_id string, outcome string, label string, rep int, b double, se double"
SUMS = ("n", "y", "w", "wy", "w2", "w2y", "w2yy")


@dataclass(frozen=True)
class ModelSpec:
    """One model: ``outcome ~ 1 + terms`` on rows that satisfy ``where``.

    ``label`` and ``rep`` (imputation number) identify the estimate when results
    are pooled; the first term is the exposure.
    """

    model_id: str
    outcome: str
    terms: tuple[str, ...]
    where: tuple[tuple[str, float], ...] = ()
    label: str = ""
    rep: int = 1


@dataclass
class Fit:
    spec: ModelSpec
    status: str = "running"
    iters: int = 0
    n: int = 0
    events: float = 0.0
    sum_w: float = 0.0
    beta: np.ndarray | None = None
    cov: np.ndarray | None = None

    @property
    def usable(self) -> bool:
        return self.status in ("ok", "rank_deficient")


@dataclass
class _State:
    beta: np.ndarray
    previous: np.ndarray | None = None
    objective: float = -np.inf
    halvings: int = 0
    passes: int = 0
    last: dict = field(default_factory=dict)


def _pairs(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def _products(x: np.ndarray) -> np.ndarray:
    """Products of all column pairs, in the order of the upper triangle."""
    p = x.shape[1]
    out = np.empty((len(x), p * (p + 1) // 2), order="F")
    for c, (i, j) in enumerate(zip(*_pairs(p))):
        np.multiply(x[:, i], x[:, j], out=out[:, c])
    return out


class _Plain:
    """Single rows: outcome matrix (NaN = missing) and one weight per row."""

    def __init__(self, y: np.ndarray, w: np.ndarray):
        gaps = np.isnan(y)
        self.there = ~gaps if gaps.any() else None
        self.y = np.where(gaps, 0.0, y) if gaps.any() else y
        self.w = w[:, None] if self.there is None else self.there * w[:, None]
        self.wy = self.w * self.y

    def residuals(self, mu):
        r = self.wy - self.w * mu
        return r, r * r

    def totals(self) -> np.ndarray:
        k = self.y.shape[1]
        n = np.full(k, float(len(self.y))) if self.there is None else self.there.sum(axis=0)
        w = np.full(k, self.w.sum()) if self.there is None else self.w.sum(axis=0)
        return np.vstack([n, self.y.sum(axis=0), w, self.wy.sum(axis=0)])


class _Merged:
    """Merged rows: sums per design pattern."""

    def __init__(self, sums: dict[str, np.ndarray]):
        self.s, self.w, self.wy = sums, sums["w"], sums["wy"]

    def residuals(self, mu):
        s = self.s
        return s["wy"] - s["w"] * mu, s["w2yy"] - 2.0 * mu * s["w2y"] + mu * mu * s["w2"]

    def totals(self) -> np.ndarray:
        return np.vstack([self.s[k].sum(axis=0) for k in ("n", "y", "w", "wy")])


def _square(flat: np.ndarray, p: int) -> np.ndarray:
    full = np.zeros((p, p))
    rows, cols = _pairs(p)
    full[rows, cols] = flat
    full[cols, rows] = flat
    return full


class GlmBatch:
    """Fit many models over one frame. Missing values drop a row from exactly
    the models that use the missing column (listwise deletion per model)."""

    def __init__(
        self,
        df: DataFrame,
        specs: Sequence[ModelSpec],
        weight: str | None = None,
        family: str = "poisson",
        ridge: float = 0.0,
        compress: bool = False,
        min_n: int = 1,
        tol: float = 1e-9,
        max_passes: int = 60,
    ):
        if family not in ("poisson", "binomial"):
            raise ValueError(family)
        self.spark: SparkSession = df.sparkSession
        self.specs = list(specs)
        self.family, self.ridge, self.min_n, self.tol, self.max_passes = family, ridge, min_n, tol, max_passes
        self.outcomes = sorted({s.outcome for s in self.specs})
        terms = {t for s in self.specs for t in s.terms}
        self.design_cols = sorted(terms | {c for s in self.specs for c, _ in s.where})
        self.groups: dict[tuple, list[int]] = {}
        for i, s in enumerate(self.specs):
            self.groups.setdefault((s.terms, s.where), []).append(i)
        self.design = self._prepare(df, weight, compress)
        self.fits: list[Fit] = []

    def _prepare(self, df: DataFrame, weight: str | None, compress: bool) -> BlockFrame:
        w = F.lit(1.0) if weight is None else F.col(quoted(weight)).cast("double")
        x = [F.col(quoted(c)).cast("double").alias(f"x{i}") for i, c in enumerate(self.design_cols)]
        y = [F.col(quoted(c)).cast("double").alias(f"y{i}") for i, c in enumerate(self.outcomes)]
        rows = df.filter(w.isNotNull()).select(*x, *y, w.alias("w"))
        xs = [f"x{i}" for i in range(len(self.design_cols))]
        self.compressed = bool(compress)  # the caller knows whether design rows repeat
        if not self.compressed:
            return keep_blocks(rows)
        sums = []
        for i in range(len(self.outcomes)):
            yi = F.col(f"y{i}")
            there = yi.isNotNull()
            wi = F.when(there, F.col("w"))
            for name, value in zip(
                SUMS, (there.cast("double"), yi, wi, wi * yi, wi * wi, wi * wi * yi, wi * wi * yi * yi)
            ):
                sums.append(F.coalesce(F.sum(value), F.lit(0.0)).alias(f"{name}{i}"))
        return keep_blocks(rows.groupBy(*xs).agg(*sums))

    def close(self) -> None:
        self.design.unpersist()

    def _reader(self):
        """Batch -> per model group: design matrix and the group's row sums."""
        place = {c: i for i, c in enumerate(self.design_cols)}
        slot = {c: i for i, c in enumerate(self.outcomes)}
        compressed = self.compressed
        plan = [
            ([place[t] for t in terms], [(place[c], v) for c, v in where], [slot[self.specs[i].outcome] for i in members])
            for (terms, where), members in self.groups.items()
        ]
        design = [f"x{i}" for i in range(len(self.design_cols))]

        def rows_of(all_x, gaps, terms, where):
            ok = np.ones(len(all_x), dtype=bool)
            for i, v in where:
                ok &= all_x[:, i] == v
            for i in terms:
                if gaps[i]:
                    ok &= ~np.isnan(all_x[:, i])
            return slice(None) if ok.all() else np.flatnonzero(ok)

        def read(batch, live):
            """``live[g]``: positions of the group's models that are still wanted."""
            all_x = batch.matrix(design)
            gaps = np.isnan(all_x).any(axis=0)
            if not compressed:
                w = batch["w"]
                needed = sorted({plan[g][2][j] for g, js in enumerate(live) for j in js})
                y = {o: batch[f"y{o}"] for o in needed}
            for g, (terms, where, outs) in enumerate(plan):
                if not live[g]:
                    continue
                rows = rows_of(all_x, gaps, terms, where)
                n = len(all_x) if isinstance(rows, slice) else len(rows)
                if n == 0:
                    continue
                x = np.ones((n, len(terms) + 1), order="F")
                for c, i in enumerate(terms):
                    x[:, c + 1] = all_x[rows, i]
                outs = [outs[j] for j in live[g]]
                if compressed:
                    yield g, x, _Merged({k: batch.matrix([f"{k}{o}" for o in outs])[rows] for k in SUMS})
                else:
                    values = np.empty((n, len(outs)), order="F")
                    for c, o in enumerate(outs):
                        values[:, c] = y[o][rows]
                    yield g, x, _Plain(values, w[rows])

        return read

    def _pass(self, betas: dict[int, np.ndarray]) -> dict[int, dict]:
        """One pass over the rows for the models in ``betas``."""
        read, family = self._reader(), self.family
        members = list(self.groups.values())
        live = [[(j, m) for j, m in enumerate(ms) if m in betas] for ms in members]
        spots = [[j for j, _ in ms] for ms in live]
        widths, start = [], []
        for (terms, _), ms in zip(self.groups, live):
            p = len(terms) + 1
            start.append(len(widths))
            widths += [5 + p + p * (p + 1)] * len(ms)
        stacked = [np.column_stack([betas[m] for _, m in ms]) if ms else None for ms in live]

        def accumulate(batch, acc):
            for g, x, part in read(batch, spots):
                eta = np.clip(x @ stacked[g], -500.0, 500.0)
                if family == "poisson":
                    mu = np.exp(eta)
                    var, norm = mu, mu
                else:
                    mu = 1.0 / (1.0 + np.exp(-eta))
                    var, norm = mu * (1.0 - mu), np.logaddexp(0.0, eta)
                xx = _products(x)
                residual, squared = part.residuals(mu)
                head = part.totals()
                ll = (part.wy * eta - part.w * norm).sum(axis=0)
                packed = np.vstack([head, ll, x.T @ residual, xx.T @ (part.w * var), xx.T @ squared])
                for c in range(packed.shape[1]):
                    acc[start[g] + c] += packed[:, c]

        flat = vector_sums(self.design, widths, accumulate)
        out = {}
        for g, ((terms, _), ms) in enumerate(zip(self.groups, live)):
            p = len(terms) + 1
            q = p * (p + 1) // 2
            for c, (_, m) in enumerate(ms):
                v = flat[start[g] + c]
                out[m] = {
                    "n": v[0], "y": v[1], "w": v[2], "wy": v[3], "ll": v[4], "score": v[5 : 5 + p],
                    "info": _square(v[5 + p : 5 + p + q], p), "meat": _square(v[5 + p + q :], p),
                }
        return out

    def _first_step(self, r: dict) -> np.ndarray | None:
        """Newton step from the intercept-only fit, read off the pass at beta = 0."""
        at_zero, slope = (1.0, 1.0) if self.family == "poisson" else (0.5, 0.25)
        gram = r["info"] / slope
        xy = r["score"] + at_zero * gram[:, 0]
        mean = r["wy"] / r["w"]
        if self.family == "poisson":
            intercept, var = np.log(mean), mean
        else:
            intercept, var = np.log(mean / (1.0 - mean)), mean * (1.0 - mean)
        beta = np.zeros(len(xy))
        beta[0] = intercept
        step, _ = self._solve(var * gram + self._penalty(len(xy)), xy - mean * gram[:, 0])
        return beta + step

    def _penalty(self, p: int) -> np.ndarray:
        d = np.full(p, self.ridge)
        d[0] = 0.0
        return np.diag(d)

    @staticmethod
    def _solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
        scale = np.sqrt(np.clip(np.diag(a), 0.0, None))
        if (scale > 0).all():
            unit = a / np.outer(scale, scale)
            if np.linalg.eigvalsh(unit)[0] > 1e-11:
                return np.linalg.solve(unit, b / scale) / scale, True
        return np.linalg.pinv(a, rcond=1e-12, hermitian=True) @ b, False

    def fit(self) -> list[Fit]:
        """Newton steps with halving until every model has settled."""
        fits = [Fit(s) for s in self.specs]
        states = {i: _State(np.zeros(len(s.terms) + 1)) for i, s in enumerate(self.specs)}
        first = True
        while states:
            results = self._pass({i: s.beta for i, s in states.items()})
            for i in list(states):
                self._advance(fits[i], states[i], results[i], first)
                if fits[i].status != "running":
                    del states[i]
            first = False
        self.fits = fits
        return fits

    def _advance(self, fit: Fit, st: _State, r: dict, first: bool) -> None:
        fit.iters += 1
        if first:
            fit.n, fit.events, fit.sum_w = int(round(r["n"])), float(r["y"]), float(r["w"])
            if fit.n < max(1, self.min_n):
                fit.status = "too_few"
            elif r["wy"] <= 0 or (self.family == "binomial" and r["wy"] >= r["w"]):
                fit.status = "no_events"
            else:
                st.beta = self._first_step(r)
            return
        penalty = self._penalty(len(st.beta))
        objective = r["ll"] - 0.5 * self.ridge * float(st.beta[1:] @ st.beta[1:])
        if st.previous is not None and objective < st.objective - 1e-10 * abs(st.objective) and st.halvings < 30:
            st.beta = 0.5 * (st.beta + st.previous)
            st.halvings += 1
            return
        bread = r["info"] + penalty
        step, full_rank = self._solve(bread, r["score"] - penalty @ st.beta)
        rms = np.sqrt(np.clip(np.diag(r["info"]), 0.0, None) / max(r["info"][0, 0], 1e-300))
        st.previous, st.objective, st.halvings = st.beta, objective, 0
        st.beta = st.beta + step
        if np.max(np.abs(step) * rms) < self.tol:
            inverse = np.linalg.pinv(bread, rcond=1e-12, hermitian=True) if not full_rank else self._inverse(bread)
            fit.beta, fit.cov = st.beta, inverse @ r["meat"] @ inverse
            fit.status = "ok" if full_rank else "rank_deficient"
        elif fit.iters >= self.max_passes:
            fit.beta, fit.status = st.beta, "not_converged"

    def _inverse(self, a: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.diag(a))
        return np.linalg.inv(a / np.outer(scale, scale)) / np.outer(scale, scale)

    def _of(self, only: Sequence[ModelSpec] | None) -> list[Fit]:
        fits, ids = self.fits or self.fit(), None if only is None else {s.model_id for s in only}
        return [f for f in fits if ids is None or f.spec.model_id in ids]

    def fit_frame(self, only: Sequence[ModelSpec] | None = None) -> DataFrame:
        """One row per model (the number of models is fixed by the specs); ``only``: the models of one question."""
        fits = self._of(only)
        rows = [
            (
                f.spec.model_id, f.spec.outcome, f.spec.label, f.spec.rep, f.status, f.iters, f.n, f.events, f.sum_w,
                ["Intercept", *f.spec.terms],
                None if f.beta is None else [float(b) for b in f.beta],
                None if f.cov is None else [float(c) for c in f.cov.ravel()],
            )
            for f in fits
        ]
        return self.spark.createDataFrame(rows, FIT_SCHEMA)

    def risk_difference(self, delta: float = 1.0, only: Sequence[ModelSpec] | None = None) -> DataFrame:
        """Standardised risk difference for exposure + ``delta`` by g-computation,
        with the delta-method variance; one more pass for all usable models (of ``only``)."""
        fits = self.fits or self.fit()
        wanted = {f.spec.model_id for f in self._of(only)}
        read = self._reader()
        members = list(self.groups.values())
        live = [[(j, m) for j, m in enumerate(ms) if fits[m].usable and fits[m].spec.model_id in wanted] for ms in members]
        spots = [[j for j, _ in ms] for ms in live]
        widths, start = [], []
        for (terms, _), ms in zip(self.groups, live):
            start.append(len(widths))
            widths += [len(terms) + 2] * len(ms)
        stacked = [np.column_stack([fits[m].beta for _, m in ms]) if ms else None for ms in live]

        def accumulate(batch, acc):
            for g, x, part in read(batch, spots):
                w = part.w
                eta = np.clip(x @ stacked[g], -500.0, 500.0)
                low = np.clip(np.exp(eta), 0.0, 1.0)
                high = np.clip(np.exp(np.clip(eta + delta * stacked[g][1], -500.0, 500.0)), 0.0, 1.0)
                gradient = x.T @ (w * (high - low))
                gradient[1] += delta * (w * high).sum(axis=0)
                packed = np.vstack([part.totals()[2], gradient])
                for c in range(packed.shape[1]):
                    acc[start[g] + c] += packed[:, c]

        flat = vector_sums(self.design, widths, accumulate)
        rows = []
        for g, ms in enumerate(live):
            for c, (_, m) in enumerate(ms):
                v, f = flat[start[g] + c], fits[m]
                gradient = v[1:] / v[0]
                rows.append(
                    (
                        f.spec.model_id, f.spec.outcome, f.spec.label, f.spec.rep, float(gradient[0]),
                        float(np.sqrt(max(gradient @ f.cov @ gradient, 0.0))),
                    )
                )
        return self.spark.createDataFrame(rows, RD_SCHEMA)


def estimates(fits: DataFrame, term: str | None = None) -> DataFrame:
    """Long rows (model, term, b, se) of usable fits; default: the exposure term."""
    exploded = fits.filter(F.col("status").isin("ok", "rank_deficient")).select(
        "model_id", "outcome", "label", "rep", "n", "events", "sum_w", "cov",
        F.size("names").alias("_p"), F.posexplode(F.arrays_zip("names", "beta")).alias("_i", "_t"),
    )
    keep = F.col("_i") == 1 if term is None else F.col("_t.names") == term
    if term == "*":
        keep = F.lit(True)
    return exploded.filter(keep).select(
        "model_id", "outcome", "label", "rep", "n", "events", "sum_w",
        F.col("_t.names").alias("term"), F.col("_t.beta").alias("b"),
        F.sqrt(F.greatest(F.element_at("cov", (F.col("_i") * (F.col("_p") + 1) + 1).cast("int")), F.lit(0.0))).alias("se"),
    )
