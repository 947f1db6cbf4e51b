"""Batched models against plain numpy fits and the library's own regression."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from panelwright.operators import effects, sweeps
from panelwright.operators.glm import GlmBatch, ModelSpec, estimates
from panelwright.operators.panel import replicate
from panelwright.operators.spline import basis_columns, spline_rr


def newton(x, y, w, steps=40):
    """Reference fit: coefficients and HC0 covariance."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    b[0] = np.log((w * y).sum() / w.sum())
    for _ in range(steps):
        mu = np.exp(x @ b)
        b = b + np.linalg.solve(x.T @ (x * (w * mu)[:, None]), x.T @ (w * (y - mu)))
    mu = np.exp(x @ b)
    bread = np.linalg.inv(x.T @ (x * (w * mu)[:, None]))
    score = x * (w * (y - mu))[:, None]
    return b, bread @ (score.T @ score) @ bread


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(11)
    n = 3000
    pdf = pd.DataFrame({
        "id": np.arange(n), "x": rng.normal(size=n), "male": rng.integers(0, 2, n).astype(float), "age": rng.normal(50, 12, n),
        "w": rng.uniform(0.5, 2.0, n), "s": rng.integers(0, 2, n).astype(float),
    })
    risk = np.minimum(0.9, 0.2 * np.exp(0.3 * pdf["x"] + 0.2 * pdf["male"]))
    pdf["y"] = (rng.random(n) < risk).astype(float)
    pdf["y2"] = (rng.random(n) < 0.4).astype(float)
    holes = pdf.copy()
    holes.loc[rng.random(n) < 0.1, "age"] = np.nan
    holes.loc[rng.random(n) < 0.1, "y2"] = np.nan
    holes.loc[rng.random(n) < 0.05, "w"] = np.nan
    df = spark.createDataFrame(holes)
    df = df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    return df, holes


def fitted(df, specs, w="w", **kw):
    batch = GlmBatch(df, specs, w, **kw)
    out = batch.fit()
    batch.close()
    return out


@pytest.mark.parametrize("compress", [False, True])
def test_matches_plain_newton_with_listwise_deletion(cohort, compress):
    df, pdf = cohort
    specs = [
        ModelSpec("a", "y", ("x", "male", "age")), ModelSpec("b", "y2", ("x", "male", "age")),
        ModelSpec("c", "y", ("male",), (("s", 1.0),)), ModelSpec("d", "y", ("x", "male"), (("s", 0.0),)),
    ]
    for fit in fitted(df, specs, compress=compress):
        s = fit.spec
        use = pdf.dropna(subset=[s.outcome, "w", *s.terms])
        for c, v in s.where:
            use = use[use[c] == v]
        b, v = newton(use[list(s.terms)].to_numpy(), use[s.outcome].to_numpy(), use["w"].to_numpy())
        assert fit.status == "ok" and fit.n == len(use) and fit.events == use[s.outcome].sum()
        assert fit.beta == pytest.approx(b, abs=1e-9)
        assert fit.cov == pytest.approx(v, rel=1e-6, abs=1e-12)


def test_same_result_for_any_partitioning(cohort):
    df, _ = cohort
    spec = [ModelSpec("a", "y", ("x", "male", "age"))]
    base = fitted(df.coalesce(1), spec)[0]
    for parts in (4, 16):
        other = fitted(df.orderBy(F.rand(parts)).repartition(parts), spec)[0]
        assert other.beta == pytest.approx(base.beta, abs=1e-10)
        assert other.cov == pytest.approx(base.cov, rel=1e-8, abs=1e-14)


def test_agrees_with_library_regression(cohort):
    df, _ = cohort
    use = df.na.drop()
    ready = VectorAssembler(inputCols=["x", "male", "age"], outputCol="features").transform(use)
    lib = GeneralizedLinearRegression(family="poisson", link="log", weightCol="w", labelCol="y", tol=1e-12).fit(ready)
    mine = fitted(use, [ModelSpec("a", "y", ("x", "male", "age"))])[0]
    assert mine.beta == pytest.approx([lib.intercept, *lib.coefficients], abs=1e-7)


def test_statuses(spark):
    rows = [(0.0, float(i % 2), 1.0, 1.0, float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "never double, y double, w double, const double, x double")
    got = {f.spec.model_id: f.status for f in fitted(df, [
        ModelSpec("none", "never", ("x",)), ModelSpec("flat", "y", ("const",)), ModelSpec("fine", "y", ("x",)),
        ModelSpec("empty", "y", ("x",), (("x", -5.0),)),
    ])}
    assert got == {"none": "no_events", "flat": "rank_deficient", "fine": "ok", "empty": "too_few"}
    assert fitted(df, [ModelSpec("few", "y", ("x",))], min_n=201)[0].status == "too_few"


def test_known_ratio_is_recovered(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, 20000).astype(float)
    y = (rng.random(20000) < np.where(x == 1, 0.3, 0.2)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    f = fitted(df, [ModelSpec("a", "y", ("x",))], None)[0]
    p1, p0 = y[x == 1].mean(), y[x == 0].mean()
    assert f.beta[1] == pytest.approx(np.log(p1 / p0), abs=1e-10)
    assert f.cov[1, 1] == pytest.approx((1 - p1) / (p1 * (x == 1).sum()) + (1 - p0) / (p0 * (x == 0).sum()), rel=1e-8)


def test_risk_difference_by_hand(cohort):
    df, pdf = cohort
    batch = GlmBatch(df, [ModelSpec("a", "y", ("x", "male"))], "w")
    batch.fit()
    got = batch.risk_difference(1.0).first()
    use = pdf.dropna(subset=["y", "w", "x", "male"])
    z, w = use[["x", "male"]].to_numpy(), use["w"].to_numpy()
    b, v = newton(z, use["y"].to_numpy(), w)
    x0 = np.column_stack([np.ones(len(z)), z])
    x1 = x0 + np.array([0, 1.0, 0])
    m0, m1 = np.minimum(np.exp(x0 @ b), 1), np.minimum(np.exp(x1 @ b), 1)
    g = (w[:, None] * (m1[:, None] * x1 - m0[:, None] * x0)).sum(axis=0) / w.sum()
    assert got["b"] == pytest.approx((w * (m1 - m0)).sum() / w.sum(), abs=1e-10)
    assert got["se"] == pytest.approx(np.sqrt(g @ v @ g), rel=1e-7)


def test_pooling_rules(spark):
    df = spark.createDataFrame([("a", 0.1, 0.02), ("a", 0.3, 0.04), ("b", 0.2, 0.05)], "k string, b double, se double")
    got = {r["k"]: r for r in effects.risk_ratio(effects.rubin_pool(df, ["k"])).collect()}
    within, between = (0.02**2 + 0.04**2) / 2, np.var([0.1, 0.3], ddof=1)
    assert got["a"]["T"] == pytest.approx(within + 1.5 * between)
    assert got["b"]["B"] == 0.0 and got["b"]["T"] == pytest.approx(0.05**2)
    assert got["b"]["RR"] == pytest.approx(np.exp(0.2)) and 0 < got["b"]["p"] < 1e-4


def test_e_values(spark):
    rows = [(0.8, 0.7, 0.9), (1.1, 0.9, 1.3), (2.0, 1.5, 2.6), (1.0, 0.9, 1.1)]
    got = effects.e_value(spark.createDataFrame(rows, "RR double, LCL double, UCL double")).collect()
    e = lambda v: v + np.sqrt(v * (v - 1))
    assert [got[0][f"E_value_{k}"] for k in ("point", "CI_lower", "CI_upper")] == pytest.approx([e(1 / 0.8), e(1 / 0.9), e(1 / 0.7)])
    assert [got[1][f"E_value_{k}"] for k in ("point", "CI_lower", "CI_upper")] == pytest.approx([e(1.1), 1.0, e(1.3)])
    assert got[3]["E_value_point"] == 1.0


def test_sweep_keeps_failed_outcomes_with_their_status(cohort):
    df, _ = cohort
    panel = df.withColumn("never", F.lit(0.0))
    out = {r["outcome"]: r for r in sweeps.outcome_sweep(replicate(panel, 2), panel, ["y", "never", "absent"], "x", ["male"], "w", 2).collect()}
    assert set(out) == {"y", "never"}
    assert out["never"]["status"] == "no_events" and out["never"]["RR"] is None and out["never"]["FDR_q"] is None
    assert out["y"]["status"] == "ok" and out["y"]["Bonf_threshold"] == 0.05 and out["y"]["m"] == 2


def test_sweeps_without_outcomes_keep_their_schema(cohort):
    df, _ = cohort
    for with_p in (True, False):
        full = sweeps.outcome_sweep(df, df, ["y"], "x", [], "w", 1, None, with_p=with_p)
        none = sweeps.outcome_sweep(df, df, ["absent"], "x", [], "w", 1, None, with_p=with_p)
        assert none.count() == 0 and none.dtypes == full.dtypes
        cc = sweeps.complete_case_sweep(df, ["y"], "x", [], "w", with_p=with_p)
        none = sweeps.complete_case_sweep(df, ["absent"], "x", [], "w", with_p=with_p)
        assert none.count() == 0 and none.dtypes == cc.dtypes


def test_strata_below_the_gate_keep_their_row(cohort):
    df, pdf = cohort
    wide = df.withColumn("tiny", (F.col("id") < 90).cast("double"))
    got = sweeps.stratified_rr(wide, "y", "x", [("Size", "tiny", [(0, "rest"), (1, "tiny")])], ["male", "tiny"], "w", 1, None).collect()
    assert {r["stratum"]: (r["status"], r["m_fitted"], r["RR"] is None) for r in got} == {"rest": ("ok", 1, False), "tiny": ("below_gate", 0, True)}
    got = [r for r in got if r["stratum"] == "rest"]
    assert got[0]["rows_first"] == (pdf["id"] >= 90).sum()


def test_fractional_imputed_values_belong_to_no_stratum(cohort):
    df, pdf = cohort
    wide = df.withColumn("male", F.when(F.col("id") % 2 == 0, 0.37).otherwise(F.col("male")))
    got = {r["stratum"]: r["rows_first"] for r in sweeps.stratified_rr(wide, "y", "x", [("Sex", "male", [(0, "F"), (1, "M")])], ["male"], "w", 1, None).collect()}
    odd = pdf[pdf["id"] % 2 == 1]["male"]
    assert got == {"F": (odd == 0).sum(), "M": (odd == 1).sum()}


def test_spline_basis_is_a_partition_of_unity(spark):
    df = spark.range(0, 101).select((F.col("id") / 100 * 39 + 13).alias("x"))
    for interior in ([], [25.0], [20.0, 30.0, 40.0]):
        cols = basis_columns(F.col("x"), interior, 13.0, 52.0)
        got = df.select("x", *[c.alias(f"b{i}") for i, c in enumerate(cols)]).toPandas()
        rest = 1 - got[[f"b{i}" for i in range(len(cols))]].sum(axis=1)
        assert len(cols) == 3 + len(interior)
        assert (rest > -1e-12).all() and rest.iloc[0] == pytest.approx(1.0) and rest.iloc[-1] == pytest.approx(0.0, abs=1e-12)


def test_spline_reference_and_gate(cohort):
    df, _ = cohort
    wide = df.withColumn("score", F.round(F.col("x") * 6 + 30))
    curve = {r["x"]: r for r in spline_rr(wide, "y", "score", "w", ["male"]).collect()}
    assert len(curve) == 40 and curve[29.0]["RR"] == pytest.approx(1.0) and curve[29.0]["LCL"] == pytest.approx(1.0)
    assert curve[40.0]["RR"] > 1.0 > curve[20.0]["RR"]
    assert spline_rr(wide.limit(50), "y", "score", "w", ["male"]).first()["status"] == "too_few"


def test_coefficient_lookup_from_fit_rows(cohort):
    df, pdf = cohort
    batch = GlmBatch(df, [ModelSpec("a", "y", ("x", "male"))], "w")
    fit = batch.fit()[0]
    rows = {r["term"]: r for r in estimates(batch.fit_frame(), "*").collect()}
    batch.close()
    for i, term in enumerate(["Intercept", "x", "male"]):
        assert rows[term]["b"] == fit.beta[i] and rows[term]["se"] == pytest.approx(np.sqrt(fit.cov[i, i]))
