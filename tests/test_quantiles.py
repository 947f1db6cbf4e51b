import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators import quantiles as qn
from panelwright.operators.multiplicity import bonferroni, fdr_bh
from panelwright.operators.sampling import weighted_resample


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": rng.integers(0, 3, 3000), "x": np.where(rng.random(3000) < 0.33, 7.0, rng.normal(5, 3, 3000).round(3)), "w": rng.random(3000)})
    pdf.loc[::17, "x"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x"))).repartition(7)
    return df, pdf


@pytest.mark.parametrize("per_range", [1_000_000, 90])
def test_quantiles_match_linear_interpolation(scores, per_range):
    df, pdf = scores
    probs = [0, 0.1, 0.25, 0.5, 1 / 3, 0.99, 1]
    got = qn.exact_quantiles(df, ["x"], probs, per_range=per_range).first()[0]
    assert got == pytest.approx(np.nanquantile(pdf["x"], probs), abs=1e-12)
    by = {r["g"]: r["x"] for r in qn.exact_quantiles(df, ["x"], probs, ["g"], per_range=per_range).collect()}
    for k, part in pdf.groupby("g"):
        assert by[k] == pytest.approx(np.nanquantile(part["x"], probs), abs=1e-12)


@pytest.mark.parametrize("q", [3, 4])
def test_bins_match_and_ties_stay_together(scores, q):
    df, pdf = scores
    want = pd.qcut(pdf["x"], q, labels=False, duplicates="drop") + 1
    got = qn.qcut(df, "x", q, "b").select("id", "b").toPandas().set_index("id")["b"].sort_index()
    assert got.isna().sum() == pdf["x"].isna().sum()
    ok = pdf["x"].notna()
    assert (got[ok].astype(int).to_numpy() == want[ok].astype(int).to_numpy()).all()


def test_equal_edges_give_fewer_bins(spark):
    df = spark.createDataFrame([(1.0,)] * 8 + [(2.0,), (3.0,)], "x double")
    got = {r["x"]: r["b"] for r in qn.qcut(df, "x", 4, "b").distinct().collect()}
    want = pd.qcut(pd.Series([1.0] * 8 + [2.0, 3.0]), 4, labels=False, duplicates="drop") + 1
    assert got == {1.0: int(want[0]), 2.0: int(want[8]), 3.0: int(want[9])}


def test_all_missing_score(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    out = qn.median_split(qn.qcut(qn.zscore(df, "x", "z"), "x", 4, "b"), "x", "h").collect()
    assert [(r["z"], r["b"], r["h"]) for r in out] == [(None, None, 0.0)] * 2


def test_median_split_rules(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    at = qn.median_split(df, "x", "h").collect()
    assert [r["h"] for r in at] == [0.0, 1.0, 1.0, 0.0]
    assert [r["h"] for r in qn.median_split(df, "x", "h", null_as_low=False, strict=True).collect()] == [0.0, 0.0, 1.0, None]


def test_zscore_by_group(scores):
    df, pdf = scores
    got = qn.zscore(df, "x", "z", ["g"]).select("id", "z").toPandas().set_index("id")["z"].sort_index()
    want = pdf.groupby("g")["x"].transform(lambda s: (s - s.mean()) / s.std())
    assert np.nanmax(np.abs(got.to_numpy(dtype=float) - want.to_numpy())) < 1e-12


def test_weighted_quantile_is_first_value_reaching_the_share(scores):
    df, pdf = scores
    kept = pdf.dropna(subset=["x"]).sort_values("x")
    cum = kept["w"].cumsum().to_numpy()
    want = kept["x"].to_numpy()[np.searchsorted(cum, cum[-1] / 2)]
    assert qn.weighted_quantile(df, "x", "w", per_range=100).first()["quantile"] == want


@pytest.mark.parametrize("per_range", [100, 7, 1])
def test_running_totals_do_not_depend_on_the_ranges(scores, per_range):
    df, _ = scores
    v = df.filter("x is not null").groupBy("g", "x").agg(F.count("*").alias("n"))
    whole = {(r["g"], r["x"]): r["cum"] for r in qn.running_totals(v, "x", "n", ["g"]).collect()}
    split = {(r["g"], r["x"]): r["cum"] for r in qn.running_totals(v, "x", "n", ["g"], per_range=per_range).collect()}
    assert whole == split


def _bh(p):
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
    out = np.empty(len(p))
    out[order] = np.minimum(q, 1)
    return out


@pytest.mark.parametrize("per_range", [1_000_000, 30])
def test_step_up_q_values(spark, per_range):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(400) ** 3, 3)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(400), "f": np.arange(400) % 2, "p": p}))
    out = bonferroni(fdr_bh(df, family=["f"], per_range=per_range), family=["f"]).toPandas().sort_values("id")
    for f in (0, 1):
        mine = out[out["f"] == f]
        assert mine["FDR_q"].to_numpy() == pytest.approx(_bh(p[f::2]), abs=1e-12)
        assert (mine["FDR_q"] >= mine["p"] - 1e-15).all()
        assert (mine["Bonf_threshold"] == 0.05 / 200).all()
    assert (out["FDR_reject"] == (out["FDR_q"] <= 0.05)).all()


def test_resample_follows_the_weights_and_is_reproducible(spark):
    df = spark.createDataFrame([(float(i), 10.0 if i == 3 else 1.0, i) for i in range(20)] + [(99.0, 0.0, 20)], "x double, w double, i int")
    one = weighted_resample(df, "x", "w", 20000, 5, per_range=1000).toPandas()
    two = weighted_resample(df.repartition(5), "x", "w", 20000, 5).toPandas()
    assert len(one) == 20000 and one["x"].notna().all()
    a, b = one.sort_values("draw")["x"].to_numpy(), two.sort_values("draw")["x"].to_numpy()
    assert (a == b).all()
    share = one["x"].value_counts(normalize=True)
    assert share[3.0] == pytest.approx(10 / 29, abs=0.02) and 99.0 not in share.index


def test_nan_is_missing_at_any_number_of_ranges(spark):
    rows = [(float(i), i % 2) for i in range(200)] + [(float("nan"), 0), (None, 1), (float("nan"), None), (5.0, None)]
    df = spark.createDataFrame(rows, "x double, g int")
    for per_range in (1_000_000, 20):
        got = {r["g"]: r["x"] for r in qn.exact_quantiles(df, ["x"], [0, 0.5, 1], ["g"], per_range=per_range).collect()}
        assert got == {0: [0.0, 99.0, 198.0], 1: [1.0, 100.0, 199.0], None: [5.0, 5.0, 5.0]}
    split = qn.median_split(df, "x", "h").filter("x IS NULL OR isnan(x)").collect()
    assert [r["h"] for r in split] == [0.0] * 3
    assert qn.qcut(df, "x", 2, "b").filter("b IS NULL").count() == 3


def test_groups_without_values_keep_their_row(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "g int, x double")
    assert {r["g"]: r["x"] for r in qn.exact_quantiles(df, ["x"], [0.5], ["g"]).collect()} == {1: None, 2: [3.0]}


def _wide(n=4000, seed=11):
    """Values of all magnitudes and signs, many of them neighbours to the last bit."""
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), 1.0 + np.arange(n) * 2.0**-52, -1.0 - np.arange(n // 2) * 2.0**-52, [0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324]])
    rng.shuffle(x)
    return x


def test_order_image_keeps_the_order(spark):
    x = _wide()
    got = np.array([r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(qn.order_image("x")).collect()])
    by = np.argsort(got, kind="stable")
    assert (np.diff(x[by]) >= 0).all() and len(np.unique(got)) == len(np.unique(x))


@pytest.mark.parametrize("per_range", [1_000_000, 50, 1])
def test_selection_through_all_rounds(spark, per_range):
    x = np.sort(_wide())
    df = spark.createDataFrame([(float(v), float(i % 3)) for i, v in enumerate(x)], "x double, w double").repartition(6)
    probs = [0, 0.3, 0.5, 0.7, 1]
    finite = df.filter("abs(x) < 1e308 OR x IS NULL")
    want = np.quantile(x[np.isfinite(x) & (np.abs(x) < 1e308)], probs)
    assert qn.exact_quantiles(finite, ["x"], probs, per_range=per_range).first()[0] == pytest.approx(want, rel=1e-12)
    cum = np.cumsum(np.arange(len(x)) % 3)
    assert qn.weighted_quantile(df, "x", "w", 0.4, per_range=per_range).first()["quantile"] == x[np.searchsorted(cum, 0.4 * cum[-1])]


def test_plan_does_not_grow_with_the_rows(spark):
    sizes = []
    for n in (500, 50_000):
        df = spark.range(n).select((F.col("id") * 1.5).alias("x"), F.lit(1.0).alias("w"))
        plans = [qn.exact_quantiles(df, ["x"], [0.5], per_range=20), qn.running_totals(df, "x", "w", per_range=max(20, n // 20))]
        sizes.append([len(p._jdf.queryExecution().optimizedPlan().toString()) for p in plans])
    assert sizes[1][0] < 1.3 * sizes[0][0] and sizes[1][1] < 2.5 * sizes[0][1]


@pytest.mark.parametrize("per_range", [1_000_000, 3])
def test_null_groups_keep_their_totals(spark, per_range):
    df = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("a", 5.0, 1)], "g string, x double, n long")
    got = {(r["g"], r["x"]): (r["cum"], r["total"]) for r in qn.running_totals(df, "x", "n", ["g"], per_range=per_range).collect()}
    assert got == {(None, 1.0): (2, 5), (None, 2.0): (5, 5), ("a", 5.0): (1, 1)}
