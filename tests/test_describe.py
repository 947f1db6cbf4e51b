import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions import tails
from panelwright.operators import describe as ds, panel as pn, weights


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(8)
    n = 2000
    pdf = pd.DataFrame({"x": rng.normal(30, 7, n).round(), "y": (rng.random(n) < 0.3).astype(float), "rare": (rng.random(n) < 0.002).astype(float), "w": rng.uniform(0.5, 2, n), "g": (rng.random(n) < 0.5).astype(float), "q": rng.integers(1, 4, n).astype(float)})
    pdf.loc[rng.random(n) < 0.05, "x"] = np.nan
    pdf.loc[rng.random(n) < 0.05, "g"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in df.columns]), pdf


def test_absolute_risk_edge_groups(spark):
    rows = [(1, 1.0, 2.0), (2, 1.0, 1.0), (2, 0.0, 1.0), (2, 0.0, 3.0), (3, None, 1.0), (None, 1.0, 1.0)]
    got = {r["level"]: r for r in ds.absolute_risk(spark.createDataFrame(rows, "q int, y double, w double"), ["y"], "w", "q", [1, 2, 3, 4]).collect()}
    assert got[1]["n"] == 1 and got[1]["risk_pct"] == 100.0 and got[1]["risk_lcl_pct"] is None
    se = np.sqrt(0.8**2 + 0.2**2 + 9 * 0.2**2) / 5
    assert got[2]["risk_pct"] == pytest.approx(20.0) and got[2]["risk_ucl_pct"] == pytest.approx(100 * (0.2 + 1.96 * se))
    assert got[2]["risk_lcl_pct"] == 0.0
    for level in (3, 4):
        assert got[level]["n"] == 0 and got[level]["risk_pct"] is None and got[level]["events_unweighted"] == 0 and got[level]["sum_weights"] == 0.0


def test_baseline_table_numbers(people):
    df, pdf = people
    t = {r["variable"]: r for r in ds.baseline_table(df, [("x", "continuous"), ("y", "binary"), ("rare", "binary"), ("gone", "binary")], "g", "w").collect()}
    high = pdf["g"] == 1  # a missing group counts as low
    lo, hi = pdf[~high].dropna(subset=["x"]), pdf[high].dropna(subset=["x"])
    mean = lambda d, c: np.average(d[c], weights=d["w"])
    var = lambda d, c: np.average((d[c] - mean(d, c)) ** 2, weights=d["w"])
    pooled = np.sqrt(((len(lo) - 1) * var(lo, "x") + (len(hi) - 1) * var(hi, "x")) / (len(lo) + len(hi) - 2))
    assert t["x"]["low_mean"] == pytest.approx(mean(lo, "x")) and t["x"]["all_sd"] == pytest.approx(np.sqrt(var(pdf.dropna(subset=["x"]), "x")))
    assert t["x"]["smd"] == pytest.approx(abs(mean(hi, "x") - mean(lo, "x")) / pooled)
    sp = np.sqrt(((len(lo) - 1) * lo["x"].var() + (len(hi) - 1) * hi["x"].var()) / (len(lo) + len(hi) - 2))
    stat = (lo["x"].mean() - hi["x"].mean()) / (sp * np.sqrt(1 / len(lo) + 1 / len(hi)))
    assert t["x"]["t_stat"] == pytest.approx(stat) and t["x"]["p"] == pytest.approx(tails.t_two_sided(stat, len(lo) + len(hi) - 2))
    cells = [int(pdf[~high]["y"].sum()), int((pdf[~high]["y"] == 0).sum()), int(pdf[high]["y"].sum()), int((pdf[high]["y"] == 0).sum())]
    assert [t["y"][c] for c in ("low_yes", "low_no", "high_yes", "high_no")] == cells
    assert t["y"]["p"] == pytest.approx(tails.chi2_2x2(*cells))
    few = [t["rare"][c] for c in ("low_yes", "low_no", "high_yes", "high_no")]
    assert min(few) < 5 and t["rare"]["p"] == pytest.approx(tails.fisher_2x2(*few))
    assert t["gone"]["all_n"] is None and t["gone"]["p"] is None


def test_printed_table_starts_with_the_header(people, spark):
    df, _ = people
    labels = spark.createDataFrame([("x", "Score")], "variable string, label string")
    rows = ds.baseline_display(ds.baseline_table(df, [("x", "continuous"), ("gone", "binary")], "g", "w"), ds.group_sizes(df, "g", "w"), labels).collect()
    assert rows[0]["Variable"] == "Characteristic" and rows[0]["All participants"] == "(n=2,000)"
    assert rows[1]["Variable"] == "Score" and "±" in rows[1]["Low"] and rows[2]["SMD"] == "NA"


def test_histogram_and_density_match_numpy(people):
    df, pdf = people
    kept = pdf.dropna(subset=["x"])
    lo, hi = kept["x"].min() - 1, kept["x"].max() + 1
    got = ds.histogram_density(df, "x", lo, hi, 39, "w").toPandas().sort_values("bin")
    want = np.histogram(kept["x"], bins=np.linspace(lo, hi, 40), weights=kept["w"], density=True)[0]
    assert got["density"].to_numpy() == pytest.approx(want, abs=1e-12) and got["n"].sum() == len(kept)
    edge = ds.histogram_density(df.filter("x is not null"), "x", kept["x"].min(), kept["x"].max(), 10).toPandas()
    assert edge["n"].sum() == len(kept)
    k = ds.kde(df, "x", lo, hi, 50, "w").toPandas().sort_values("point")
    w = kept["w"].to_numpy() / kept["w"].sum()
    neff = 1 / (w**2).sum()
    h = neff ** -0.2 * np.sqrt(np.cov(kept["x"], aweights=w))
    grid = np.linspace(lo, hi, 50)
    want = (w * np.exp(-0.5 * ((grid[:, None] - kept["x"].to_numpy()) / h) ** 2)).sum(axis=1) / (h * np.sqrt(2 * np.pi))
    assert k["density"].to_numpy() == pytest.approx(want, rel=1e-8)


def test_weighting_shift_without_weights(people):
    df, pdf = people
    s = ds.weighting_shift(df, df, "x", None).first()
    assert s["mean_after"] == pytest.approx(pdf["x"].mean()) and s["delta_mean"] == pytest.approx(0.0, abs=1e-10)
    assert s["sd_after"] == pytest.approx(pdf["x"].std(ddof=0)) and s["median_before"] == pdf["x"].median()


def test_gate_counts_every_group(people):
    df, pdf = people
    kept, report = pn.gate(df, ["q"], 700)
    sizes = pdf["q"].value_counts()
    assert {r["q"]: (r["n"], r["status"]) for r in report.collect()} == {q: (n, "ok" if n > 700 else "too_few") for q, n in sizes.items()}
    assert kept.count() == sizes[sizes > 700].sum()


def test_null_keys_never_match(spark):
    a = spark.createDataFrame([(1, 1), (None, 2)], "k int, a int")
    b = spark.createDataFrame([(1, 5), (None, 6)], "k int, b int")
    assert pn.panel_join([a, b], ["k"]).count() == 1
    assert [r["f"] for r in pn.membership_flag(a, b, ["k"], "f").orderBy("a").collect()] == [1, 0]


def test_weights_follow_the_ridge_logistic_model(spark):
    rng = np.random.default_rng(5)
    n = 800
    pdf = pd.DataFrame({"k": np.arange(n), "SEX": rng.integers(1, 3, n).astype(str), "AGE": rng.integers(20, 80, n).astype(str)})
    pdf.loc[::11, "AGE"] = "unknown"
    age = pd.to_numeric(pdf["AGE"], errors="coerce")
    stay = rng.random(n) < 1 / (1 + np.exp(-(age.fillna(50) - 45) / 15))
    df = spark.createDataFrame(pdf)
    ids = spark.createDataFrame([(int(k),) for k in np.flatnonzero(stay)], "k bigint")
    got = weights.ipcw(df, ids, ["k"], ["SEX", "AGE", "absent"]).toPandas().sort_values("k")
    x = np.column_stack([pdf["SEX"].astype(float), age.fillna(age.median())])
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    z, b, y = np.column_stack([np.ones(n), x]), np.zeros(3), stay.astype(float)
    ridge = np.diag([0.0, 1.0, 1.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ b)
    p = np.clip(1 / (1 + np.exp(-z @ b)), 1e-6, 1 - 1e-6)
    raw = np.where(stay, y.mean() / p, (1 - y.mean()) / (1 - p))
    lo, hi = np.percentile(raw[stay], [1, 99])
    assert got["ipcw_weight"].to_numpy() == pytest.approx(np.clip(raw, lo, hi), abs=1e-8)
    assert (got["complete3"].to_numpy() == stay).all()
    plain = weights.ipcw(df, ids, ["k"], ["absent"]).toPandas()
    assert (plain["ipcw_weight"] == 1.0).all() and plain["complete3"].sum() == stay.sum()
