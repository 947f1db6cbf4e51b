import inspect

import numpy as np
import pandas as pd
import pytest

from panelwright.operators import discovery as d, graph as g, matrix as mx
from panelwright.operators.charts import stratified_forest, tier_layout
from panelwright.plans import codebook as cb
from panelwright.plans.graphs import discover

TRUE = {("a", "b"): 0.8, ("b", "c"): -0.7, ("a", "d"): 0.5, ("c", "d"): 0.9}
VARS = ["d", "c", "b", "a"]


@pytest.fixture(scope="module")
def system(spark):
    rng = np.random.default_rng(1)
    n = 4000
    e = rng.laplace(size=(n, 4))
    a = e[:, 0]
    b = 0.8 * a + e[:, 1]
    c = -0.7 * b + e[:, 2]
    pdf = pd.DataFrame({"id": np.arange(n), "d": 0.5 * a + 0.9 * c + e[:, 3], "c": c, "b": b, "a": a})
    rows = mx.kfold(spark.createDataFrame(pdf), ["id"], 5, 1).persist()
    return rows, mx.training_moments(mx.fold_gram(rows, VARS), "s", VARS).persist(), pdf


def _edges(frame):
    return {(r["src"], r["dst"]): r["avg_coefficient"] for r in g.fold_consensus(frame, 4).collect()}


@pytest.mark.parametrize("learn", ["lingam", "golem", "dagma", "order"])
def test_learners_recover_a_known_graph(system, learn):
    rows, moments, _ = system
    found = _edges({
        "lingam": lambda: d.direct_lingam(rows, moments, VARS),
        "golem": lambda: d.golem(moments, num_iter=3000, learning_rate=3e-3, threshold=0.1),
        "dagma": lambda: d.dagma_linear(moments, learning_rate=3e-3),
        "order": lambda: d.order_search_bic(moments),
    }[learn]())
    assert set(found) == set(TRUE)
    for k, v in TRUE.items():
        assert found[k] == pytest.approx(v, abs=0.06)


@pytest.mark.parametrize("learn", ["lingam", "golem", "dagma", "order"])
def test_learners_respect_forbidden_edges(system, learn):
    rows, moments, _ = system
    bad = {("a", "b"), ("b", "c"), ("c", "b")}
    frame = {
        "lingam": lambda: d.direct_lingam(rows, moments, VARS, [bad]),
        "golem": lambda: d.golem(moments, bad, num_iter=500, learning_rate=1e-2),
        "dagma": lambda: d.dagma_linear(moments, bad, learning_rate=3e-3, max_iter=500),
        "order": lambda: d.order_search_bic(moments, bad),
    }[learn]()
    assert not bad & {(r["src"], r["dst"]) for r in frame.collect()}


def test_folds_and_moments_add_up(system):
    rows, moments, pdf = system
    sizes = [r["count"] for r in rows.groupBy("fold").count().collect()]
    assert len(sizes) == 5 and sum(sizes) == len(pdf) and max(sizes) - min(sizes) < 0.2 * len(pdf) / 5
    z = np.column_stack([np.ones(len(pdf)), pdf[VARS]])
    fold = rows.toPandas().set_index("id")["fold"].sort_index().to_numpy()
    for r in moments.collect():
        part = z[fold != r["fold"]]
        n, mean, cov = mx.unpack(np.asarray(r["gram"]), 4)
        assert n == len(part) and mean == pytest.approx(part[:, 1:].mean(0), abs=1e-9) and cov == pytest.approx(np.cov(part[:, 1:].T, bias=True), abs=1e-9)
        raw = n * (cov + np.outer(mean, mean))
        assert raw == pytest.approx((part.T @ part)[1:, 1:], rel=1e-9, abs=1e-8)


@pytest.mark.parametrize("per_range", [1 << 16, 50])
def test_exact_folds_differ_by_a_row_at_most(spark, per_range):
    rows = [(i // 3, float(i % 50), None if i % 7 else "x") for i in range(1003)] + [(1, 0.0, None)] * 40  # repeated rows
    df = spark.createDataFrame(rows, "id int, x double, t string")
    got = mx.exact_folds(df.repartition(4), ["id"], 10, 5, per_range=per_range)
    sizes = [r["count"] for r in got.groupBy("fold").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    told = lambda d: sorted(map(str, d.collect()))
    assert told(got) == told(mx.exact_folds(df.repartition(9), ["id"], 10, 5, per_range=1 << 16))  # rows equal in everything change places unseen
    means = [r["m"] for r in got.groupBy("fold").agg({"x": "avg"}).withColumnRenamed("avg(x)", "m").collect()]
    assert max(means) - min(means) < 10  # shuffled
    assert mx.exact_folds(df.limit(0), ["id"], 3, 1).count() == 0


def test_moments_far_from_zero(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 3)) @ np.array([[1, 0.5, 0], [0, 1, -0.3], [0, 0, 1]])
    far = x + [1e9, -1e9, 0]
    df = spark.createDataFrame(pd.DataFrame({"fold": np.arange(3000) % 4, "a": far[:, 0], "b": far[:, 1], "c": far[:, 2]})).repartition(7)
    for r in mx.training_moments(mx.fold_gram(df, ["a", "b", "c"]), "s", ["a", "b", "c"]).collect():
        part = far[np.arange(3000) % 4 != r["fold"]]
        n, mean, cov = mx.unpack(np.asarray(r["gram"]), 3)
        want = np.cov((part - [1e9, -1e9, 0]).T, bias=True)
        assert n == len(part) and cov == pytest.approx(want, rel=1e-6, abs=1e-7) and mean == pytest.approx(part.mean(0), rel=1e-14, abs=1e-9)


def test_constant_columns_are_left_out(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(500), "k": 1.0, "a": rng.normal(size=500)})
    pdf["b"], pdf["c"] = pdf["a"] * 0.9 + rng.normal(size=500) * 0.5, rng.normal(size=500)
    rows = mx.kfold(spark.createDataFrame(pdf), ["id"], 3, 1)
    moments = mx.training_moments(mx.fold_gram(rows, ["k", "a", "b", "c"]), "s", ["k", "a", "b", "c"])
    for frame in (d.order_search_bic(moments), d.direct_lingam(rows, moments, ["k", "a", "b", "c"])):
        assert not any("k" in (r["src"], r["dst"]) for r in frame.collect())
    two = mx.training_moments(mx.fold_gram(rows, ["k", "a", "b"]), "s", ["k", "a", "b"])
    assert d.order_search_bic(two).count() == 0


def test_robust_scaling_keeps_binary_columns(spark):
    pdf = pd.DataFrame({"id": range(100), "flag": [i % 2 for i in range(100)], "x": np.arange(100.0), "flat": [5.0] * 100})
    pdf["x"] = pdf["x"].where(pdf["x"] != 7)
    ready, use = mx.prepare_matrix(spark.createDataFrame(pdf).replace(float("nan"), None), ["flag", "x", "flat", "absent"], ["id"])
    got = ready.toPandas().sort_values("id")
    x = pdf["x"].dropna()
    assert use == ["flag", "x", "flat"] and len(got) == 99 and set(got["flag"]) == {0.0, 1.0}
    assert got["x"].to_numpy() == pytest.approx(((x - x.median()) / (x.quantile(0.75) - x.quantile(0.25))).to_numpy())
    assert (got["flat"] == 0).all()


def test_constraints(spark):
    cat = g.catalog(spark.createDataFrame([("age",), ("bmi",), ("HI_sum_22",), ("Fever_23",)], "var string"), ["HI_sum_22"])
    pairs = lambda f: {(r["src"], r["dst"]) for r in f.collect()}
    back = {("HI_sum_22", "age"), ("HI_sum_22", "bmi"), ("Fever_23", "age"), ("Fever_23", "bmi"), ("Fever_23", "HI_sum_22")}
    assert pairs(g.forbidden_edges(cat, [])) == back
    full = g.forbidden_edges(cat, ["age"])
    assert pairs(full) == back | {("bmi", "age")}
    edges = spark.createDataFrame([("bmi", "age", 1.0), ("age", "bmi", 1.0), ("Fever_23", "bmi", 1.0), ("bmi", "bmi", 1.0), ("bmi", "Fever_23", 1.0)], "src string, dst string, coef double")
    assert pairs(g.apply_constraints(edges, cat, ["age"])) == {("age", "bmi"), ("bmi", "Fever_23")}


def test_consensus_needs_six_folds(spark):
    rows = [("s", "M", f, "a", "b", 1.0 + f) for f in range(6)] + [("s", "M", f, "b", "c", 1.0) for f in range(5)]
    got = g.with_path(g.fold_consensus(spark.createDataFrame(rows, "subset string, method string, fold int, src string, dst string, coef double"))).collect()
    assert [(r["path"], r["fold_count"], r["avg_coefficient"]) for r in got] == [("a→b", 6, 3.5)]


def test_layout_and_forest_order(spark):
    nodes = spark.createDataFrame([("b", 0), ("a", 0), ("HI", 1), ("z", 2)], "var string, tier int")
    got = {r["var"]: (r["x"], r["y"]) for r in tier_layout(nodes).collect()}
    assert got == {"a": (0.0, 0.0), "b": (0.0, 1.5), "HI": (5.0, 1.5), "z": (10.0, 0.0)}
    cols = "category string, stratum string, n int, events int, RR double, LCL double, UCL double"
    strata = spark.createDataFrame([("Sex", "Male", 1, 1, 1.0, 1.0, 1.0), ("Age", "Old", 1, 1, 1.0, 1.0, 1.0), ("Odd", "Out", 1, 1, 1.0, 1.0, 1.0)], cols)
    overall = spark.createDataFrame([(9, 3, 1.0, 1.0, 1.0)], "n int, events int, RR double, LCL double, UCL double")
    rows = stratified_forest(overall, strata, [("Age", "Old"), ("Sex", "Female"), ("Sex", "Male")]).orderBy("plot_rank").collect()
    assert [(r["stratum"], r["y_pos"]) for r in rows] == [("Overall (All participants)", 2), ("Old", 1), ("Male", 0)]


def test_all_methods_in_one_flow(spark, system):
    _, _, pdf = system
    df = spark.createDataFrame(pdf.rename(columns={"c": "HI_x", "d": "d_23"}))
    settings = {"GOLEM": {"num_iter": 1500, "learning_rate": 5e-3, "threshold": 0.1}, "DAGMA_LINEAR": {"learning_rate": 3e-3, "warm_iter": 500, "max_iter": 2000}}
    edges, variables = discover(df, ["id"], {"one": ["a", "b", "HI_x", "d_23"]}, ["HI_x"], 4, 3, immutable_mask=["a"], immutable_filter=["a"], settings=settings)
    found = {}
    for r in edges.collect():
        found.setdefault(r["method"], set()).add((r["src"], r["dst"]))
    want = {("a", "b"), ("b", "HI_x"), ("a", "d_23"), ("HI_x", "d_23")}
    assert set(found) == {"DirectLiNGAM", "GOLEM", "ORDER_BIC", "DAGMA_LINEAR"}
    assert all(want == v for v in found.values()), found
    assert variables.count() == 4


def test_queries_learn_with_the_codebook_defaults(spark, monkeypatch):
    """The registered learners run all folds, the full consensus and the learners' own iterations."""
    from checks import graphing

    seen = {}
    monkeypatch.setattr(graphing, "discover", lambda *a, **k: seen.update(inspect.signature(discover).bind(*a, **k).arguments) or (None, None))
    monkeypatch.setattr(graphing.g, "method_agreement", lambda edges: edges)
    monkeypatch.setattr(graphing.g, "edge_classes", lambda edges, marks: edges)
    monkeypatch.setattr(graphing, "_base", lambda spark, sf: spark.range(600).selectExpr("id AS orderkey", *[f"rand({k}) AS {v}" for k, v in enumerate(("quantity", "price", "discount", "tax"))]))
    graphing.discovered_graph(spark, "")
    assert seen.get("folds", cb.GRAPH_FOLDS) == cb.GRAPH_FOLDS and seen.get("min_folds", cb.GRAPH_MIN_FOLDS) == cb.GRAPH_MIN_FOLDS and not seen.get("settings")
    rows, moments, _ = graphing._learning_rows(spark, "")
    assert rows.select("fold").distinct().count() == moments.count() == cb.GRAPH_FOLDS


def test_subsets_of_variables():
    from panelwright.plans import codebook as cb
    from panelwright.plans.graphs import subset_variables

    assert {k: subset_variables(k) for k in cb.GRAPH_SUBSETS} == cb.GRAPH_SUBSETS
    both = subset_variables()
    assert len(both) == 12 + 1 + 8 and cb.SCORE in both and both[13:17] == cb.GRAPH_DISEASES[:4] and both[17:] == cb.GRAPH_SYMPTOMS[:4]
    assert cb.SCORE_HIGH in subset_variables("all", "binary") and cb.SCORE not in subset_variables("all", "binary")


def test_every_run_has_its_status(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"fold": np.arange(400) % 4, "k": 1.0, "a": rng.normal(size=400), "b": rng.normal(size=400)})
    pdf["c"] = pdf["a"] + 0.1 * rng.normal(size=400)
    rows = spark.createDataFrame(pdf)
    for use, columns, status in ((["k", "a", "b", "c"], 3, "ok"), (["k", "a", "c"], 2, "too_few")):
        moments = mx.training_moments(mx.fold_gram(rows, use), "s", use)
        runs = d.learner_runs(moments).collect()
        assert len(runs) == 4 * 4 and {r["n_columns"] for r in runs} == {columns} and {r["n_rows"] for r in runs} == {300}
        assert {r["status"] for r in runs if r["method"] == "ORDER_BIC"} == {status}
        assert {r["status"] for r in runs if r["method"] != "ORDER_BIC"} == {"ok"}
    # two columns are enough for the others
    assert d.golem(moments, set(), num_iter=300, learning_rate=5e-3).count() > 0 and d.order_search_bic(moments, set()).count() == 0
