"""The whole analysis on a small synthetic survey."""

import csv
import os

import numpy as np
import pytest

from panelwright.plans import analysis, codebook as cb, waves
from tests.survey_fixture import write_waves

FAST = {
    "folds": 3, "min_folds": 2, "methods": ("GOLEM", "ORDER_BIC"),
    "settings": {"GOLEM": {"num_iter": 200, "learning_rate": 5e-3}, "ORDER_BIC": {"sweeps": 1}},
}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("survey")
    paths = write_waves(str(folder))
    out = analysis.run(spark, paths, str(folder / "out"), m=2, rounds=1, graph_options=FAST)
    return out, folder, paths


def _column(path, name):
    with open(path, encoding="utf-8") as f:
        return [r[name] for r in csv.DictReader(f)]


def test_panel_holds_the_units_of_all_waves(run):
    out, _, paths = run
    shared = set.intersection(*[set(_column(p, "USER_ID")) for p in paths])
    panel = out["panel"].toPandas()
    assert set(panel["USER_ID"]) == shared and len(panel) == len(shared)
    assert list(panel.columns) == [cb.KEY, *cb.COVARIATES, cb.SCORE, cb.SCORE_Z, cb.SCORE_QUARTILE, cb.SCORE_TERTILE, cb.SCORE_HIGH, *[c for c in panel.columns if c.endswith("_23")], cb.WEIGHT]
    assert set(cb.OUTCOMES) <= set(panel.columns) and len(cb.OUTCOMES) == 32
    assert panel[cb.WEIGHT].between(0.2, 5).all()


def test_score_is_standardised_on_its_whole_wave(spark, run):
    _, _, paths = run
    wave2 = waves.exposure(spark.read.option("header", True).csv(paths[1])).toPandas()
    scored = wave2.dropna(subset=[cb.SCORE])
    assert scored[cb.SCORE_Z].mean() == pytest.approx(0, abs=1e-9) and scored[cb.SCORE_Z].std() == pytest.approx(1)
    assert scored[cb.SCORE].between(10, 52).all()
    assert (wave2[wave2[cb.SCORE].isna()][cb.SCORE_HIGH] == 0).all()
    assert set(scored[cb.SCORE_QUARTILE]) == {1, 2, 3, 4} and set(scored[cb.SCORE_TERTILE]) == {1, 2, 3}


def test_absent_columns_become_missing(spark):
    df = spark.createDataFrame([("u1", "1"), ("u2", "2")], "USER_ID string, sex string")
    got = waves.baseline(df).orderBy("USER_ID").collect()
    assert [r["male"] for r in got] == [1.0, 0.0] and got[0]["age"] is None and got[0]["bmi"] is None
    assert waves.exposure(df).first()[cb.SCORE] is None
    assert waves.outcomes(df).first()[cb.INFECTION] is None


def test_known_effect_is_recovered(run):
    out, _, _ = run
    main = out["main_results"].toPandas().set_index("Outcome")
    assert len(main) == 32
    hospital = main.loc["HospitalizationPastYear_23"]
    assert hospital["rRR"] == pytest.approx(np.exp(0.25), abs=0.12) and hospital["p"] < 0.01 and hospital["E_value_point"] > 1
    assert (main["FDR_q"] >= main["p"] - 1e-12).all() and main["Bonf_threshold"].iloc[0] == pytest.approx(0.05 / 32)
    null = main.loc["COVID19_Vaccination_23"]
    assert abs(np.log(null["rRR"])) < 0.1


def test_every_table_is_written(run):
    out, folder, _ = run
    assert {"main_results", "complete_case", "quartiles", "tertiles", "stratified", "baseline_table", "absolute_risk", "spline",
            "causal_edges", "forest", "complete_case_comparison", "stratified_forest", "score_histogram", "score_density",
            "score_shift", "heterogeneity", "network_disease_nodes", "network_symptoms_edges", "outcome_profile"} <= set(out)
    for name in out:
        if name not in ("panel", "imputations"):
            assert os.path.exists(folder / "out" / f"{name}.csv" / "_SUCCESS"), name


def test_shapes_of_sensitivity_tables(run):
    out, _, _ = run
    assert out["quartiles"].count() == 12 and out["tertiles"].count() == 8
    assert out["stratified"].count() == 6 and out["stratified_forest"].count() == 7 and out["heterogeneity"].count() == 3
    assert out["absolute_risk"].count() == 8 and out["spline"].count() == 40
    assert out["baseline_table"].count() == len(cb.TABLE_ROWS) + 1 == 46
    stack = out["imputations"].toPandas()
    assert len(stack) == 2 * out["panel"].count() and stack[cb.COVARIATES].notna().all().all()


def test_edges_respect_the_waves(run):
    out, _, _ = run
    rank = lambda v: 2 if "_23" in v else 1 if v in cb.EXPOSURES else 0
    for r in out["causal_edges"].collect():
        assert rank(r["src"]) <= rank(r["dst"]) and r["dst"] not in cb.IMMUTABLE_FILTER


def test_missing_key_is_refused(spark, tmp_path):
    paths = []
    for i in range(3):
        p = tmp_path / f"w{i}.csv"
        p.write_text("id,x\n1,2\n")
        paths.append(str(p))
    with pytest.raises(KeyError):
        analysis.run(spark, paths, str(tmp_path / "out"))
