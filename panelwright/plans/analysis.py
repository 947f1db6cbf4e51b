"""The full three-wave analysis, from CSV files to result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.functions.codes import cut, quoted
from panelwright.functions.formats import fmt_ci, fmt_pct, fmt_risk
from panelwright.operators import charts, describe, effects, impute, panel as pn, quantiles, spline, sweeps, weights
from panelwright.operators.glm import GlmBatch
from panelwright.plans import codebook as cb, waves
from panelwright.sources.columns import require_columns, resolve
from panelwright.sources.sinks import write_result, write_snapshot
from panelwright.sources.text import read_csv_any_encoding


def build_panel(wave1: DataFrame, wave2: DataFrame, wave3: DataFrame) -> DataFrame:
    return pn.panel_join([waves.baseline(wave1), waves.exposure(wave2), waves.outcomes(wave3)], [cb.KEY])


def weighted_panel(wave1: DataFrame, panel: DataFrame) -> DataFrame:
    """Panel rows with their censoring weight; the weight model sees the whole first wave."""
    covars = [c for c in (resolve(wave1, *names) for names in cb.FOLLOW_UP_COLUMNS) if c]
    w = weights.ipcw(wave1, panel.select(cb.KEY), [cb.KEY], covars, cb.WEIGHT, cb.FOLLOWED)
    return pn.followed_up(pn.attach(panel, w, [cb.KEY]), cb.FOLLOWED)


def distribution(before: DataFrame, after: DataFrame, col: str, weight: str, bins: int = 39, points: int = 200) -> dict[str, DataFrame]:
    """Histogram, densities, normal fit and summary before and after weighting."""
    ends = lambda d: d.agg(F.min(quoted(col)).cast("double"), F.max(quoted(col)).cast("double")).first()
    (lo, hi), (lo_after, hi_after) = ends(before), ends(after)
    a, b = lo - 5.0, hi + 5.0
    lo, hi = min(lo, lo_after) - 1.0, max(hi, hi_after) + 1.0
    hist = pn.tag_union(
        {
            "before": describe.histogram_density(before, col, lo, hi, bins),
            "after": describe.histogram_density(after, col, lo, hi, bins, weight),
        },
        "series",
    )
    shift = describe.weighting_shift(before, after, col, weight)
    fit = describe.weighted_stats(after, [col], weight).select(F.struct("w_mean", "w_sd").alias("s")).scalar()
    after_density = describe.kde(after, col, a, b, points, weight)
    density = pn.tag_union(
        {
            "before": describe.kde(before, col, a, b, points),
            "after": after_density,
            "normal": describe.normal_curve(after_density, "x", fit["w_mean"], fit["w_sd"], "density"),
        },
        "series",
    )
    return {"histogram": hist, "density": density, "shift": shift}


def with_age_group(stack: DataFrame) -> DataFrame:
    return stack.withColumn("age_group", cut("age", cb.AGE_EDGES, [0, 1]).cast("double"))


def stratified(stack: DataFrame, outcome: str, m: int, adjust: Sequence[str] = cb.COVARIATES, batch: GlmBatch | None = None) -> DataFrame:
    return sweeps.stratified_rr(with_age_group(stack), outcome, cb.SCORE_Z, cb.STRATA, adjust, cb.WEIGHT, m, batch=batch)


def fit_together(stack: DataFrame, outcomes: Sequence[str], contrast: Sequence[str], m: int) -> GlmBatch:
    """The models of the sweep, both level contrasts and the strata in one batch: one packing, shared passes."""
    wide = sweeps.with_levels(with_age_group(stack), cb.SCORE_QUARTILE, [2, 3, 4], "Q")
    wide = sweeps.with_levels(wide, cb.SCORE_TERTILE, [2, 3], "T")
    specs = [
        *sweeps.sweep_specs(outcomes, cb.SCORE_Z, cb.COVARIATES, m),
        *sweeps.level_specs(contrast, [2, 3, 4], cb.COVARIATES, m, prefix="Q"),
        *sweeps.level_specs(contrast, [2, 3], cb.COVARIATES, m, prefix="T"),
        *sweeps.strata_specs(cb.PRIMARY_OUTCOME, cb.SCORE_Z, cb.STRATA, cb.COVARIATES, m),
    ]
    batch = GlmBatch(wide, specs, cb.WEIGHT)
    batch.fit()
    return batch


def main_table(sweep: DataFrame) -> DataFrame:
    """Published column order; the two intervals get distinct names."""
    return sweep.filter(F.col("m_fitted") > 0).select(
        F.col("outcome").alias("Outcome"), "N_total", "N_events", F.col("RR").alias("rRR"), fmt_ci("LCL", "UCL").alias("rRR_CI"),
        "aRD", fmt_ci("aRD_LCL", "aRD_UCL").alias("aRD_CI"), "p", "beta_bar", "se_bar", "FDR_reject", "FDR_q",
        "Bonf_threshold", "Bonf_reject", "AbsoluteRisk_pct", "E_value_point", "E_value_CI_lower", "E_value_CI_upper",
    )


def baseline(panel: DataFrame) -> DataFrame:
    spark = panel.sparkSession
    variables = [(v, k) for v, _, k in cb.TABLE_ROWS]
    labels = spark.createDataFrame([(v, lab) for v, lab, _ in cb.TABLE_ROWS], "variable string, label string")
    if cb.SCORE_HIGH not in panel.columns:
        panel = quantiles.median_split(panel, cb.SCORE, cb.SCORE_HIGH, strict=True)
    table = describe.baseline_table(panel, variables, cb.SCORE_HIGH, cb.WEIGHT)
    return describe.baseline_display(table, describe.group_sizes(panel, cb.SCORE_HIGH, cb.WEIGHT), labels)


def risks(panel: DataFrame) -> DataFrame:
    present = [o for o in cb.RISK_OUTCOMES if o in panel.columns]
    table = describe.absolute_risk(panel, present, cb.WEIGHT, cb.SCORE_QUARTILE, [1, 2, 3, 4])
    return table.withColumn("Risk_95CI", fmt_risk("risk_pct", "risk_lcl_pct", "risk_ucl_pct"))


def run(
    spark: SparkSession, paths: Sequence[str], out_dir: str, m: int = cb.IMPUTATIONS, rounds: int = cb.IMPUTATION_ROUNDS,
    seed: int = cb.SEED, graphs: bool = True, graph_options: Mapping | None = None,
) -> dict[str, DataFrame]:
    """Run everything and write every result table under ``out_dir``.

    The panel and the imputation stack are written first and read back, so the
    later stages start from stored tables instead of a long lineage.
    """
    raw = [require_columns(read_csv_any_encoding(spark, p)[0], [cb.KEY], p) for p in paths]
    joined = build_panel(*raw)
    write_snapshot(weighted_panel(raw[0], joined), f"{out_dir}/panel_ready")
    panel = spark.read.parquet(f"{out_dir}/panel_ready")
    write_snapshot(impute.mice(panel, [cb.KEY], cb.COVARIATES, m, rounds, seed), f"{out_dir}/imputations")
    stack = spark.read.parquet(f"{out_dir}/imputations")

    out: dict[str, DataFrame] = {"outcome_profile": describe.outcome_profile(panel, cb.PROFILED_OUTCOMES, [cb.SCORE_Z, cb.WEIGHT, *cb.COVARIATES])}
    for name, df in distribution(panel, panel, cb.SCORE, cb.WEIGHT).items():
        out[f"score_{name}"] = df
    contrast = [o for o in cb.CONTRAST_OUTCOMES if o in panel.columns]
    batch = fit_together(stack, [o for o in cb.OUTCOMES if o in panel.columns], contrast, m)
    sweep = sweeps.outcome_sweep(stack, panel, cb.OUTCOMES, cb.SCORE_Z, cb.COVARIATES, cb.WEIGHT, m, batch=batch)
    write_snapshot(sweep, f"{out_dir}/sweep")
    sweep = spark.read.parquet(f"{out_dir}/sweep")
    out["main_results"] = main_table(sweep)
    done = sweep.filter(F.col("m_fitted") > 0)
    book = spark.createDataFrame(list(cb.FOREST_LABELS.items()), "name string, label string")
    out["forest"] = charts.forest(done, book)
    cc = sweeps.complete_case_sweep(panel, cb.OUTCOMES, cb.SCORE_Z, cb.COVARIATES, cb.WEIGHT)
    write_snapshot(cc, f"{out_dir}/complete_case_numbers")
    cc = spark.read.parquet(f"{out_dir}/complete_case_numbers").filter(F.col("RR").isNotNull())
    out["complete_case"] = cc.withColumn("Completeness", fmt_pct("completeness_pct"))
    out["complete_case_comparison"] = charts.compare_results(done, cc, book)
    out["analysis_rollup"] = describe.rollup_results(done, cc)
    out["quartiles"] = sweeps.level_contrasts(stack, contrast, cb.SCORE_QUARTILE, [2, 3, 4], cb.COVARIATES, cb.WEIGHT, m, prefix="Q", batch=batch)
    out["tertiles"] = sweeps.level_contrasts(stack, contrast, cb.SCORE_TERTILE, [2, 3], cb.COVARIATES, cb.WEIGHT, m, prefix="T", batch=batch)
    strata = stratified(stack, cb.PRIMARY_OUTCOME, m, batch=batch)
    batch.close()  # what is left works on the fitted rows
    write_snapshot(strata, f"{out_dir}/strata_numbers")
    strata = spark.read.parquet(f"{out_dir}/strata_numbers")
    out["stratified"] = strata.withColumn("AbsoluteRisk", fmt_pct("absolute_risk_pct"))
    strata = strata.filter(F.col("RR").isNotNull())
    out["heterogeneity"] = effects.cochran_q(strata, ["category"])
    overall = done.filter(F.col("outcome") == cb.PRIMARY_OUTCOME).select(
        F.col("N_total").alias("n"), F.col("N_events").alias("events"), "RR", "LCL", "UCL", "p"
    )
    out["stratified_forest"] = charts.stratified_forest(
        overall, strata.withColumnRenamed("n_sum", "n"), [(c, label) for c, _, levels in cb.STRATA for _, label in levels]
    )
    out["baseline_table"] = baseline(panel)
    out["absolute_risk"] = risks(panel)
    out["spline"] = spline.spline_rr(panel, cb.PRIMARY_OUTCOME, cb.SCORE, cb.WEIGHT, cb.COVARIATES, *cb.SCORE_RANGE, cb.SCORE_REFERENCE)
    if out["spline"].first()["status"] not in ("ok", "rank_deficient"):
        out["spline_fallback"] = spline.quantile_means(panel, cb.PRIMARY_OUTCOME, cb.SCORE)
    if graphs:
        from panelwright.plans.graphs import discover, network_tables

        edges, variables, out["graph_runs"] = discover(panel, [cb.KEY], cb.GRAPH_SUBSETS, with_runs=True, **(graph_options or {}))
        write_snapshot(edges, f"{out_dir}/edges")
        edges = spark.read.parquet(f"{out_dir}/edges")
        out["causal_edges"] = edges
        for subset in cb.GRAPH_SUBSETS:
            nodes, classed, summary = network_tables(edges, variables, subset)
            out[f"network_{subset}_nodes"], out[f"network_{subset}_edges"], out[f"network_{subset}_summary"] = nodes, classed, summary
    for name, df in out.items():
        write_result(df, f"{out_dir}/{name}.csv")
    return {"panel": panel, "imputations": stack, **out}
