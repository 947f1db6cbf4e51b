"""Model sweeps: many outcomes, levels, strata and imputations at once.

Each function turns its question into model specs, lets one batch fit them all
and pools the estimates. Questions about the same rows can share a batch: fit
the specs of all of them together and pass it on as ``batch``. A model that cannot be fitted keeps its row with a
``status`` instead of disappearing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from panelwright.functions.codes import bin_indicator, product, quoted
from panelwright.operators.describe import to_long, weighted_stats
from panelwright.operators.effects import e_value, percent_difference, risk_ratio, rubin_pool, wald_p
from panelwright.operators.glm import GlmBatch, ModelSpec, estimates
from panelwright.operators.multiplicity import bonferroni, fdr_bh


SWEEP_SCHEMA = (
    "outcome string, status string, m_requested bigint, m_fitted bigint, N_total bigint, N_events bigint, m bigint, RR double, LCL double, UCL double, "
    "beta_bar double, se_bar double, aRD double, aRD_LCL double, aRD_UCL double, AbsoluteRisk_pct double, "
    "E_value_point double, E_value_CI_lower double, E_value_CI_upper double"
)
TEST_SCHEMA = ", p double, FDR_q double, FDR_reject boolean, Bonf_threshold double, Bonf_reject boolean"
COMPLETE_SCHEMA = (
    "outcome string, status string, N_complete bigint, N_events bigint, completeness_pct double, RR double, LCL double, "
    "UCL double, {p}E_value_point double, E_value_CI_lower double, E_value_CI_upper double, AbsoluteRisk_pct double"
)


def _where(chain_col: str | None, rep: int, *more: tuple[str, float]) -> tuple:
    return (*(((chain_col, float(rep)),) if chain_col else ()), *more)


#: Severity of a fit's outcome, mildest first.
_STATUSES = ("ok", "rank_deficient", "not_converged", "too_few", "no_events")


def _status_of(fits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Requested and fitted models of each estimate, and the worst status among them."""
    rank = F.array_position(F.array(*[F.lit(s) for s in _STATUSES]), F.col("status"))
    return fits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("m_requested"), F.count_if(F.col("status").isin("ok", "rank_deficient")).alias("m_fitted"),
        F.max_by("status", rank).alias("status"),
    )


def _with_status(pooled: DataFrame, fits: DataFrame, by: Sequence[str]) -> DataFrame:
    return _status_of(fits, by).join(pooled, list(by), "left")


def sweep_specs(outcomes: Sequence[str], exposure: str, adjust: Sequence[str], m: int = 1, chain_col: str | None = "mi_id") -> list[ModelSpec]:
    return [
        ModelSpec(f"sweep|{o}|{k}", o, (exposure, *adjust), _where(chain_col, k), rep=k) for o in outcomes for k in range(1, m + 1)
    ]


def _fitted(batch: GlmBatch | None, stack: DataFrame, specs: Sequence[ModelSpec], weight: str, compress: bool, then):
    """``then(batch)`` on the shared batch, or on one made for these specs and closed again."""
    own = batch or GlmBatch(stack, specs, weight, compress=compress)
    try:
        return then(own)
    finally:
        if batch is None:
            own.close()


def outcome_sweep(
    stack: DataFrame, panel: DataFrame, outcomes: Sequence[str], exposure: str, adjust: Sequence[str],
    weight: str, m: int = 1, chain_col: str | None = "mi_id", delta: float = 1.0, family_alpha: float = 0.05,
    compress: bool = False, with_p: bool = True, batch: GlmBatch | None = None,
) -> DataFrame:
    """Per outcome: pooled ratio and risk difference, E-values, weighted risk,
    and (``with_p``) p-values with both multiplicity corrections.

    ``stack`` holds ``m`` imputations; prevalence and counts come from ``panel``.
    """
    outcomes = [o for o in outcomes if o in panel.columns]
    if not outcomes:
        return panel.sparkSession.createDataFrame([], SWEEP_SCHEMA + (TEST_SCHEMA if with_p else ""))
    specs = sweep_specs(outcomes, exposure, adjust, m, chain_col)
    fits, diffs = _fitted(batch, stack, specs, weight, compress, lambda b: (b.fit_frame(specs), b.risk_difference(delta, specs)))
    rd = percent_difference(rubin_pool(diffs, ["outcome"]))
    rr = e_value(risk_ratio(rubin_pool(estimates(fits), ["outcome"]), with_p))
    if with_p:  # on the few pooled rows, before the joins that read the panel
        rr = bonferroni(fdr_bh(rr, alpha=family_alpha), alpha=family_alpha)
    about = weighted_stats(panel, outcomes, weight).select(
        F.col("variable").alias("outcome"), F.col("n").alias("N_total"),
        F.col("sum_x").cast("bigint").alias("N_events"), (F.col("w_mean") * 100).alias("AbsoluteRisk_pct"),
    )
    out = _with_status(rr, fits, ["outcome"]).join(rd, "outcome", "left").join(about, "outcome", "left")
    return out.select(
        "outcome", "status", "m_requested", "m_fitted", "N_total", "N_events", "m", "RR", "LCL", "UCL", "beta_bar", "se_bar", "aRD", "aRD_LCL",
        "aRD_UCL", "AbsoluteRisk_pct", "E_value_point", "E_value_CI_lower", "E_value_CI_upper",
        *(["p", "FDR_q", "FDR_reject", "Bonf_threshold", "Bonf_reject"] if with_p else []),
    )


def complete_case_sweep(
    panel: DataFrame, outcomes: Sequence[str], exposure: str, adjust: Sequence[str], weight: str,
    min_n: int = 100, compress: bool = False, with_p: bool = True,
) -> DataFrame:
    """Refit every outcome on complete rows; fewer than ``min_n`` rows gives
    status ``too_few``."""
    outcomes = [o for o in outcomes if o in panel.columns]
    if not outcomes:
        return panel.sparkSession.createDataFrame([], COMPLETE_SCHEMA.format(p="p double, " if with_p else ""))
    needed = F.lit(True)
    for c in (exposure, *adjust):
        needed = needed & F.col(quoted(c)).isNotNull()
    batch = GlmBatch(panel, [ModelSpec(o, o, (exposure, *adjust)) for o in outcomes], weight, compress=compress, min_n=min_n)
    batch.fit()
    fits = batch.fit_frame()
    batch.close()
    rr = risk_ratio(rubin_pool(estimates(fits), ["outcome"]), with_p)
    about = weighted_stats(panel.filter(needed), outcomes, weight).select(
        F.col("variable").alias("outcome"), F.col("n").alias("N_complete"),
        F.col("sum_x").cast("bigint").alias("N_events"), (F.col("w_mean") * 100).alias("AbsoluteRisk_pct"),
    )
    total = panel.agg(F.count(F.lit(1)).alias("n")).scalar()
    cols = ["outcome", "status", "N_complete", "N_events", "completeness_pct", "RR", "LCL", "UCL", *(["p"] if with_p else []),
            "E_value_point", "E_value_CI_lower", "E_value_CI_upper", "AbsoluteRisk_pct"]
    return (
        _with_status(e_value(rr), fits, ["outcome"]).join(about, "outcome", "left")
        .withColumn("completeness_pct", F.col("N_complete") / total * 100).select(*cols)
    )


def level_flags(levels: Sequence[int], prefix: str = "Q") -> dict[int, str]:
    return {q: f"{prefix}{q}" for q in levels}


def with_levels(stack: DataFrame, bin_col: str, levels: Sequence[int], prefix: str = "Q", null_in_reference: bool = True) -> DataFrame:
    """An indicator column per level."""
    return stack.withColumns({n: bin_indicator(bin_col, q, null_in_reference) for q, n in level_flags(levels, prefix).items()})


def level_specs(
    outcomes: Sequence[str], levels: Sequence[int], adjust: Sequence[str], m: int = 1, chain_col: str | None = "mi_id",
    reference: str = "rest", prefix: str = "Q",
) -> list[ModelSpec]:
    flags, specs = list(level_flags(levels, prefix).values()), []
    for o in outcomes:
        for k in range(1, m + 1):
            if reference == "rest":
                specs += [ModelSpec(f"level|{o}|{n}|{k}", o, (n, *adjust), _where(chain_col, k), n, k) for n in flags]
            else:
                specs.append(ModelSpec(f"level|{o}|{prefix}|{k}", o, (*flags, *adjust), _where(chain_col, k), "joint", k))
    return specs


def level_contrasts(
    stack: DataFrame, outcomes: Sequence[str], bin_col: str, levels: Sequence[int], adjust: Sequence[str],
    weight: str, m: int = 1, chain_col: str | None = "mi_id", reference: str = "rest", prefix: str = "Q",
    null_in_reference: bool = True, compress: bool = False, with_p: bool = True, batch: GlmBatch | None = None,
) -> DataFrame:
    """Pooled ratio of each level.

    ``reference="rest"``: one indicator per model, so a level is compared with
    all other rows (parity). ``"first"``: all indicators together, so levels
    are compared with the first one.
    """
    flags = level_flags(levels, prefix)
    specs = level_specs(outcomes, levels, adjust, m, chain_col, reference, prefix)
    wide = with_levels(stack, bin_col, levels, prefix, null_in_reference)
    fits = _fitted(batch, wide, specs, weight, compress, lambda b: b.fit_frame(specs))
    est = estimates(fits, "*").filter(F.col("term").isin(*flags.values()))
    pooled = risk_ratio(rubin_pool(est, ["outcome", "term"]), with_p)
    # every requested contrast has its row, whatever came of its models
    asked = fits.withColumn("term", F.explode(F.when(F.col("label") == "joint", F.array(*[F.lit(n) for n in flags.values()])).otherwise(F.array("label"))))
    return _with_status(pooled, asked, ["outcome", "term"]).select(
        "outcome", F.concat("term", F.lit(f" vs {prefix}1")).alias("comparison"), "m", "RR", "LCL", "UCL",
        *(["p"] if with_p else []), "status", "m_requested", "m_fitted",
    )


def interaction_test(
    stack: DataFrame, outcome: str, exposure: str, modifier: str, adjust: Sequence[str], weight: str, m: int = 1,
    chain_col: str | None = "mi_id", compress: bool = False, alpha: float = 0.05,
) -> DataFrame:
    """Pooled estimates of the product term and of the exposure main effect; ``significant`` is the product term's test."""
    term = f"{exposure}_X_{modifier}"
    wide = stack.withColumn(term, product(F.col(quoted(exposure)).cast("double"), F.col(quoted(modifier)).cast("double")))
    terms = (exposure, modifier, term, *[a for a in adjust if a != modifier])
    specs = [ModelSpec(f"{modifier}|{k}", outcome, terms, _where(chain_col, k), modifier, k) for k in range(1, m + 1)]
    batch = GlmBatch(wide, specs, weight, compress=compress)
    batch.fit()
    fits = batch.fit_frame()
    batch.close()
    both = estimates(fits, "*").filter(F.col("term").isin(exposure, term)).withColumn(
        "part", F.when(F.col("term") == term, "interaction").otherwise("main_effect")
    )
    pooled = rubin_pool(both, ["label", "part"]).withColumn("p", wald_p("beta_bar", "se_bar"))
    asked = fits.withColumn("part", F.explode(F.array(F.lit("interaction"), F.lit("main_effect"))))
    return _with_status(pooled, asked, ["label", "part"]).select(
        F.col("label").alias("modifier"), "part", "m", "beta_bar", "se_bar", "p",
        F.when(F.col("part") == "interaction", F.col("p") < alpha).alias("significant"), "status", "m_requested", "m_fitted",
    )


Category = tuple[str, str, Sequence[tuple[float, str]]]


def strata_counts(stack: DataFrame, outcome: str, weight: str, categories: Sequence[Category], chain_col: str | None) -> DataFrame:
    """Rows, usable rows, events and weighted risk of every stratum and
    imputation, in one pass."""
    y, w = F.col(quoted(outcome)).cast("double"), F.col(quoted(weight)).cast("double")
    usable = y.isNotNull() & w.isNotNull()
    rep = F.col(chain_col).cast("int") if chain_col else F.lit(1)
    aggs, names, i = [], [], 0
    for category, column, strata in categories:
        for value, label in strata:
            inside = F.col(quoted(column)).cast("double") == float(value)
            there = inside & usable
            aggs += [
                F.count_if(inside).alias(f"rows__{i}"), F.count_if(there).alias(f"n__{i}"),
                F.coalesce(F.sum(F.when(there, y)), F.lit(0.0)).alias(f"events__{i}"),
                F.try_divide(F.sum(F.when(there, w * y)), F.sum(F.when(there, w))).alias(f"risk__{i}"),
            ]
            names.append(f"{category}|{label}")
            i += 1
    wide = stack.groupBy(rep.alias("rep")).agg(*aggs)
    return to_long(wide, ["rep"], names, ("rows", "n", "events", "risk"), "label").drop("_pos")


def strata_specs(
    outcome: str, exposure: str, categories: Sequence[Category], adjust: Sequence[str], m: int = 1, chain_col: str | None = "mi_id",
) -> list[ModelSpec]:
    """A category's own column leaves its adjustment set."""
    return [
        ModelSpec(
            f"strata|{category}|{label}|{k}", outcome, (exposure, *[a for a in adjust if a != column]),
            _where(chain_col, k, (column, float(value))), f"{category}|{label}", k,
        )
        for category, column, strata in categories for value, label in strata for k in range(1, m + 1)
    ]


def stratified_rr(
    stack: DataFrame, outcome: str, exposure: str, categories: Sequence[Category], adjust: Sequence[str],
    weight: str, m: int = 1, chain_col: str | None = "mi_id", min_rows: int = 100,
    compress: bool = False, with_p: bool = True, batch: GlmBatch | None = None,
) -> DataFrame:
    """Pooled ratio per stratum, from imputations with more than ``min_rows`` rows; a stratum without any keeps its row
    with status ``below_gate``.

    ``categories`` are (category, column, [(value, label), ...]); the strata of
    all categories are fitted in the same passes. ``n_sum`` adds up imputations
    (parity), ``n_mean`` is the average; events and risk are averages. A
    category's own column leaves its adjustment set.
    """
    specs = strata_specs(outcome, exposure, categories, adjust, m, chain_col)
    names = [(f"{category}|{label}", category, label, i) for category, _, strata in categories for i, (_, label) in enumerate(strata)]
    fits = _fitted(batch, stack, specs, weight, compress, lambda b: b.fit_frame(specs))
    order = stack.sparkSession.createDataFrame(names, "label string, category string, stratum string, position int")
    every = strata_counts(stack, outcome, weight, categories, chain_col)
    counts = every.filter(F.col("rows") > min_rows)
    kept = fits.join(counts.select("label", "rep"), ["label", "rep"], "left_semi")
    pooled = risk_ratio(rubin_pool(estimates(kept), ["label"]), with_p)
    about = lambda c: c.groupBy("label").agg(
        F.sum("n").alias("n_sum"), F.avg("n").alias("n_mean"), F.min_by("rows", "rep").alias("rows_first"),
        F.floor(F.avg("events")).cast("bigint").alias("events"), (F.avg("risk") * 100).alias("absolute_risk_pct"),
    )
    # strata above the gate are described by the imputations that passed it, the others by all
    described = about(counts).unionByName(about(every.join(counts.select("label").distinct(), "label", "left_anti")))
    status = _status_of(kept, ["label"]).select("label", "m_fitted", "status")
    return order.join(described, "label", "left").join(pooled, "label", "left").join(status, "label", "left").select(
        "category", "stratum", "position", "rows_first", "n_sum", "n_mean", "events", "absolute_risk_pct",
        "RR", "LCL", "UCL", *(["p"] if with_p else []), F.coalesce("status", F.lit("below_gate")).alias("status"),
        F.lit(m).cast("bigint").alias("m_requested"), F.coalesce("m_fitted", F.lit(0)).alias("m_fitted"),
    )


def effect_modification(
    stack: DataFrame, outcome: str, exposure: str, modifier: str, adjust: Sequence[str], weight: str, m: int = 1,
    chain_col: str | None = "mi_id", cut_at: float | None = None, min_rows: int = 50, compress: bool = False,
) -> DataFrame:
    """Interaction, main effect and per-stratum ratios as rows ``(part, stratum, ...)``.

    ``cut_at`` splits a continuous modifier at >= that value. The modifier is
    left out of the adjustment within strata.
    """
    inter = interaction_test(stack, outcome, exposure, modifier, adjust, weight, m, chain_col, compress)
    ratio = lambda s: F.when(F.col("part") == "main_effect", F.exp(F.col("beta_bar") + s * 1.96 * F.col("se_bar")))
    top = inter.select(
        "modifier", "part", F.lit(None).cast("string").alias("stratum"), "beta_bar", "se_bar",
        ratio(0.0).alias("RR"), ratio(-1.0).alias("LCL"), ratio(1.0).alias("UCL"), "p",
        "significant", F.lit(None).cast("bigint").alias("n"), "status",
    )
    name = modifier
    if cut_at is not None:
        name = f"{modifier}_binary"
        flag = F.coalesce((F.col(quoted(modifier)) >= float(cut_at)).cast("double"), F.lit(0.0))
        stack = stack.withColumn(name, flag)
    keep = [a for a in adjust if a != modifier]
    strata = stratified_rr(
        stack, outcome, exposure, [(modifier, name, [(0.0, f"{modifier}=0"), (1.0, f"{modifier}=1")])], keep, weight, m,
        chain_col, min_rows, compress,
    ).select(
        F.lit(modifier).alias("modifier"), F.lit("stratified").alias("part"), "stratum",
        F.lit(None).cast("double").alias("beta_bar"), F.lit(None).cast("double").alias("se_bar"),
        "RR", "LCL", "UCL", "p", F.lit(None).cast("boolean").alias("significant"), F.col("rows_first").alias("n"), "status",
    )
    return top.unionByName(strata)
