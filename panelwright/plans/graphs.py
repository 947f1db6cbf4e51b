"""Graph discovery over variable subsets, methods and folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from panelwright.operators import discovery as d, graph as g, matrix as mx
from panelwright.operators.charts import tier_layout, with_label
from panelwright.operators.panel import tag_union
from panelwright.operators.sums import keep_for_passes
from panelwright.plans import codebook as cb


def forbidden_set(frame: DataFrame) -> set[tuple[str, str]]:
    """The constraint relation for a learner: at most variables x variables pairs."""
    return {(r["src"], r["dst"]) for r in frame.select("src", "dst").collect()}


def subset_variables(subset: str = "all", exposure: str = "continuous") -> list[str]:
    """Baseline, exposure (the score, or its ``binary`` high group) and outcomes: of ``disease``, ``symptoms``, or the first four of both."""
    outcomes = {"disease": cb.GRAPH_DISEASES, "symptoms": cb.GRAPH_SYMPTOMS, "all": [*cb.GRAPH_DISEASES[:4], *cb.GRAPH_SYMPTOMS[:4]]}
    return [*cb.GRAPH_BASELINE, {"continuous": cb.SCORE, "binary": cb.SCORE_HIGH}[exposure], *outcomes[subset]]


def discover(
    panel: DataFrame, key: Sequence[str], subsets: Mapping[str, Sequence[str]], exposures: Sequence[str] = cb.EXPOSURES,
    folds: int = cb.GRAPH_FOLDS, min_folds: int = cb.GRAPH_MIN_FOLDS, seed: int = cb.SEED,
    immutable_mask: Sequence[str] = cb.IMMUTABLE_MASK, immutable_filter: Sequence[str] = cb.IMMUTABLE_FILTER,
    methods: Sequence[str] = d.METHODS, settings: Mapping[str, dict] | None = None, with_runs: bool = False,
) -> tuple[DataFrame, ...]:
    """Consensus edges of all subsets and methods, the variables of each subset, and (``with_runs``) a status row for every run."""
    settings = settings or {}
    spark = panel.sparkSession
    found, nodes, runs = {}, [], []
    for subset, vars in subsets.items():
        ready, use = mx.prepare_matrix(panel, vars, key)
        rows = keep_for_passes(mx.exact_folds(keep_for_passes(ready), key, folds, seed).select("fold", *use))
        moments = keep_for_passes(mx.training_moments(mx.fold_gram(rows, use), subset, use))
        nodes += [(subset, v) for v in use]
        runs.append(d.learner_runs(moments, methods))
        cat = g.catalog(spark.createDataFrame([(v,) for v in use], "var string"), exposures)
        mask = forbidden_set(g.forbidden_edges(cat, immutable_mask))
        for method in methods:
            extra = dict(settings.get(method, {}))
            if method == "DirectLiNGAM":
                ladder = [
                    forbidden_set(g.forbidden_edges(cat, level, same_tier_only=True))
                    for level in (immutable_filter, immutable_mask, [])
                ]
                edges = d.direct_lingam(rows, moments, use, ladder, **extra)
            elif method == "GOLEM":
                edges = d.golem(moments, mask, **extra)
            elif method == "ORDER_BIC":
                edges = d.order_search_bic(moments, mask, **extra)
            else:
                edges = d.dagma_linear(moments, mask, **extra)
            found[f"{subset}|{method}"] = g.apply_constraints(g.threshold_edges(edges, 0.0), cat, immutable_filter)
    every = tag_union(found, "_run").drop("_run")
    edges, variables = g.with_path(g.fold_consensus(every, min_folds)), spark.createDataFrame(nodes, "subset string, var string")
    return (edges, variables, reduce(DataFrame.unionByName, runs)) if with_runs else (edges, variables)


def network_tables(
    edges: DataFrame, variables: DataFrame, subset: str, exposures: Sequence[str] = cb.EXPOSURES,
    marks: Sequence[str] = cb.EXPOSURE_MARKS, labels: Mapping[str, str] = cb.NETWORK_LABELS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with layout, classed edges and the summary of one subset."""
    spark = edges.sparkSession
    e = edges.filter(F.col("subset") == subset)
    v = variables.filter(F.col("subset") == subset)
    book = spark.createDataFrame(list(labels.items()), "name string, label string")
    degrees = g.node_degrees(v, e)
    nodes = with_label(tier_layout(g.catalog(degrees, exposures)), "var", book)
    return nodes, g.edge_classes(g.method_agreement(e), marks), g.graph_summary(v, e)
