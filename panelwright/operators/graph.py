"""Edge and node tables of discovered graphs.

Edges are rows ``(subset, method, fold, src, dst, coef)``; no matrix
orientation leaves a solver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.functions.codes import tier


def catalog(nodes: DataFrame, exposures: Sequence[str], var: str = "var") -> DataFrame:
    """Variable table with its tier: baseline 0, exposure 1, outcome 2."""
    return nodes.withColumn("tier", tier(var, exposures))


def forbidden_edges(cat: DataFrame, immutables: Sequence[str], same_tier_only: bool = False) -> DataFrame:
    """Edges that may not exist: later to earlier tier, and into immutables.

    ``same_tier_only`` limits the second rule to sources of the immutable's own
    tier. This is the matrix that a learner masks with, so it has variables
    squared rows; edges are filtered by :func:`apply_constraints` instead.
    """
    everyone = cat.agg(F.collect_list(F.struct("var", "tier"))).scalar()
    pairs = cat.select(F.col("var").alias("src"), F.col("tier").alias("ts"), F.explode(everyone).alias("d")).select(
        "src", "ts", F.col("d.var").alias("dst"), F.col("d.tier").alias("td")
    ).filter(F.col("src") != F.col("dst"))
    back = F.col("ts") > F.col("td")
    into = F.col("dst").isin(*immutables) if immutables else F.lit(False)
    if same_tier_only:
        into = into & (F.col("ts") == F.col("td"))
    return pairs.filter(back | into).select("src", "dst", F.when(back, "tier").otherwise("immutable").alias("reason"))


def apply_constraints(edges: DataFrame, cat: DataFrame, immutables: Sequence[str], same_tier_only: bool = False) -> DataFrame:
    """Drop self loops and the edges that :func:`forbidden_edges` lists, without listing them.

    The edges look up both ends' tiers; an end outside the catalogue has no tier and forbids nothing.
    """
    tiers = lambda end, out: cat.select(F.col("var").alias(end), F.col("tier").alias(out))
    told = edges.filter(F.col("src") != F.col("dst")).join(tiers("src", "_ts"), "src", "left").join(tiers("dst", "_td"), "dst", "left")
    into = F.col("dst").isin(*immutables) & F.col("_ts").isNotNull() & F.col("_td").isNotNull() if immutables else F.lit(False)
    if same_tier_only:
        into = into & (F.col("_ts") == F.col("_td"))
    bad = F.coalesce(F.col("_ts") > F.col("_td"), F.lit(False)) | F.coalesce(into, F.lit(False))
    return told.filter(~bad).select(*edges.columns)


def matrix_edges(matrices: DataFrame, threshold: float, names: str = "names", values: str = "matrix") -> DataFrame:
    """Row-major ``matrix[i][j]`` = coefficient of names[i] on names[j], to edges
    with an absolute coefficient above the threshold."""
    keys = [c for c in matrices.columns if c not in (names, values)]
    d = F.size(names)
    flat = matrices.select(*keys, names, F.posexplode(values).alias("_pos", "coef"))
    at = lambda i: F.element_at(names, (i + 1).cast("int"))
    return threshold_edges(
        flat.select(*keys, at(F.floor(F.col("_pos") / d)).alias("src"), at(F.col("_pos") % d).alias("dst"), "coef"),
        threshold,
    )


def threshold_edges(edges: DataFrame, threshold: float) -> DataFrame:
    return edges.filter((F.col("src") != F.col("dst")) & (F.abs("coef") > threshold))


def fold_consensus(edges: DataFrame, min_folds: int = 6, by: Sequence[str] = ("subset", "method")) -> DataFrame:
    """Edges present in at least ``min_folds`` folds, with their mean coefficient."""
    return (
        edges.groupBy(*by, "src", "dst")
        .agg(F.count(F.lit(1)).alias("fold_count"), F.avg("coef").alias("avg_coefficient"))
        .filter(F.col("fold_count") >= min_folds)
    )


def with_path(edges: DataFrame, arrow: str = "→") -> DataFrame:
    return edges.withColumn("path", F.concat("src", F.lit(arrow), "dst"))


def split_path(edges: DataFrame, arrow: str = "→") -> DataFrame:
    """Back from the display column to ``src`` and ``dst``."""
    parts = F.split("path", arrow)
    return edges.filter(F.col("path").contains(arrow)).withColumn("src", F.trim(parts[0])).withColumn("dst", F.trim(parts[1]))


def method_agreement(edges: DataFrame, by: Sequence[str] = ("subset",)) -> DataFrame:
    """Distinct methods per edge."""
    return edges.groupBy(*by, "src", "dst").agg(
        F.count_distinct("method").alias("n_methods"), F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods")
    )


def _touches(marks: Sequence[str]) -> Column:
    hits = [F.contains(F.col(c), F.lit(m)) for c in ("src", "dst") for m in marks]
    return reduce(lambda a, b: a | b, hits)


def edge_classes(agreement: DataFrame, exposure_marks: Sequence[str]) -> DataFrame:
    """Drawing class: the number of agreeing methods (at most 4) or the single method."""
    return agreement.withColumn("exposure_related", _touches(exposure_marks)).withColumn(
        "edge_class",
        F.when(F.col("n_methods") >= 2, F.least(F.col("n_methods"), F.lit(4)).cast("string")).otherwise(F.col("methods")),
    )


def node_degrees(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ("subset",)) -> DataFrame:
    """Every listed or used variable with its degree; degree 0 is isolated."""
    by = list(by)
    distinct = edges.select(*by, "src", "dst").distinct()
    ends = distinct.select(*by, F.explode(F.array("src", "dst")).alias("var"))
    listed = nodes.select(*by, "var", F.lit(0).alias("d")).unionByName(ends.select(*by, "var", F.lit(1).alias("d")))
    return listed.groupBy(*by, "var").agg(F.sum("d").alias("degree")).withColumn("isolated", F.col("degree") == 0)


def graph_summary(nodes: DataFrame, edges: DataFrame, by: Sequence[str] = ("subset",)) -> DataFrame:
    by = list(by)
    n = node_degrees(nodes, edges, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if("isolated").alias("n_isolated"), F.count_if(~F.col("isolated")).alias("n_connected")
    )
    e = edges.select(*by, "src", "dst").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"))
    return n.join(e, by, "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
