"""Chart-ready tables; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwright.functions.codes import as_col


def strip_wave(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), "_2[23]$", "")


def with_label(df: DataFrame, name_col: str, labels: DataFrame, out: str = "label") -> DataFrame:
    """Look up a display label; unknown names lose their wave suffix.

    ``labels`` (name, label) is a codebook: one row per variable.
    """
    book = labels.select(F.col("name").alias(name_col), F.col("label").alias("_label"))
    return df.join(book, name_col, "left").withColumn(out, F.coalesce("_label", strip_wave(name_col))).drop("_label")


def ranked(df: DataFrame, by: str, out: str = "plot_rank", ties: Sequence[str] = ()) -> DataFrame:
    """Position of each result row in ascending order of ``by``."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(by, *ties)))


def forest(results: DataFrame, labels: DataFrame, q: str = "FDR_q", alpha: float = 0.05) -> DataFrame:
    rows = with_label(results, "outcome", labels)
    return ranked(rows, "RR", ties=["outcome"]).select(
        "plot_rank", "outcome", "label", "RR", "LCL", "UCL", (F.col(q) < alpha).alias("significant")
    )


def compare_results(primary: DataFrame, complete: DataFrame, labels: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Both analyses side by side on shared outcomes, ordered by the primary ratio."""
    pq = "FDR_q" if "FDR_q" in primary.columns else "p"
    a = primary.select(
        "outcome", *[F.col(c).alias(f"mi_{c}") for c in ("RR", "LCL", "UCL")], (F.col(pq) < alpha).alias("mi_significant")
    )
    b = complete.select(
        "outcome", *[F.col(c).alias(f"cc_{c}") for c in ("RR", "LCL", "UCL")], (F.col("p") < alpha).alias("cc_significant")
    )
    return ranked(with_label(a.join(b, "outcome"), "outcome", labels), "mi_RR", ties=["outcome"])


def stratified_forest(overall: DataFrame, strata: DataFrame, order: Sequence[tuple[str, str]]) -> DataFrame:
    """Overall row first, then strata in the given (category, stratum) order;
    strata outside the order are left out, as are missing ones."""
    places = overall.sparkSession.createDataFrame(
        [(c, s, i) for i, (c, s) in enumerate(order)], "category string, stratum string, place int"
    )
    cols = ["n", "events", "RR", "LCL", "UCL", "p"]
    with_p = lambda df: df if "p" in df.columns else df.withColumn("p", F.lit(None).cast("double"))
    overall, strata = with_p(overall), with_p(strata)
    head = overall.select(
        F.lit(-1).alias("place"), F.lit(None).cast("string").alias("category"),
        F.lit("Overall (All participants)").alias("stratum"), *cols,
    )
    body = strata.join(places, ["category", "stratum"]).select("place", "category", "stratum", *cols)
    rows = head.unionByName(body)
    last = F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    return ranked(rows, "place", "plot_rank").withColumn("y_pos", last - F.col("plot_rank")).drop("place")


def tier_layout(nodes: DataFrame, spacing: float = 1.5, x_step: float = 5.0) -> DataFrame:
    """Node positions: alphabetical within a tier; the middle tier is centred
    on the baseline tier."""
    y = (F.row_number().over(W.partitionBy("tier").orderBy("var")) - 1) * spacing
    base = nodes.agg((F.count_if(F.col("tier") == 0) * F.lit(spacing) / 2).alias("c")).scalar()
    return nodes.withColumn("x", F.col("tier") * x_step).withColumn(
        "y", y + F.when(F.col("tier") == 1, base).otherwise(0.0)
    )
