"""Weighted descriptive tables.

Every table is one grouped pass with many aggregates side by side; the long
layout is produced afterwards from the few result rows. Unpivoting the input
first would multiply the rows that enter the aggregation by the number of
variables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelwright.functions.codes import quoted
from panelwright.functions.formats import fmt_count_pct, fmt_mean_sd, fmt_n, fmt_p, fmt_smd
from panelwright.functions.tails import t_p, two_by_two_p
from panelwright.operators.quantiles import exact_quantiles, number, weighted_quantile
from panelwright.operators.sums import vector_sums

Z95 = 1.96


def to_long(df: DataFrame, keys: Sequence[str], names: Sequence[str], fields: Sequence[str], name_col: str) -> DataFrame:
    """Wide aggregates ``{field}__{i}`` to one row per name."""
    items = F.array(
        *[
            F.struct(F.lit(n).alias(name_col), F.lit(i).alias("_pos"), *[F.col(f"{f}__{i}").alias(f) for f in fields])
            for i, n in enumerate(names)
        ]
    )
    return df.select(*keys, F.explode(items).alias("_s")).select(*keys, "_s.*")


def _weight(weight: str | None) -> Column:
    return F.lit(1.0) if weight is None else number(weight)


def pilot(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Some value in the middle of each column's range (mean of a few rows): sums of squares around it lose no digits.

    Any constant gives the same statistics; a column without a number there starts from its first one.
    """
    few = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(cols)]).limit(1000)
    row = few.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(cols))]).first() if cols else {}
    out = {c: row[f"x{i}"] for i, c in enumerate(cols)}
    for c in [c for c, v in out.items() if v is None]:
        first = df.select(number(c).alias("x")).filter("x IS NOT NULL").first()
        out[c] = first["x"] if first else 0.0
    return out


def _sums(x: Column, w: Column, i: int, around: float) -> list[Column]:
    there = x.isNotNull() & w.isNotNull()
    xv, wv = F.when(there, x), F.when(there, w)
    d = F.when(there, x - F.lit(around))
    zero = F.lit(0.0)
    return [
        F.count(xv).alias(f"n__{i}"),
        F.coalesce(F.sum(wv), zero).alias(f"sw__{i}"),
        F.coalesce(F.sum(wv * d), zero).alias(f"swd__{i}"),
        F.coalesce(F.sum(wv * d * d), zero).alias(f"swdd__{i}"),
        F.coalesce(F.sum(xv), zero).alias(f"sx__{i}"),
        F.coalesce(F.sum(d), zero).alias(f"dx__{i}"),
        F.coalesce(F.sum(d * d), zero).alias(f"dxx__{i}"),
        F.lit(around).alias(f"at__{i}"),
    ]


#: Sums around the pilot value ``at``: d = x - at.
SUM_FIELDS = ("n", "sw", "swd", "swdd", "sx", "dx", "dxx")


def _wmean(p: str = "") -> Column:
    return F.col("at") + F.try_divide(F.col(f"{p}swd"), F.col(f"{p}sw"))


def _wvar(p: str = "") -> Column:
    m = F.try_divide(F.col(f"{p}swd"), F.col(f"{p}sw"))
    return F.greatest(F.try_divide(F.col(f"{p}swdd"), F.col(f"{p}sw")) - m * m, F.lit(0.0))


def variable_sums(df: DataFrame, cols: Sequence[str], weight: str | None, by: Sequence[str]) -> DataFrame:
    w, middle = _weight(weight), pilot(df, cols)
    aggs = [a for i, c in enumerate(cols) for a in _sums(number(c), w, i, middle[c])]
    return to_long(df.groupBy(*by).agg(*aggs), list(by), cols, (*SUM_FIELDS, "at"), "variable")


def weighted_stats(df: DataFrame, cols: Sequence[str], weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """n, weighted mean, population-weighted sd and plain sum per variable."""
    long = variable_sums(df, cols, weight, by)
    return long.select(
        *by, "variable", "n", F.col("sw").alias("sum_weights"),
        F.when(F.col("n") > 0, _wmean()).alias("w_mean"),
        F.when(F.col("n") > 0, F.sqrt(_wvar())).alias("w_sd"),
        F.col("sx").alias("sum_x"),
    )


def absolute_risk(
    df: DataFrame, outcomes: Sequence[str], weight: str, by: str, levels: Sequence[int]
) -> DataFrame:
    """Weighted risk per level with a design-based interval; every level is kept.

    sum(w^2 (y-p)^2) = sum(w^2 y^2) - 2 p sum(w^2 y) + p^2 sum(w^2): one pass.
    """
    w = number(weight)
    aggs = []
    for i, o in enumerate(outcomes):
        y = number(o)
        there = y.isNotNull() & w.isNotNull()
        yv, wv = F.when(there, y), F.when(there, w)
        zero = F.lit(0.0)
        aggs += [
            F.count(yv).alias(f"n__{i}"),
            F.coalesce(F.sum(wv), zero).alias(f"sw__{i}"),
            F.coalesce(F.sum(wv * yv), zero).alias(f"swy__{i}"),
            F.coalesce(F.sum(wv * wv), zero).alias(f"sw2__{i}"),
            F.coalesce(F.sum(wv * wv * yv), zero).alias(f"sw2y__{i}"),
            F.coalesce(F.sum(wv * wv * yv * yv), zero).alias(f"sw2yy__{i}"),
            F.coalesce(F.sum(yv), zero).alias(f"sy__{i}"),
        ]
    level = F.col(quoted(by)).cast("int")
    fields = ("n", "sw", "swy", "sw2", "sw2y", "sw2yy", "sy")
    got = df.filter(level.isNotNull()).groupBy(level.alias("level")).agg(*aggs)
    frame = df.sparkSession.createDataFrame(
        [(int(v), o) for v in levels for o in outcomes], "level int, outcome string"
    )
    long = frame.join(to_long(got, ["level"], outcomes, fields, "outcome"), ["level", "outcome"], "left")
    n, sw = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("sw"), F.lit(0.0))
    p = F.when(F.col("sw") > 0, F.col("swy") / F.col("sw"))
    spread = F.greatest(F.col("sw2yy") - 2 * p * F.col("sw2y") + p * p * F.col("sw2"), F.lit(0.0))
    se = F.when((F.col("n") > 1) & (F.col("sw") > 0), F.sqrt(spread) / F.col("sw"))
    return long.select(
        "outcome", "level", n.cast("bigint").alias("n"), (p * 100).alias("risk_pct"),
        F.when(se.isNotNull(), F.greatest(F.lit(0.0), p - Z95 * se) * 100).alias("risk_lcl_pct"),
        F.when(se.isNotNull(), F.least(F.lit(1.0), p + Z95 * se) * 100).alias("risk_ucl_pct"),
        F.coalesce(F.col("sy"), F.lit(0.0)).cast("bigint").alias("events_unweighted"),
        sw.alias("sum_weights"),
    )


def baseline_table(
    df: DataFrame, variables: Sequence[tuple[str, str]], group: str, weight: str, with_p: bool = True
) -> DataFrame:
    """Numeric baseline table: one row per variable with all / low / high columns.

    ``variables`` are (name, "continuous" | "binary"); ``group`` is 1 for high,
    anything else is low. Variables missing from the frame yield empty rows.
    """
    present = [(v, k) for v, k in variables if v in df.columns]
    keyed = df.withColumn("_g", F.coalesce((F.col(quoted(group)) == 1).cast("int"), F.lit(0)))
    sums = variable_sums(keyed, [v for v, _ in present], weight, ["_g"])
    pick = lambda g, f: F.coalesce(F.sum(F.when(F.col("_g") == g, F.col(f))), F.lit(0.0))
    wide = sums.groupBy("variable").agg(
        *[pick(g, f).alias(f"{n}_{f}") for g, n in ((0, "low"), (1, "high")) for f in SUM_FIELDS], F.max("at").alias("at")
    )
    for f in SUM_FIELDS:
        wide = wide.withColumn(f"all_{f}", F.col(f"low_{f}") + F.col(f"high_{f}"))
    both = (F.col("low_n") > 0) & (F.col("high_n") > 0)
    kind = F.col("kind") == "continuous"
    for g in ("all", "low", "high"):
        some = F.col(f"{g}_n") > 0
        wide = wide.withColumn(f"{g}_mean", F.when(some, _wmean(f"{g}_"))).withColumn(
            f"{g}_sd", F.when(some, F.sqrt(_wvar(f"{g}_")))
        )
    layout = df.sparkSession.createDataFrame(
        [(i, v, k) for i, (v, k) in enumerate(variables)], "position int, variable string, kind string"
    )
    rows = layout.join(wide, "variable", "left")
    pooled = F.sqrt(
        F.try_divide(
            (F.col("low_n") - 1) * F.pow("low_sd", F.lit(2)) + (F.col("high_n") - 1) * F.pow("high_sd", F.lit(2)),
            F.col("low_n") + F.col("high_n") - 2,
        )
    )
    gap = F.abs(F.col("high_mean") - F.col("low_mean"))
    mid = (F.col("low_mean") + F.col("high_mean")) / 2
    smd = F.when(kind, F.when(pooled > 0, gap / pooled).otherwise(0.0)).otherwise(
        F.when((mid > 0) & (mid < 1), gap / F.sqrt(mid * (1 - mid))).otherwise(0.0)
    )
    rows = rows.withColumn("smd", F.when(both, smd))
    # unweighted pooled-variance t statistic
    ss = lambda g: F.greatest(F.col(f"{g}_dxx") - F.col(f"{g}_dx") * F.col(f"{g}_dx") / F.col(f"{g}_n"), F.lit(0.0))
    dof = F.col("low_n") + F.col("high_n") - 2
    pv = F.try_divide(ss("low") + ss("high"), dof)
    diff = F.col("low_dx") / F.col("low_n") - F.col("high_dx") / F.col("high_n")
    t = F.try_divide(diff, F.sqrt(pv * (1 / F.col("low_n") + 1 / F.col("high_n"))))
    rows = rows.withColumn("t_stat", F.when(both & kind, t)).withColumn("t_df", F.when(both & kind, dof))
    cells = [
        ("low_yes", F.col("low_sx").cast("bigint")),
        ("low_no", F.col("low_n").cast("bigint") - F.col("low_sx").cast("bigint")),
        ("high_yes", F.col("high_sx").cast("bigint")),
        ("high_no", F.col("high_n").cast("bigint") - F.col("high_sx").cast("bigint")),
    ]
    for name, c in cells:
        rows = rows.withColumn(name, F.when(both & ~kind, c))
    out = rows.select(
        "position", "variable", "kind",
        *[F.col(f"{g}_n").cast("bigint").alias(f"{g}_n") for g in ("all", "low", "high")],
        *[f"{g}_mean" for g in ("all", "low", "high")], *[f"{g}_sd" for g in ("all", "low", "high")],
        *[F.col(f"{g}_sx").alias(f"{g}_sum") for g in ("all", "low", "high")],
        "smd", "t_stat", "t_df", "low_yes", "low_no", "high_yes", "high_no",
    )
    if not with_p:
        return out
    d = lambda c: F.col(c).cast("double")
    return out.withColumn(
        "p",
        F.when(kind, t_p(d("t_stat"), d("t_df"))).otherwise(
            two_by_two_p(d("low_yes"), d("low_no"), d("high_yes"), d("high_no"))
        ),
    )


def group_sizes(df: DataFrame, group: str, weight: str) -> DataFrame:
    """Header counts: rows with a weight, in all, low and high."""
    high = F.coalesce(F.col(quoted(group)) == 1, F.lit(False))
    return df.filter(F.col(quoted(weight)).isNotNull()).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(~high).alias("n_low"), F.count_if(high).alias("n_high")
    )


def baseline_display(table: DataFrame, sizes: DataFrame, labels: DataFrame) -> DataFrame:
    """Printable baseline table: a header row, then one formatted row per variable."""
    value = lambda g: F.when(
        F.col("kind") == "continuous", fmt_mean_sd(f"{g}_mean", f"{g}_sd")
    ).otherwise(fmt_count_pct(f"{g}_sum", F.col(f"{g}_mean") * 100))
    body = table.join(labels, "variable", "left").select(
        "position", F.coalesce("label", "variable").alias("Variable"), value("all").alias("All participants"),
        value("low").alias("Low"), value("high").alias("High"), fmt_smd("smd").alias("SMD"), fmt_p("p").alias("p-value"),
    )
    head = sizes.select(
        F.lit(-1).alias("position"), F.lit("Characteristic").alias("Variable"), fmt_n("n_all").alias("All participants"),
        fmt_n("n_low").alias("Low"), fmt_n("n_high").alias("High"), F.lit("").alias("SMD"), F.lit("").alias("p-value"),
    )
    return head.unionByName(body).orderBy("position").drop("position")


def outcome_profile(df: DataFrame, outcomes: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Per outcome on rows complete in the outcome and ``required``: rows, events,
    event rate and the counts of both values."""
    ready = F.lit(True)
    for c in required:
        ready = ready & F.col(quoted(c)).isNotNull()
    aggs = []
    for i, o in enumerate(outcomes):
        y = F.when(ready, F.col(quoted(o)).cast("double"))
        aggs += [
            F.count(y).alias(f"n_complete__{i}"),
            F.coalesce(F.sum(y), F.lit(0.0)).cast("bigint").alias(f"n_events__{i}"),
            F.count_if(y == 1).alias(f"n_ones__{i}"),
            F.count_if(y == 0).alias(f"n_zeros__{i}"),
        ]
    long = to_long(df.agg(*aggs), [], outcomes, ("n_complete", "n_events", "n_ones", "n_zeros"), "outcome")
    rate = F.when(F.col("n_complete") > 0, F.col("n_events") / F.col("n_complete") * 100).otherwise(0.0)
    return long.drop("_pos").withColumn("event_rate_pct", rate)


def histogram_density(
    df: DataFrame, col: str, lo: float, hi: float, bins: int, weight: str | None = None
) -> DataFrame:
    """Density per equal-width bin over [lo, hi]; the last bin is closed; empty
    bins are kept."""
    x, w = F.col(quoted(col)).cast("double"), _weight(weight)
    width = (hi - lo) / bins
    inside = x.isNotNull() & w.isNotNull() & (x >= lo) & (x <= hi)
    index = F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int")
    got = df.filter(inside).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("sw"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    share = F.try_divide(F.col("sw"), F.sum("sw").over(W.partitionBy(F.lit(0))) * width)
    return frame.join(got, "bin", "left").select(
        "bin",
        (F.lit(float(lo)) + F.col("bin") * width).alias("left_edge"),
        (F.lit(float(lo)) + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(share, F.lit(0.0)).alias("density"),
    )


def kde(
    df: DataFrame, col: str, lo: float, hi: float, points: int = 200,
    weight: str | None = None, bandwidth: float | None = None,
) -> DataFrame:
    """Exact weighted Gaussian density on an even grid.

    Equal values are merged first; each task adds its merged values to one
    vector of ``points`` grid entries.
    Without ``bandwidth`` Scott's rule is used with the effective sample size.
    """
    x, w = number(col), _weight(weight)
    at = pilot(df, [col])[col]
    values = (
        df.filter(x.isNotNull() & w.isNotNull()).select((x - F.lit(at)).alias("v"), w.alias("w"))
        .groupBy("v").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    )
    s = values.agg(
        F.sum("w").alias("w"), F.sum("w2").alias("w2"), F.sum(F.col("w") * F.col("v")).alias("wx"),
        F.sum(F.col("w") * F.col("v") * F.col("v")).alias("wxx"),
    ).first()
    grid = np.linspace(lo, hi, points)
    frame = df.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "point int, x double")
    if not s["w"]:
        return frame.withColumn("density", F.lit(None).cast("double"))
    neff = s["w"] ** 2 / s["w2"]
    spread = (s["wxx"] / s["w"] - (s["wx"] / s["w"]) ** 2) / (1 - 1 / neff) if neff > 1 else 0.0
    h = float(bandwidth) if bandwidth else neff**-0.2 * np.sqrt(max(spread, 0.0))
    if h <= 0:  # one value: no width to smooth with
        return frame.withColumn("density", F.lit(None).cast("double"))
    places, norm = grid - at, float(s["w"]) * h * np.sqrt(2 * np.pi)

    def add(batch, acc):
        v, share = batch["v"], batch["w"] / norm
        for a in range(0, len(v), 4096):
            z = (places[:, None] - v[None, a : a + 4096]) / h
            acc[0] += np.exp(-0.5 * z * z) @ share[a : a + 4096]

    density = vector_sums(values.select("v", "w"), [points], add)[0]
    return df.sparkSession.createDataFrame(
        [(i, float(g), float(d)) for i, (g, d) in enumerate(zip(grid, density))], "point int, x double, density double"
    )


def normal_curve(df: DataFrame, x: str, mean: Column, sd: Column, out: str = "normal_pdf") -> DataFrame:
    z = (F.col(x) - mean) / sd
    return df.withColumn(out, F.exp(-0.5 * z * z) / (sd * F.sqrt(2 * F.pi())))


def weighting_shift(before: DataFrame, after: DataFrame, col: str, weight: str | None) -> DataFrame:
    """Mean, sd and median before and after weighting, with the changes."""
    c = number(col)
    a = before.agg(
        F.count(c).alias("n_before"), F.avg(c).alias("mean_before"), F.stddev_samp(c).alias("sd_before")
    ).withColumn("median_before", exact_quantiles(before, [col], [0.5]).scalar()[0])
    kept = after if weight else after.withColumn("_one", F.lit(1.0))
    b = weighted_stats(kept, [col], weight or "_one").select(
        F.struct(F.col("w_mean").alias("mean"), F.col("w_sd").alias("sd")).alias("s")
    ).scalar()
    n_after = after.agg(F.count(c).alias("n")).scalar()
    med = weighted_quantile(kept, col, weight or "_one", 0.5).select("quantile").scalar()
    return (
        a.withColumn("n_after", n_after).withColumn("mean_after", b["mean"]).withColumn("sd_after", b["sd"])
        .withColumn("median_after", med)
        .withColumn("delta_mean", F.col("mean_after") - F.col("mean_before"))
        .withColumn("delta_sd", F.col("sd_after") - F.col("sd_before"))
    )


def rollup_results(primary: DataFrame, complete: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Significant outcomes per analysis and mean completeness."""
    a = primary.agg(F.count_if(F.col("FDR_q") < alpha).alias("n_sig_primary"), F.count(F.lit(1)).alias("n_primary"))
    b = complete.agg(
        F.struct(
            F.count_if(F.col("p") < alpha).alias("n_sig"), F.count(F.lit(1)).alias("n"),
            F.avg("completeness_pct").alias("completeness"),
        ).alias("s")
    ).scalar()
    return a.select(
        "n_primary", "n_sig_primary", b["n"].alias("n_complete_case"), b["n_sig"].alias("n_sig_complete_case"),
        b["completeness"].alias("mean_completeness_pct"),
    )
