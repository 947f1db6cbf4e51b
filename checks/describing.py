"""Scores, weighted descriptions, distributions, multiplicity and chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.integrals import chi2_tail, normal_tail, student_tail
from checks.tables import LINES_SQL, WAVES_SQL, lines, panel, rounded, table
from panelwright.functions import tails
from panelwright.operators import charts, describe as ds, effects, multiplicity as mt, quantiles as qn, sampling

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


L = f"l AS ({LINES_SQL})"


@check(f"""WITH {L} SELECT flag, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, round(quantile_cont(score, 0.5), 6) AS median FROM l GROUP BY 1""")
def score_moments(spark, sf):
    return rounded(qn.moments(lines(spark, sf), "score", ["flag"]))


@check(f"""WITH {L}, s AS (SELECT avg(score) AS m, stddev_samp(score) AS s FROM l)
SELECT score, count(*) AS n, round(min((score - m) / s), 6) AS z FROM l, s GROUP BY 1""")
def score_z(spark, sf):
    z = qn.zscore(lines(spark, sf), "score", "z")
    return rounded(z.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.min("z").alias("z")))


def _bins(c, q):
    e = f"(SELECT quantile_cont({c}, [{', '.join(str(i / q) for i in range(q + 1))}]) AS e FROM l)"
    return f"CASE WHEN {c} IS NULL THEN NULL " + " ".join(f"WHEN {c} <= {e}[{i + 1}] THEN {i}" for i in range(1, q)) + f" ELSE {q} END"


@check(f"""WITH {L} SELECT quartile::BIGINT AS quartile, tertile::BIGINT AS tertile, count(*) AS n, min(score) AS lo, max(score) AS hi FROM (SELECT score, {_bins('score', 4)} AS quartile, {_bins('score', 3)} AS tertile FROM l) GROUP BY 1, 2""")
def quantile_bins(spark, sf):
    b = qn.qcut(qn.qcut(lines(spark, sf), "score", 4, "quartile"), "score", 3, "tertile")
    return rounded(b.groupBy("quartile", "tertile").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")))


@check(f"""WITH {L} SELECT flag, q[1] AS lo, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q90, q[5] AS hi
FROM (SELECT flag, quantile_cont(price, [0, 0.25, 0.5, 0.9, 1]) AS q FROM l GROUP BY 1)""")
def ranged_quantiles(spark, sf):
    """Exact quantiles of a high-cardinality column by value ranges instead of one map per group."""
    q = qn.exact_quantiles(lines(spark, sf), ["price"], [0, 0.25, 0.5, 0.9, 1], ["flag"], per_range=4_000)
    return rounded(q.select("flag", *[F.col("price")[i].alias(n) for i, n in enumerate(("lo", "q25", "q50", "q90", "hi"))]))


@check(f"""WITH {L} SELECT high, strict, count(*) AS n, count(score) AS scored FROM (SELECT score,
 CASE WHEN score >= (SELECT median(score) FROM l) THEN 1.0::DOUBLE ELSE 0.0 END AS high,
 CASE WHEN score > (SELECT median(score) FROM l) THEN 1.0::DOUBLE WHEN score IS NOT NULL THEN 0.0 END AS strict FROM l) GROUP BY 1, 2""")
def median_splits(spark, sf):
    s = qn.median_split(lines(spark, sf), "score", "high")
    s = qn.median_split(s, "score", "strict", null_as_low=False, strict=True)
    return s.groupBy("high", "strict").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"))


@check(f"""WITH {L}, u AS (SELECT flag, 'score' AS variable, score AS x, w FROM l UNION ALL SELECT flag, 'finished', finished, w FROM l)
SELECT flag, variable, count(x) AS n, round(sum(w) FILTER (x IS NOT NULL), 6) AS sum_weights, round(sum(w * x) / sum(w) FILTER (x IS NOT NULL), 6) AS w_mean,
 round(sqrt(sum(w * x * x) / sum(w) FILTER (x IS NOT NULL) - (sum(w * x) / sum(w) FILTER (x IS NOT NULL)) ** 2), 6) AS w_sd, round(sum(x), 6) AS sum_x FROM u GROUP BY 1, 2""")
def weighted_stats(spark, sf):
    return rounded(ds.weighted_stats(lines(spark, sf), ["score", "finished"], "w", ["flag"]))


def _risk_sql(source, outcome, level):
    return f"""SELECT '{outcome}' AS outcome, {level} AS level, count(*) AS n, sum(w * y) / sum(w) AS p, sum(w) AS sw, sum(w * w) AS w2, sum(w * w * y) AS w2y, sum(y) AS e
 FROM (SELECT {level}, {outcome} AS y, w FROM {source} WHERE {outcome} IS NOT NULL AND {level} IS NOT NULL) GROUP BY 2"""


_RISK_OUT = """SELECT v.outcome, v.level, coalesce(n, 0) AS n, round(p * 100, 6) AS risk_pct, round(CASE WHEN n > 1 THEN greatest(0, p - 1.96 * se) * 100 END, 6) AS risk_lcl_pct,
 round(CASE WHEN n > 1 THEN least(1, p + 1.96 * se) * 100 END, 6) AS risk_ucl_pct, coalesce(e, 0)::BIGINT AS events_unweighted, round(coalesce(sw, 0), 6) AS sum_weights
FROM v LEFT JOIN (SELECT *, sqrt(greatest(w2y - 2 * p * w2y + p * p * w2, 0)) / sw AS se FROM r) r ON r.outcome = v.outcome AND r.level = v.level"""


@check(f"""WITH {L}, b AS (SELECT *, {_bins('score', 4)} AS quartile FROM l), r AS ({_risk_sql('b', 'returned', 'quartile')} UNION ALL {_risk_sql('b', 'finished', 'quartile')}),
v AS (SELECT unnest(['returned', 'finished']) AS outcome, lv::BIGINT AS level FROM (SELECT unnest([1, 2, 3, 4, 5]) AS lv)) {_RISK_OUT}""".replace(
    "SELECT unnest(['returned', 'finished']) AS outcome, lv::BIGINT AS level FROM (SELECT unnest([1, 2, 3, 4, 5]) AS lv)",
    "SELECT o.outcome, lv.level FROM (SELECT unnest(['returned', 'finished']) AS outcome) o CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS level) lv",
))
def absolute_risk(spark, sf):
    """Level 5 does not occur: its row stays, with n = 0."""
    b = qn.qcut(lines(spark, sf), "score", 4, "quartile")
    return rounded(ds.absolute_risk(b, ["returned", "finished"], "w", "quartile", [1, 2, 3, 4, 5]))


@check(f"""WITH {WAVES_SQL}, b AS (SELECT *, CASE WHEN score >= (SELECT median(score) FROM panel) THEN 1 ELSE 0 END AS high, n_base AS w FROM panel),
r AS ({_risk_sql('b', 'urgent', 'high')}), v AS (SELECT 'urgent' AS outcome, unnest([0, 1])::BIGINT AS level) {_RISK_OUT}""")
def panel_risk(spark, sf):
    """Flagship: three waves joined, median-split exposure, weighted risk by group."""
    b = qn.median_split(panel(spark, sf), "score", "high").withColumn("w", F.col("n_base"))
    return rounded(ds.absolute_risk(b, ["urgent"], "w", "high", [0, 1]))


_TABLE_SQL = f"""WITH o AS (SELECT o_totalprice, c_acctbal, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE WHEN o_orderpriority <> '5-LOW' THEN 0.0 END AS urgent,
   CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS closed, 1 + (c_nationkey + 1) / 50.0::DOUBLE AS w FROM orders JOIN customer ON c_custkey = o_custkey),
 g AS (SELECT *, CASE WHEN o_totalprice >= (SELECT median(o_totalprice) FROM o) THEN 1 ELSE 0 END AS high FROM o),
 u AS (SELECT 0 AS position, 'c_acctbal' AS variable, 'continuous' AS kind, c_acctbal AS x, w, high FROM g UNION ALL SELECT 1, 'urgent', 'binary', urgent, w, high FROM g
       UNION ALL SELECT 2, 'closed', 'binary', closed, w, high FROM g),
 s AS (SELECT position, variable, kind, high, count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS v, sum(x) AS sx, var_samp(x) AS uv, avg(x) AS um FROM u WHERE x IS NOT NULL GROUP BY 1, 2, 3, 4),
 a AS (SELECT variable, count(*) AS n, sum(w * x) / sum(w) AS m, sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2 AS v, sum(x) AS sx FROM u WHERE x IS NOT NULL GROUP BY 1)
SELECT l.position::BIGINT AS position, l.variable, l.kind, a.n AS all_n, l.n AS low_n, h.n AS high_n, round(a.m, 6) AS all_mean, round(l.m, 6) AS low_mean, round(h.m, 6) AS high_mean,
 round(sqrt(a.v), 4) AS all_sd, round(sqrt(l.v), 4) AS low_sd, round(sqrt(h.v), 4) AS high_sd, round(a.sx, 2) AS all_sum, round(l.sx, 2) AS low_sum, round(h.sx, 2) AS high_sum,
 round(CASE WHEN l.kind = 'continuous' THEN abs(h.m - l.m) / sqrt(((l.n - 1) * l.v + (h.n - 1) * h.v) / (l.n + h.n - 2)) ELSE abs(h.m - l.m) / sqrt((h.m + l.m) / 2 * (1 - (h.m + l.m) / 2)) END, 6) AS smd,
 round(CASE WHEN l.kind = 'continuous' THEN (l.um - h.um) / sqrt(((l.n - 1) * l.uv + (h.n - 1) * h.uv) / (l.n + h.n - 2) * (1.0 / l.n + 1.0 / h.n)) END, 5) AS t_stat,
 CASE WHEN l.kind = 'continuous' THEN (l.n + h.n - 2)::DOUBLE END AS t_df,
 CASE WHEN l.kind = 'binary' THEN l.sx::BIGINT END AS low_yes, CASE WHEN l.kind = 'binary' THEN l.n - l.sx::BIGINT END AS low_no,
 CASE WHEN l.kind = 'binary' THEN h.sx::BIGINT END AS high_yes, CASE WHEN l.kind = 'binary' THEN h.n - h.sx::BIGINT END AS high_no
FROM s l JOIN s h ON l.variable = h.variable AND l.high = 0 AND h.high = 1 JOIN a ON a.variable = l.variable"""


def _order_rows(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    prio = F.col("o_orderpriority")
    rows = o.select(
        "o_totalprice", "c_acctbal", F.when(prio == "1-URGENT", 1.0).when(prio != "5-LOW", 0.0).alias("urgent"),
        (F.col("o_orderstatus") == "F").cast("double").alias("closed"), (1 + (F.col("c_nationkey") + 1) / F.lit(50.0)).alias("w"),
    )
    return qn.median_split(rows, "o_totalprice", "high")


_TABLE_VARS = [("c_acctbal", "continuous"), ("urgent", "binary"), ("closed", "binary")]


@check(_TABLE_SQL)
def baseline_table(spark, sf):
    t = ds.baseline_table(_order_rows(spark, sf), _TABLE_VARS, "high", "w", with_p=False)
    digits = {"all_sd": 4, "low_sd": 4, "high_sd": 4, "all_sum": 2, "low_sum": 2, "high_sum": 2, "t_stat": 5}
    return rounded(t.withColumns({c: F.round(c, d) for c, d in digits.items()})).withColumn("t_df", F.col("t_df").cast("double"))


_CHI = "(abs(low_yes - (low_yes + low_no) * (low_yes + high_yes) / n) - 0.5) ** 2 * (1 / ((low_yes + low_no) * (low_yes + high_yes) / n) + 1 / ((low_yes + low_no) * (low_no + high_no) / n) + 1 / ((high_yes + high_no) * (low_yes + high_yes) / n) + 1 / ((high_yes + high_no) * (low_no + high_no) / n))"


@check(f"""WITH t AS ({_TABLE_SQL}), c AS (SELECT variable, kind, t_stat, t_df, low_yes::DOUBLE AS low_yes, low_no::DOUBLE AS low_no, high_yes::DOUBLE AS high_yes, high_no::DOUBLE AS high_no,
  (low_yes + low_no + high_yes + high_no)::DOUBLE AS n FROM t), z AS (SELECT variable, kind, t_stat AS t, t_df AS v, sqrt({_CHI}) AS z FROM c)
SELECT variable, round(CASE kind WHEN 'continuous' THEN {student_tail("t", "v")} ELSE {normal_tail("z")} END, 4) AS p FROM z""")
def baseline_p_numbers(spark, sf):
    """t and corrected chi-square p-values as numbers."""
    t = ds.baseline_table(_order_rows(spark, sf), _TABLE_VARS, "high", "w")
    return t.select("variable", F.round("p", 4).alias("p"))


_CELLS_SQL = """c AS (SELECT c_nationkey::BIGINT AS nation, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal < 0)::DOUBLE AS low_yes, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal >= 0)::DOUBLE AS low_no,
 count(*) FILTER (c_mktsegment <> 'BUILDING' AND c_acctbal < 0)::DOUBLE AS high_yes, count(*) FILTER (c_mktsegment <> 'BUILDING' AND c_acctbal >= 0)::DOUBLE AS high_no, count(*)::DOUBLE AS n FROM customer GROUP BY 1)"""
_LOGP = "lgamma(low_yes + high_yes + 1) - lgamma({k} + 1) - lgamma(low_yes + high_yes - {k} + 1) + lgamma(low_no + high_no + 1) - lgamma(low_yes + low_no - {k} + 1) - lgamma(low_no + high_no - (low_yes + low_no) + {k} + 1)"


@check(f"""WITH {_CELLS_SQL}, k AS (SELECT c.*, unnest(range(greatest(0, low_yes + low_no + low_yes + high_yes - n)::BIGINT, least(low_yes + low_no, low_yes + high_yes)::BIGINT + 1)) AS k FROM c),
q AS (SELECT *, {_LOGP.format(k='k')} AS lp, {_LOGP.format(k='low_yes')} AS la FROM k),
e AS (SELECT nation, least(1, sum(CASE WHEN lp <= la + 1e-7 THEN exp(lp) ELSE 0 END) / sum(exp(lp))) AS exact FROM q GROUP BY 1), z AS (SELECT nation, sqrt({_CHI}) AS z FROM c)
SELECT c.nation, round(CASE WHEN least(low_yes, low_no, high_yes, high_no) < 5 THEN exact ELSE {normal_tail("z")} END, 8) AS p FROM c JOIN e USING (nation) JOIN z USING (nation)""")
def two_by_two_tests(spark, sf):
    """Exact test where a cell is small, otherwise the corrected chi-square, per nation."""
    first, below = F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal") < 0
    cells = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nation")).agg(
        *[F.count_if(x).cast("double").alias(n) for n, x in (("a", first & below), ("b", first & ~below), ("c", ~first & below), ("d", ~first & ~below))])
    return cells.select("nation", F.round(tails.two_by_two_p("a", "b", "c", "d"), 8).alias("p"))


@check()
def baseline_p_values(spark, sf):
    """The printable table with its p-values."""
    rows = _order_rows(spark, sf)
    labels = spark.createDataFrame([("c_acctbal", "Balance, mean±SD"), ("urgent", "Urgent, n (%)")], "variable string, label string")
    t = ds.baseline_table(rows, _TABLE_VARS, "high", "w")
    return ds.baseline_display(t, ds.group_sizes(rows, "high", "w"), labels)


@check(f"""WITH {L}, c AS (SELECT * FROM l WHERE score IS NOT NULL AND tax IS NOT NULL), u AS (SELECT 'returned' AS outcome, returned AS y FROM c UNION ALL SELECT 'finished', finished FROM c)
SELECT outcome, count(y) AS n_complete, sum(y)::BIGINT AS n_events, count(*) FILTER (y = 1) AS n_ones, count(*) FILTER (y = 0) AS n_zeros, round(sum(y) / count(y) * 100, 6) AS event_rate_pct FROM u GROUP BY 1""")
def outcome_profile(spark, sf):
    return rounded(ds.outcome_profile(lines(spark, sf), ["returned", "finished"], ["score", "tax"]))


@check(f"""WITH {L}, v AS (SELECT flag, price, sum(w) AS w FROM l GROUP BY 1, 2), c AS (SELECT flag, price, sum(w) OVER (PARTITION BY flag ORDER BY price) AS cum, sum(w) OVER (PARTITION BY flag) AS total FROM v)
SELECT flag, min(price) AS quantile, round(min(total), 6) AS sum_weights FROM c WHERE cum >= 0.5 * total GROUP BY 1""")
def weighted_median(spark, sf):
    return rounded(qn.weighted_quantile(lines(spark, sf), "price", "w", 0.5, ["flag"], per_range=4_000))


@check(f"""WITH {L}, b AS (SELECT least(floor((score - 0.0) / (51.0 / 39)), 38)::BIGINT AS bin, w FROM l WHERE score BETWEEN 0 AND 51),
s AS (SELECT bin, count(*) AS n, sum(w) AS sw FROM b GROUP BY 1)
SELECT r.bin, round(r.bin * (51.0::DOUBLE / 39), 6) AS left_edge, round((r.bin + 1) * (51.0::DOUBLE / 39), 6) AS right_edge, coalesce(n, 0) AS n,
 round(coalesce(sw / ((SELECT sum(w) FROM b) * (51.0::DOUBLE / 39)), 0), 6) AS density FROM (SELECT unnest(range(39)) AS bin) r LEFT JOIN s ON s.bin = r.bin""")
def histogram_density(spark, sf):
    return rounded(ds.histogram_density(lines(spark, sf), "score", 0.0, 51.0, 39, "w"))


@check(f"""WITH {L}, v AS (SELECT score AS v, sum(w) AS w, sum(w * w) AS w2 FROM l WHERE score IS NOT NULL GROUP BY 1),
s AS (SELECT sum(w) AS w, sum(w) ** 2 / sum(w2) AS ne, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 AS va FROM v),
h AS (SELECT w, ne ** -0.2 * sqrt(va / (1 - 1 / ne)) AS h FROM s), g AS (SELECT unnest(range(200)) AS point)
SELECT g.point, round(min(-4 + g.point * (59.0::DOUBLE / 199)), 6) AS x, round(sum(v.w * exp(-0.5 * ((-4 + g.point * (59.0::DOUBLE / 199) - v.v) / h.h) ** 2)) / min(h.w * h.h * sqrt(2 * pi())), 8) AS density
FROM v, h, g GROUP BY 1""")
def kernel_density(spark, sf):
    k = ds.kde(lines(spark, sf), "score", -4.0, 55.0, 200, "w")
    return k.select(F.col("point").cast("bigint").alias("point"), F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@check(f"""WITH {L}, v AS (SELECT qty AS v, sum(w) AS w FROM l GROUP BY 1), c AS (SELECT v, (sum(w) OVER (ORDER BY v) - w) / sum(w) OVER () AS s FROM v),
d AS (SELECT ((row_number() OVER () - 1) * 2654435761 + 2025) % 4294967296 / 4294967296.0::DOUBLE AS u FROM l)
SELECT c.v AS qty, count(*) AS n FROM d ASOF JOIN c ON d.u >= c.s GROUP BY 1""")
def weighted_resample(spark, sf):
    """As many seeded weighted draws as there are order lines, summarised per value."""
    l = lines(spark, sf)
    drawn = sampling.weighted_resample(l, "qty", "w", l.count(), 2025, arithmetic=True)
    return rounded(drawn.groupBy("qty").agg(F.count(F.lit(1)).alias("n")))


@check(f"""WITH {L}, k AS (SELECT * FROM l WHERE score IS NOT NULL), a AS (SELECT sum(w * score) / sum(w) AS m, sqrt(sum(w * score * score) / sum(w) - (sum(w * score) / sum(w)) ** 2) AS s FROM k),
c AS (SELECT score, sum(sum(w)) OVER (ORDER BY score) AS cum, sum(sum(w)) OVER () AS total FROM k GROUP BY 1)
SELECT count(*) AS n_before, round(avg(score), 6) AS mean_before, round(stddev_samp(score), 6) AS sd_before, median(score) AS median_before, count(*) AS n_after,
 round(min(a.m), 6) AS mean_after, round(min(a.s), 6) AS sd_after, (SELECT min(score) FROM c WHERE cum >= total / 2) AS median_after,
 round(min(a.m) - avg(score), 6) AS delta_mean, round(min(a.s) - stddev_samp(score), 6) AS delta_sd FROM k, a""")
def weighting_shift(spark, sf):
    l = lines(spark, sf)
    return rounded(ds.weighting_shift(l, l, "score", "w"))


_TESTS_SQL = """t AS (SELECT p_brand AS family, p_partkey AS id, exp(-p_retailprice * p_size / 9000) AS p FROM part)"""


def _tests(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("family"), F.col("p_partkey").alias("id"), F.exp(-F.col("p_retailprice") * F.col("p_size") / 9000).alias("p")
    )


@check(f"""WITH {_TESTS_SQL}, r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / rank() OVER (PARTITION BY family ORDER BY p DESC) AS unused,
  count(*) OVER (PARTITION BY family) AS m, count(*) OVER (PARTITION BY family ORDER BY p RANGE UNBOUNDED PRECEDING) AS k FROM t),
q AS (SELECT *, least(1.0::DOUBLE, min(p * m / k) OVER (PARTITION BY family ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q FROM r)
SELECT family, id, round(p, 8) AS p, round(q, 8) AS "FDR_q", q <= 0.05 AS "FDR_reject", round(0.05 / m, 8) AS "Bonf_threshold", p < 0.05 / m AS "Bonf_reject" FROM q""")
def multiple_tests(spark, sf):
    out = mt.bonferroni(mt.fdr_bh(_tests(spark, sf), "p", ["family"], per_range=500), "p", ["family"])
    return rounded(out, 8)


@check(f"""WITH {_TESTS_SQL}, q AS (SELECT id, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p) AS k FROM t),
z AS (SELECT id, least(1.0::DOUBLE, min(p * m / k) OVER (ORDER BY p DESC, k DESC)) AS q, p FROM q)
SELECT count(*) FILTER (q < 0.05) AS n_sig_primary, count(*) AS n_primary, count(*) FILTER (p < 0.05) AS n_sig_complete_case, count(*) AS n_complete_case, round(avg(p * 100), 6) AS mean_completeness_pct FROM z""")
def result_rollup(spark, sf):
    t = _tests(spark, sf).drop("family")
    return rounded(ds.rollup_results(mt.fdr_bh(t, per_range=500), t.withColumn("completeness_pct", F.col("p") * 100)))


# closed-form ratios of a binary exposure, per part type
_RATIO_SQL = """j AS (SELECT p_type AS outcome, l_linenumber, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS x, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END AS y, 0.5 + l_discount AS w
   FROM lineitem JOIN part ON p_partkey = l_partkey),
 g AS (SELECT outcome, x, sum(w * y) / sum(w) AS p, sum(w) AS sw, sum(w * w * y) AS w2y, sum(w * w) AS w2 FROM j GROUP BY 1, 2),
 v AS (SELECT outcome, x, p, (w2y - 2 * p * w2y + p * p * w2) / (p * sw) ** 2 AS v FROM g),
 r AS (SELECT a.outcome, ln(b.p / a.p) AS b, sqrt(a.v + b.v) AS se FROM v a JOIN v b ON a.outcome = b.outcome AND a.x = 0 AND b.x = 1),
 t AS (SELECT outcome, exp(b) AS rr, exp(b - 1.96 * se) AS lo, exp(b + 1.96 * se) AS hi, exp(-0.5 * (b / se) ** 2) AS p FROM r)"""


def ratios(spark, sf):
    """Ratio and interval per part type from grouped sums; ``p`` is a monotone stand-in."""
    j = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    x, y, w = F.col("l_quantity") > 25, (F.col("l_returnflag") == "R").cast("double"), 0.5 + F.col("l_discount")
    s = j.select(F.col("p_type").alias("outcome"), x.cast("int").alias("x"), y.alias("y"), w.alias("w")).groupBy("outcome", "x").agg(
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p"), F.sum("w").alias("sw"),
        F.sum(F.col("w") * F.col("w") * F.col("y")).alias("w2y"), F.sum(F.col("w") * F.col("w")).alias("w2"),
    ).withColumn("v", (F.col("w2y") - 2 * F.col("p") * F.col("w2y") + F.col("p") * F.col("p") * F.col("w2")) / F.pow(F.col("p") * F.col("sw"), F.lit(2)))
    side = lambda k, c: F.max(F.when(F.col("x") == k, F.col(c)))
    r = s.groupBy("outcome").agg(F.log(side(1, "p") / side(0, "p")).alias("b"), F.sqrt(side(0, "v") + side(1, "v")).alias("se"))
    z = F.col("b") / F.col("se")
    return r.select(
        "outcome", F.exp("b").alias("RR"), F.exp(F.col("b") - 1.96 * F.col("se")).alias("LCL"),
        F.exp(F.col("b") + 1.96 * F.col("se")).alias("UCL"), F.exp(-0.5 * z * z).alias("p"),
    )


def _labels(spark):
    return spark.createDataFrame([("ECONOMY", "Economy parts"), ("SMALL", "Small parts")], "name string, label string")


_LABEL = "CASE outcome WHEN 'ECONOMY' THEN 'Economy parts' WHEN 'SMALL' THEN 'Small parts' ELSE outcome END AS label"


@check(f"""WITH {_RATIO_SQL} SELECT row_number() OVER (ORDER BY rr, outcome) AS plot_rank, outcome, {_LABEL}, round(rr, 6) AS "RR", round(lo, 6) AS "LCL", round(hi, 6) AS "UCL", p < 0.05 AS significant FROM t""")
def forest_table(spark, sf):
    return rounded(charts.forest(ratios(spark, sf), _labels(spark), q="p"))


@check(f"""WITH {_RATIO_SQL} SELECT outcome, round(rr, 6) AS "mi_RR", round(lo, 6) AS "mi_LCL", round(hi, 6) AS "mi_UCL", p < 0.05 AS mi_significant, round(rr * 1.1, 6) AS "cc_RR",
 round(lo * 1.1, 6) AS "cc_LCL", round(hi * 1.1, 6) AS "cc_UCL", p < 0.05 AS cc_significant, {_LABEL}, row_number() OVER (ORDER BY rr, outcome) AS plot_rank FROM t""")
def comparison_table(spark, sf):
    r = ratios(spark, sf)
    other = r.select("outcome", *[(F.col(c) * 1.1).alias(c) for c in ("RR", "LCL", "UCL")], "p")
    return rounded(charts.compare_results(r, other, _labels(spark)))


@check(f"""WITH {_RATIO_SQL}, e AS (SELECT *, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS a, CASE WHEN rr < 1 THEN 1 / hi ELSE lo END AS b, CASE WHEN rr < 1 THEN 1 / lo ELSE hi END AS c FROM t)
SELECT outcome, round(rr, 6) AS "RR", round(lo, 6) AS "LCL", round(hi, 6) AS "UCL", round(a + sqrt(a * (a - 1)), 6) AS "E_value_point",
 round(CASE WHEN b > 1 THEN b + sqrt(b * (b - 1)) ELSE 1 END, 6) AS "E_value_CI_lower", round(CASE WHEN c > 1 THEN c + sqrt(c * (c - 1)) ELSE 1 END, 6) AS "E_value_CI_upper" FROM e""")
def e_values(spark, sf):
    return rounded(effects.e_value(ratios(spark, sf).drop("p")))


@check(f"""WITH {_RATIO_SQL}, h AS (SELECT CASE WHEN outcome < 'M' THEN 'first' ELSE 'second' END AS category, ln(rr) AS l, ((ln(hi) - ln(lo)) / 3.92) ** -2 AS w FROM t)
SELECT category, count(*) AS k, round(sum(w * l) / sum(w), 6) AS "pooled_log_RR", round(sum(w * l * l) - sum(w * l) ** 2 / sum(w), 6) AS "Q", count(*) - 1 AS df FROM h GROUP BY 1 HAVING count(*) >= 2""")
def heterogeneity_q(spark, sf):
    r = ratios(spark, sf).withColumn("category", F.when(F.col("outcome") < "M", "first").otherwise("second"))
    return rounded(effects.cochran_q(r, ["category"], with_p=False))


@check(f"""WITH {_RATIO_SQL}, h AS (SELECT CASE WHEN outcome < 'M' THEN 'first' ELSE 'second' END AS category, ln(rr) AS l, ((ln(hi) - ln(lo)) / 3.92) ** -2 AS w FROM t),
q AS (SELECT category, sum(w * l * l) - sum(w * l) ** 2 / sum(w) AS q, (count(*) - 1)::DOUBLE AS v FROM h GROUP BY 1 HAVING count(*) >= 2)
SELECT category, round(CASE WHEN v = 1 THEN {normal_tail("sqrt(q)")} ELSE {chi2_tail("q", "v")} END, 7) AS p FROM q""")
def heterogeneity_p(spark, sf):
    r = ratios(spark, sf).withColumn("category", F.when(F.col("outcome") < "M", "first").otherwise("second"))
    return effects.cochran_q(r, ["category"]).select("category", F.round("p_heterogeneity", 7).alias("p"))


@check(f"""WITH {_RATIO_SQL}, s AS (SELECT outcome, CASE WHEN outcome < 'M' THEN 'first' ELSE 'second' END AS category, rr, lo, hi FROM t),
o AS (SELECT unnest(['first', 'first', 'second', 'second']) AS category, unnest(['LARGE', 'ECONOMY', 'SMALL', 'NOWHERE']) AS stratum, unnest([0, 1, 2, 3]) AS place),
x AS (SELECT -1 AS place, NULL AS category, 'Overall (All participants)' AS stratum, avg(rr) AS rr, min(lo) AS lo, max(hi) AS hi, NULL::DOUBLE AS p FROM s
 UNION ALL SELECT place, o.category, stratum, rr, lo, hi, lo / hi FROM o JOIN s ON s.category = o.category AND s.outcome = o.stratum)
SELECT category, stratum, 1::BIGINT AS n, 0::BIGINT AS events, round(rr, 6) AS "RR", round(lo, 6) AS "LCL", round(hi, 6) AS "UCL", round(p, 6) AS p, row_number() OVER (ORDER BY place) AS plot_rank,
 count(*) OVER () - row_number() OVER (ORDER BY place) AS y_pos FROM x""")
def stratified_forest(spark, sf):
    s = ratios(spark, sf).withColumn("category", F.when(F.col("outcome") < "M", "first").otherwise("second")).select(
        "category", F.col("outcome").alias("stratum"), F.lit(1).alias("n"), F.lit(0).alias("events"), "RR", "LCL", "UCL",
        (F.col("LCL") / F.col("UCL")).alias("p"),  # any number: strata have p-values here, the overall row has none
    )
    overall = s.agg(F.max("n").alias("n"), F.min("events").alias("events"), F.avg("RR").alias("RR"), F.min("LCL").alias("LCL"), F.max("UCL").alias("UCL"))
    order = [("first", "LARGE"), ("first", "ECONOMY"), ("second", "SMALL"), ("second", "NOWHERE")]
    return rounded(charts.stratified_forest(overall, s, order))


@check("""WITH n AS (SELECT n_name AS var, n_regionkey % 3 AS tier FROM nation), b AS (SELECT count(*) * 1.5 / 2 AS c FROM n WHERE tier = 0)
SELECT var, tier::BIGINT AS tier, (tier * 5.0)::DOUBLE AS x, ((row_number() OVER (PARTITION BY tier ORDER BY var) - 1) * 1.5 + CASE WHEN tier = 1 THEN (SELECT c FROM b) ELSE 0 END)::DOUBLE AS y FROM n""")
def tier_positions(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("var"), (F.col("n_regionkey") % 3).alias("tier"))
    return rounded(charts.tier_layout(n))


_GRID = "min(a) + g.point * ((min(b) - min(a)) / 199)"


@check(f"""WITH {L}, k AS (SELECT score, w FROM l WHERE score IS NOT NULL), e AS (SELECT min(score) - 5 AS a, max(score) + 5 AS b FROM k),
v AS (SELECT 'before' AS series, score AS v, count(*)::DOUBLE AS w, count(*)::DOUBLE AS w2 FROM k GROUP BY 2 UNION ALL SELECT 'after', score, sum(w), sum(w * w) FROM k GROUP BY 2),
s AS (SELECT series, sum(w) AS sw, sum(w) ** 2 / sum(w2) AS ne, sum(w * v) / sum(w) AS m, sum(w * v * v) / sum(w) - (sum(w * v) / sum(w)) ** 2 AS va FROM v GROUP BY 1),
h AS (SELECT *, ne ** -0.2 * sqrt(va / (1 - 1 / ne)) AS h FROM s), g AS (SELECT unnest(range(200)) AS point)
SELECT v.series, g.point, round({_GRID}, 6) AS x, round(sum(v.w * exp(-0.5 * (((a + g.point * ((b - a) / 199)) - v.v) / h.h) ** 2)) / min(h.sw * h.h * sqrt(2 * pi())), 8) AS density
 FROM v JOIN h ON h.series = v.series, g, e GROUP BY 1, 2
UNION ALL SELECT 'normal', g.point, round({_GRID}, 6), round(exp(-0.5 * ((min(a) + g.point * ((min(b) - min(a)) / 199) - min(m)) ** 2) / min(va)) / sqrt(min(va) * 2 * pi()), 8) FROM g, e, s WHERE s.series = 'after' GROUP BY 2""")
def score_distribution(spark, sf):
    """Chart table: densities before and after weighting and the normal fit, on one grid."""
    from panelwright.plans.analysis import distribution

    l = lines(spark, sf)
    d = distribution(l, l, "score", "w")["density"]
    return d.select("series", F.col("point").cast("bigint").alias("point"), F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))
