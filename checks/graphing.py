"""Design matrices, folds, constraints, learners and graph tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.tables import LINES_SQL, lines, rounded, table
from panelwright.operators import discovery as d, graph as g, matrix as mx
from panelwright.operators.sums import keep_for_passes
from panelwright.plans import codebook as cb
from panelwright.plans.graphs import discover, forbidden_set, network_tables

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


# ---- matrices ------------------------------------------------------------

_VARS = ["quantity", "price", "discount", "tax", "closed"]
_MATRIX_SQL = """b AS (SELECT l_orderkey AS orderkey, CASE WHEN l_discount = 0.07 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice / 1000 AS price, l_discount * 100 AS discount,
  l_tax * 100 AS tax, CASE WHEN l_linestatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END AS closed, (l_orderkey * 2654435761 + 2025) % 4294967296 % 5 AS fold FROM lineitem), c AS (SELECT * FROM b WHERE quantity IS NOT NULL)"""


def _base(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("orderkey"), F.when(F.col("l_discount") != 0.07, F.col("l_quantity")).alias("quantity"),
        (F.col("l_extendedprice") / 1000).alias("price"), (F.col("l_discount") * 100).alias("discount"), (F.col("l_tax") * 100).alias("tax"),
        (F.col("l_linestatus") == "F").cast("double").alias("closed"),
    )


def _folded(spark, sf):
    rows, use = mx.prepare_matrix(_base(spark, sf), [*_VARS, "absent"], ["orderkey"])
    return mx.kfold(rows, ["orderkey"], 5, 2025, arithmetic=True), use


@check(f"""WITH {_MATRIX_SQL}, q AS (SELECT {', '.join(f'quantile_cont({v}, [0.25, 0.5, 0.75]) AS q_{v}' for v in _VARS[:4])} FROM c),
s AS (SELECT closed, {', '.join(f'({v} - q_{v}[2]) / (q_{v}[3] - q_{v}[1]) AS {v}' for v in _VARS[:4])} FROM c, q)
SELECT closed, count(*) AS n, {', '.join(f'round(avg({v}), 6) AS mean_{v}, round(max({v}), 6) AS max_{v}' for v in _VARS[:4])} FROM s GROUP BY 1""")
def prepared_matrix(spark, sf):
    rows, use = mx.prepare_matrix(_base(spark, sf), [*_VARS, "absent"])
    cont = use[:4]
    return rounded(rows.groupBy("closed").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in cont], *[F.max(v).alias(f"max_{v}") for v in cont]
    ))


@check(f"""WITH {_MATRIX_SQL} SELECT fold::BIGINT AS fold, count(*) AS n, count(DISTINCT orderkey) AS units FROM c GROUP BY 1""")
def hashed_folds(spark, sf):
    rows, _ = _folded(spark, sf)
    return rows.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("orderkey").alias("units"))


_PAIRS = [(a, b) for i, a in enumerate(["1", *_VARS]) for b in ["1", *_VARS][i:]]
_GRAM_SELECT = " UNION ALL ".join(
    f"SELECT fold, '{a}' AS var_i, '{b}' AS var_j, sum({'1.0::DOUBLE' if a == '1' else a} * {'1' if b == '1' else b}) AS val FROM c GROUP BY 1" for a, b in _PAIRS
)


@check(f"""WITH {_MATRIX_SQL}, g AS ({_GRAM_SELECT}) SELECT fold::BIGINT AS fold, var_i, var_j, round(val, 5) AS val FROM g""")
def fold_moments(spark, sf):
    """Sums of products per fold in one pass over the complete rows."""
    rows = mx.kfold(_base(spark, sf).na.drop(), ["orderkey"], 5, 2025, arithmetic=True)
    return rounded(mx.gram_entries(mx.fold_gram(rows, _VARS), _VARS), 5)


@check(f"""WITH {_MATRIX_SQL}, f AS (SELECT unnest(range(5)) AS k) SELECT k::BIGINT AS fold, count(*)::DOUBLE AS n, round(sum(quantity), 3) AS sum_quantity, round(sum(price * tax), 3) AS price_tax FROM f JOIN c ON c.fold <> k GROUP BY 1""")
def training_moments(spark, sf):
    """Moments of the training complement: total minus fold."""
    rows = mx.kfold(_base(spark, sf).na.drop(), ["orderkey"], 5, 2025, arithmetic=True)
    m = mx.training_moments(mx.fold_gram(rows, _VARS), "all", _VARS)
    spot = {p: i for i, p in enumerate(_PAIRS)}
    at = lambda a, b: F.element_at("gram", spot[(a, b)] + 1)
    n, mean = at("1", "1"), lambda a: at("1", a)
    return rounded(m.select("fold", n.alias("n"), (n * mean("quantity")).alias("sum_quantity"), (at("price", "tax") + n * mean("price") * mean("tax")).alias("price_tax")), 3)


_FAR = 1e9


@check(f"""WITH {_MATRIX_SQL}, f AS (SELECT unnest(range(5)) AS k) SELECT k::BIGINT AS fold, count(*)::DOUBLE AS n, round(avg(price), 4) AS price, round(covar_pop(price, quantity), 4) AS price_quantity,
 round(var_pop(price), 4) AS price_price FROM f JOIN c ON c.fold <> k GROUP BY 1""")
def distant_moments(spark, sf):
    """Covariances of the training complements when all prices are far from zero: the digits stay."""
    rows = mx.kfold(_base(spark, sf).na.drop().withColumn("price", F.col("price") + _FAR), ["orderkey"], 5, 2025, arithmetic=True)
    m = mx.training_moments(mx.fold_gram(rows, _VARS), "all", _VARS)
    spot = {p: i for i, p in enumerate(_PAIRS)}
    at = lambda a, b: F.element_at("gram", spot[(a, b)] + 1)
    n = at("1", "1")
    return rounded(m.select("fold", n.alias("n"), (at("1", "price") - _FAR).alias("price"), (at("quantity", "price") / n).alias("price_quantity"), (at("price", "price") / n).alias("price_price")), 4)


@check(f"""WITH {_MATRIX_SQL}, r AS (SELECT *, (row_number() OVER (ORDER BY (orderkey * 2654435761 + 2025) % 4294967296, orderkey, price, quantity, discount, tax, closed) - 1) % 10 AS part FROM c)
SELECT part::BIGINT AS fold, count(*) AS n, round(sum(price), 2) AS price, count(DISTINCT orderkey) AS units FROM r GROUP BY 1""")
def exact_folds(spark, sf):
    """Ten shuffled folds whose sizes differ by one row at most."""
    rows = keep_for_passes(_base(spark, sf).na.drop())
    folds = mx.exact_folds(rows, ["orderkey", "price", "quantity", "discount", "tax", "closed"], 10, 2025, arithmetic=True, per_range=5_000)
    return folds.groupBy(F.col("fold").cast("bigint").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price"), 2).alias("price"), F.count_distinct("orderkey").alias("units"))


@check(f"""WITH {_MATRIX_SQL} SELECT var, round(v, 4) AS variance, v > 10 AS kept FROM (SELECT unnest(['quantity', 'price', 'discount', 'tax', 'closed']) AS var,
 unnest([var_pop(quantity), var_pop(price), var_pop(discount), var_pop(tax), var_pop(closed)]) AS v FROM c)""")
def column_variances(spark, sf):
    """Low-variance columns are found on the diagonal of the moments."""
    rows = _base(spark, sf).na.drop().withColumn("fold", (F.col("orderkey") % 2).cast("int"))
    packed = mx.training_moments(mx.fold_gram(rows, _VARS), "all", _VARS).toPandas()["gram"]
    # the training moments of both folds, each the other's complement, add up to all rows
    _, _, cov = mx.unpack(mx.merge_packed(list(packed), len(_VARS)), len(_VARS))
    kept = set(mx.informative(cov, 10.0).tolist())
    told = [(v, float(cov[i, i]), i in kept) for i, v in enumerate(_VARS)]
    return rounded(spark.createDataFrame(told, "var string, variance double, kept boolean"), 4)


# ---- constraints and edge tables -----------------------------------------

_NODES_SQL = "n AS (SELECT n_name AS var, n_regionkey % 3 AS tier FROM nation), im AS (SELECT unnest(['CANADA', 'FRANCE', 'JAPAN', 'NATION_3', 'NATION_7']) AS v)"
_IMMUTABLE = ["CANADA", "FRANCE", "JAPAN", "NATION_3", "NATION_7"]


def _nodes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("var"), (F.col("n_regionkey") % 3).alias("tier"))


@check(f"""WITH {_NODES_SQL} SELECT a.var AS src, b.var AS dst, CASE WHEN a.tier > b.tier THEN 'tier' ELSE 'immutable' END AS reason FROM n a JOIN n b ON a.var <> b.var
WHERE a.tier > b.tier OR b.var IN (SELECT v FROM im)""")
def forbidden_edges(spark, sf):
    return g.forbidden_edges(_nodes(spark, sf), _IMMUTABLE)


@check(f"""WITH {_NODES_SQL} SELECT a.var AS src, b.var AS dst, CASE WHEN a.tier > b.tier THEN 'tier' ELSE 'immutable' END AS reason FROM n a JOIN n b ON a.var <> b.var
WHERE a.tier > b.tier OR (a.tier = b.tier AND b.var IN (SELECT v FROM im))""")
def forbidden_within_tier(spark, sf):
    return g.forbidden_edges(_nodes(spark, sf), _IMMUTABLE, same_tier_only=True)


# Weights are multiples of 0.01, so no edge sits on the 0.505 threshold.
# trade edges: customer nation -> supplier nation, one "method" per line status and return flag
_EDGES_SQL = f"""e AS (SELECT r_name AS subset, l_returnflag AS method, l_linenumber AS fold, cn.n_name AS src, sn.n_name AS dst, sum((l_discount - 0.05) * l_quantity) AS coef
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation cn ON cn.n_nationkey = c_nationkey JOIN region ON r_regionkey = cn.n_regionkey
 JOIN supplier ON s_suppkey = l_suppkey JOIN nation sn ON sn.n_nationkey = s_nationkey GROUP BY ALL)"""


def _edges(spark, sf):
    t = lambda n: table(spark, sf, n)
    cn, sn = t("nation").select(F.col("n_nationkey").alias("ck"), F.col("n_name").alias("src"), "n_regionkey"), t("nation").select(F.col("n_nationkey").alias("sk"), F.col("n_name").alias("dst"))
    j = (
        t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
        .join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(cn, F.col("ck") == F.col("c_nationkey"))
        .join(t("region"), F.col("r_regionkey") == F.col("n_regionkey")).join(sn, F.col("sk") == F.col("s_nationkey"))
    )
    return j.groupBy(F.col("r_name").alias("subset"), F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("fold"), "src", "dst").agg(
        F.sum((F.col("l_discount") - 0.05) * F.col("l_quantity")).alias("coef")
    )


@check(f"""WITH {_NODES_SQL}, {_EDGES_SQL} SELECT subset, method, fold::BIGINT AS fold, src, dst, round(coef, 6) AS coef FROM e JOIN n a ON a.var = src JOIN n b ON b.var = dst
WHERE src <> dst AND abs(coef) > 0.505 AND a.tier <= b.tier AND dst NOT IN (SELECT v FROM im)""")
def constrained_edges(spark, sf):
    kept = g.apply_constraints(g.threshold_edges(_edges(spark, sf), 0.505), _nodes(spark, sf), _IMMUTABLE)
    return rounded(kept)


_CONSENSUS = f"{_EDGES_SQL}, k AS (SELECT subset, method, src, dst, count(*) AS fold_count, avg(coef) AS avg_coefficient FROM e WHERE src <> dst AND abs(coef) > 0.505 GROUP BY ALL HAVING count(*) >= 6)"


def _consensus(spark, sf):
    return g.fold_consensus(g.threshold_edges(_edges(spark, sf), 0.505), 6)


@check(f"WITH {_CONSENSUS} SELECT subset, method, src, dst, fold_count, round(avg_coefficient, 6) AS avg_coefficient, src || '→' || dst AS path FROM k")
def fold_consensus(spark, sf):
    return rounded(g.with_path(_consensus(spark, sf)))


@check(f"""WITH {_CONSENSUS}, m AS (SELECT subset, src, dst, count(DISTINCT method) AS n_methods, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM k GROUP BY ALL)
SELECT *, contains(src, 'IA') OR contains(dst, 'IA') OR contains(src, '_1') OR contains(dst, '_1') AS exposure_related, CASE WHEN n_methods >= 2 THEN least(n_methods, 4)::VARCHAR ELSE methods END AS edge_class FROM m""")
def method_agreement(spark, sf):
    """Edges rebuilt from their display path, classed by the number of agreeing methods."""
    back = g.split_path(g.with_path(_consensus(spark, sf)).drop("src", "dst"))
    return g.edge_classes(g.method_agreement(back), ["IA", "_1"])


@check(f"""WITH {_CONSENSUS}, u AS (SELECT DISTINCT subset, src, dst FROM k), nd AS (SELECT r_name AS subset, n_name AS var FROM nation JOIN region ON r_regionkey = n_regionkey),
a AS (SELECT subset, var, sum(d) AS degree FROM (SELECT subset, var, 0 AS d FROM nd UNION ALL SELECT subset, src, 1 FROM u UNION ALL SELECT subset, dst, 1 FROM u) GROUP BY ALL)
SELECT a.subset, count(*) AS n_nodes, count(*) FILTER (degree = 0) AS n_isolated, count(*) FILTER (degree > 0) AS n_connected, coalesce(min(c.n), 0)::BIGINT AS n_edges
FROM a LEFT JOIN (SELECT subset, count(*) AS n FROM u GROUP BY 1) c ON c.subset = a.subset GROUP BY 1""")
def graph_summary(spark, sf):
    nodes = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(
        F.col("r_name").alias("subset"), F.col("n_name").alias("var")
    )
    return g.graph_summary(nodes, _consensus(spark, sf)).withColumn("n_edges", F.col("n_edges").cast("bigint"))


@check(f"""WITH l AS ({LINES_SQL}) SELECT flag, src, dst, round(coef, 8) AS coef FROM (SELECT flag, unnest(['score', 'score', 'tax', 'tax', 'price', 'price']) AS src, unnest(['tax', 'price', 'score', 'price', 'score', 'tax']) AS dst,
 unnest([corr(score, tax), corr(score, price), corr(score, tax), corr(tax, price), corr(score, price), corr(tax, price)]) AS coef FROM (SELECT * FROM l WHERE score IS NOT NULL) GROUP BY flag) WHERE abs(coef) > 0.002""")
def matrix_to_edges(spark, sf):
    """A correlation matrix per group, flattened to thresholded edge rows."""
    names = ["score", "tax", "price"]
    m = lines(spark, sf).filter(F.col("score").isNotNull()).groupBy("flag").agg(
        F.array(*[F.corr(a, b) for a in names for b in names]).alias("matrix")
    ).withColumn("names", F.array(*[F.lit(n) for n in names]))
    return rounded(g.matrix_edges(m, 0.002), 8)


# ---- learners ------------------------------------------------------------

_LEARN = ["quantity", "price", "discount", "tax"]


def _learning_rows(spark, sf):
    base = _base(spark, sf).withColumn("price", F.col("price") + F.col("quantity") * 2).withColumn("tax", F.col("tax") + F.col("price") / 20)
    ready, use = mx.prepare_matrix(base, _LEARN, ["orderkey"])
    rows = keep_for_passes(mx.exact_folds(keep_for_passes(ready), ["orderkey"], cb.GRAPH_FOLDS, 2025).select("fold", *use))
    return rows, mx.training_moments(mx.fold_gram(rows, use), "lines", use), use


@check(f"""WITH {_NODES_SQL}, {_CONSENSUS}, nd AS (SELECT 'AFRICA' AS subset, var, tier FROM n), u AS (SELECT DISTINCT src, dst FROM k WHERE subset = 'AFRICA'),
d AS (SELECT var, sum(x)::BIGINT AS degree FROM (SELECT var, 0 AS x FROM nd UNION ALL SELECT src, 1 FROM u UNION ALL SELECT dst, 1 FROM u) GROUP BY 1),
t AS (SELECT var, degree, CASE WHEN var = 'FRANCE' THEN 1 ELSE CASE WHEN regexp_matches(var, '_2[23]$') THEN 2 ELSE 0 END END AS tier FROM d)
SELECT var, degree, CASE var WHEN 'FRANCE' THEN 'Exposed' WHEN 'JAPAN' THEN 'East' ELSE regexp_replace(var, '_2[23]$', '') END AS label FROM t""")
def network_node_labels(spark, sf):
    """Degrees and labels of a network built from table-derived edges: no learner."""
    variables = _nodes(spark, sf).select(F.lit("AFRICA").alias("subset"), "var")
    nodes = network_tables(_consensus(spark, sf), variables, "AFRICA", ["FRANCE"], labels={"FRANCE": "Exposed", "JAPAN": "East"})[0]
    return rounded(nodes.select("var", F.col("degree").cast("bigint").alias("degree"), "label"))


@check(f"""WITH {_MATRIX_SQL}, f AS (SELECT unnest(range(5)) AS k), t AS (SELECT k, count(*) AS n, 2 + (var_pop(CASE WHEN fold = 3 THEN 1.0 ELSE 0.0 END) > 1e-10)::INT AS w FROM f JOIN c ON c.fold <> k GROUP BY 1),
l AS (SELECT unnest(['DirectLiNGAM', 'GOLEM', 'ORDER_BIC', 'DAGMA_LINEAR']) AS method, unnest([2, 2, 3, 2]) AS least)
SELECT 'lines' AS subset, method, k::INT AS fold, n AS n_rows, w AS n_columns, CASE WHEN w < least THEN 'too_few' ELSE 'ok' END AS status FROM t, l""")
def learner_status(spark, sf):
    """Every learner run has its row; one column varies in one fold only, so the model without that fold has two columns left."""
    rows = mx.kfold(_base(spark, sf).na.drop(), ["orderkey"], 5, 2025, arithmetic=True)
    rows = rows.select("fold", "quantity", "price", (F.col("fold") == 3).cast("double").alias("third"))
    use = ["quantity", "price", "third"]
    return rounded(d.learner_runs(mx.training_moments(mx.fold_gram(rows, use), "lines", use)))


def _first_merits_sql() -> str:
    """Entropies of every variable and of every residual over each fold's complement, written out pair by pair."""
    pairs = [(a, b) for a in _LEARN for b in _LEARN if a != b]
    moments = [f"avg({v}) AS m_{v}, var_pop({v}) AS v_{v}" for v in _LEARN] + [f"covar_pop({a}, {b}) AS c_{a}_{b}" for a, b in pairs]
    z = {v: f"({v} - m_{v}) / sqrt(v_{v})" for v in _LEARN}
    z |= {f"{a}_{b}": f"({a} - m_{a} - c_{a}_{b} / v_{b} * ({b} - m_{b})) / sqrt(v_{a} - c_{a}_{b} * c_{a}_{b} / v_{b})" for a, b in pairs}
    means = [f"avg(abs(z_{k}) + ln(1 + exp(-2 * abs(z_{k}))) - ln(2)) AS l_{k}, avg(z_{k} * exp(-z_{k} * z_{k} / 2)) AS g_{k}" for k in z]
    entropy = [f"0.5 * (1 + ln(2 * pi())) - {d.ENTROPY_K1} * (l_{k} - {d.ENTROPY_GAMMA}) ** 2 - {d.ENTROPY_K2} * g_{k} ** 2 AS h_{k}" for k in z]
    merit = {a: " - ".join(["0"] + [f"least(0, (h_{b} + h_{a}_{b}) - (h_{a} + h_{b}_{a})) ** 2" for b in _LEARN if b != a]) for a in _LEARN}
    return f"""WITH {_MATRIX_SQL}, f AS (SELECT unnest(range(5)) AS k), t AS (SELECT k, {', '.join(_LEARN)} FROM f JOIN c ON c.fold <> k),
m AS (SELECT k, {', '.join(moments)} FROM t GROUP BY k), z AS (SELECT k, {', '.join(f'{e} AS z_{k}' for k, e in z.items())} FROM t JOIN m USING (k)),
a AS (SELECT k, {', '.join(means)} FROM z GROUP BY k), h AS (SELECT k, {', '.join(entropy)} FROM a)
""" + " UNION ALL ".join(f"SELECT 'lines' AS subset, k::INT AS fold, '{v}' AS var, round({e}, 9) AS merit FROM h" for v, e in merit.items())


@check(_first_merits_sql())
def first_in_order(spark, sf):
    """First step of the pairwise ordering: every variable's merit in every fold model."""
    rows = mx.kfold(_base(spark, sf).na.drop(), ["orderkey"], 5, 2025, arithmetic=True).select("fold", *_LEARN)
    moments = mx.training_moments(mx.fold_gram(rows, _LEARN), "lines", _LEARN)
    return rounded(d.first_merits(rows, moments, _LEARN), 9)


@check()
def learn_pairwise_order(spark, sf):
    rows, moments, use = _learning_rows(spark, sf)
    return g.fold_consensus(d.direct_lingam(rows, moments, use, [{("tax", "quantity")}]), cb.GRAPH_MIN_FOLDS)


@check()
def learn_likelihood(spark, sf):
    _, moments, _ = _learning_rows(spark, sf)
    return g.fold_consensus(d.golem(moments, {("tax", "quantity")}), cb.GRAPH_MIN_FOLDS)


@check()
def learn_order_bic(spark, sf):
    _, moments, _ = _learning_rows(spark, sf)
    return g.fold_consensus(d.order_search_bic(moments, {("tax", "quantity")}), cb.GRAPH_MIN_FOLDS)


@check()
def learn_logdet(spark, sf):
    _, moments, _ = _learning_rows(spark, sf)
    return g.fold_consensus(d.dagma_linear(moments, {("tax", "quantity")}), cb.GRAPH_MIN_FOLDS)


@check()
def discovered_graph(spark, sf):
    """All subsets, methods and folds in one flow: consensus edges with their class."""
    base = _base(spark, sf).withColumn("HI_price", F.col("price") + F.col("quantity") * 2).withColumn("tax_23", F.col("tax") + F.col("price") / 20)
    subsets = {"first": ["quantity", "discount", "HI_price", "tax_23"], "second": ["discount", "closed", "HI_price", "tax_23"]}
    edges, variables = discover(base, ["orderkey"], subsets, ["HI_price"], immutable_mask=["quantity"], immutable_filter=["quantity", "discount"])
    return g.edge_classes(g.method_agreement(edges), ["HI_"])


@check()
def network_nodes(spark, sf):
    """Chart table: node positions and degrees of a learned graph."""
    rows, moments, use = _learning_rows(spark, sf)
    cat = g.catalog(spark.createDataFrame([(v,) for v in use], "var string"), ["price"])
    edges = g.fold_consensus(d.order_search_bic(moments, forbidden_set(g.forbidden_edges(cat, ["quantity"]))), cb.GRAPH_MIN_FOLDS)
    variables = spark.createDataFrame([("lines", v) for v in [*use, "unused"]], "subset string, var string")
    return network_tables(edges, variables, "lines", ["price"])[0]
