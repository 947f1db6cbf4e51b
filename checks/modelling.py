"""Weights, imputation, models, pooling and sensitivity analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.integrals import normal_tail
from checks.newton import fit_sql, se_of, variance
from checks.tables import LINES_SQL, WAVES_SQL, baseline_wave, panel, rounded, spread_lines as lines, table
from panelwright.functions import tails
from panelwright.operators import effects, glm, impute, quantiles as qn, spline, sweeps, weights

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


L = f"l AS ({LINES_SQL})"


def _rr(b="b1", se="sqrt(var)", suffix=""):
    return (f'round(exp({b}), 6) AS "RR{suffix}", round(exp({b} - 1.96 * {se}), 6) AS "LCL{suffix}", round(exp({b} + 1.96 * {se}), 6) AS "UCL{suffix}"')


# ---- weights -------------------------------------------------------------

_W1 = f"{WAVES_SQL}, f AS (SELECT w.custkey, CASE WHEN w.urgent_base = 1 THEN NULL ELSE w.price_base END AS price, w.n_base, CASE WHEN p.custkey IS NULL THEN 0 ELSE 1 END AS y FROM wave1 w LEFT JOIN panel p ON p.custkey = w.custkey)"
_STD = f"""{_W1}, md AS (SELECT median(price) AS mp, median(n_base) AS mn FROM f), fl AS (SELECT custkey, y, coalesce(price, mp) AS price, coalesce(n_base, mn) AS n_base FROM f, md),
st AS (SELECT avg(price) AS ap, stddev_pop(price) AS sp, avg(n_base) AS an, stddev_pop(n_base) AS sn FROM fl),
z AS (SELECT custkey, y, (price - ap) / sp AS x1, (n_base - an) / sn AS x2 FROM fl, st)"""


def _first_wave(spark, sf):
    w = baseline_wave(spark, sf)
    return w.withColumn("price", F.when(F.col("urgent_base") != 1, F.col("price_base"))).select("custkey", "price", "n_base")


@check(f"""WITH {_STD} SELECT custkey, round(x1, 6) AS price, round(x2, 6) AS n_base FROM z""")
def filled_and_standardised(spark, sf):
    w = _first_wave(spark, sf)
    return rounded(weights.standardise(weights.median_fill(w, ["price", "n_base"]), ["price", "n_base"]))


@check(f"""WITH {_STD}, {fit_sql("SELECT 1 AS m, y::DOUBLE AS y, 1.0::DOUBLE AS w, x1, x2 FROM z", 2, 9, "binomial", 1.0)},
p AS (SELECT custkey, y, least(greatest(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))), 1e-6), 1 - 1e-6) AS p, (SELECT avg(y) FROM z) AS pb FROM z, fit),
r AS (SELECT custkey, y, CASE WHEN y = 1 THEN pb / p ELSE (1 - pb) / (1 - p) END AS raw FROM p),
q AS (SELECT quantile_cont(raw, 0.01) AS lo, quantile_cont(raw, 0.99) AS hi FROM r WHERE y = 1)
SELECT custkey, round(least(greatest(raw, lo), hi), 6) AS ipcw_weight, y::BIGINT AS complete3 FROM r, q""")
def ipcw(spark, sf):
    """Follow-up weights of 1995 customers: ridge logistic model, stabilised, trimmed."""
    return rounded(weights.ipcw(_first_wave(spark, sf), panel(spark, sf), ["custkey"], ["price", "n_base"]))


@check(f"""WITH {L}, q AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM l WHERE returned = 1)
SELECT returned, count(*) AS n, round(sum(least(greatest(price, lo), hi)), 2) AS total, round(min(greatest(price, lo)), 4) AS lo, round(max(least(price, hi)), 4) AS hi FROM l, q GROUP BY 1""")
def trimmed_weights(spark, sf):
    t = weights.trim(lines(spark, sf), "price", "returned", "trimmed")
    return t.groupBy("returned").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("trimmed"), 2).alias("total"), F.round(F.min("trimmed"), 4).alias("lo"), F.round(F.max("trimmed"), 4).alias("hi")
    )


# ---- imputation ----------------------------------------------------------

_ORDERS_SQL = """SELECT o_orderkey, c_acctbal / 1000 AS balance, CASE WHEN o_orderpriority = '3-MEDIUM' THEN NULL ELSE o_totalprice / 1000 END AS price, (o_orderstatus = 'F')::INT::DOUBLE AS closed
 FROM orders JOIN customer ON c_custkey = o_custkey"""


def _priced(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.select(
        "o_orderkey", (F.col("c_acctbal") / 1000).alias("balance"),
        F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_totalprice") / 1000).alias("price"),
        (F.col("o_orderstatus") == "F").cast("double").alias("closed"), F.col("o_orderpriority").alias("priority"),
    )


def _evidence(source: str, x: str, y: str) -> str:
    """CTEs over ``o``; ``e`` holds slope b and means mx, my. One predictor: the evidence iteration is a scalar recursion."""
    return f"""o AS ({source}), s AS (SELECT count(*)::DOUBLE AS n, avg({x}) AS mx, avg({y}) AS my, regr_sxx({y}, {x}) AS sxx, regr_sxy({y}, {x}) AS sxy, regr_syy({y}, {x}) AS syy
  FROM o WHERE {y} IS NOT NULL),
it AS (SELECT 0 AS i, 1 / (syy / n + 2.220446049250313e-16) AS al, 1.0::DOUBLE AS la, 0.0::DOUBLE AS b FROM s
 UNION ALL SELECT i + 1, (n - ga + 2e-6) / (rs + 2e-6), (ga + 2e-6) / (nb * nb + 2e-6), nb
  FROM (SELECT i, n, nb, al * sxx / (la + al * sxx) AS ga, greatest(syy - 2 * nb * sxy + nb * nb * sxx, 0) AS rs FROM (SELECT i, al, la, sxy / (sxx + la / al) AS nb, n, sxx, sxy, syy FROM it, s WHERE i < 300))),
e AS (SELECT sxy / (sxx + la / al) AS b, mx, my FROM it, s WHERE i = 300)"""


@check(f"""WITH RECURSIVE {_evidence(_ORDERS_SQL, "balance", "price")}
SELECT o_orderkey, round(o.balance, 6) AS balance, round(coalesce(o.price, my + e.b * (o.balance - mx)), 6) AS price FROM o, e""")
def conditional_mean_imputation(spark, sf):
    """Deterministic mode: missing prices get their regression prediction."""
    o = _priced(spark, sf).select("o_orderkey", "balance", "price")
    done = impute.mice(o, ["o_orderkey"], ["balance", "price"], m=1, sample=False, tol=1e-13).drop("mi_id")
    return rounded(done)


_LINE_PRICES = "SELECT l_orderkey, l_quantity AS q, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_extendedprice / 1000 END AS price FROM lineitem"


@check(f"""WITH RECURSIVE {_evidence(_LINE_PRICES, "q", "price")} SELECT l_orderkey, count(*) AS n, round(sum(q), 2) AS quantity, round(sum(coalesce(price, my + e.b * (q - mx))), 2) AS price FROM o, e GROUP BY 1""")
def imputation_with_repeated_keys(spark, sf):
    """A panel whose key repeats: every line of an order keeps its row."""
    l = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").alias("q"), F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 1000).alias("price"))
    done = impute.mice(l, ["l_orderkey"], ["q", "price"], m=1, rounds=1, sample=False, tol=1e-13)
    return rounded(done.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("q"), 2).alias("quantity"), F.round(F.sum("price"), 2).alias("price")))


def _mixed_steps(name: str, source: str, h: str, salt: str, keep: str) -> str:
    """CTEs of a 64-bit hash of an unsigned number and a salt, one step each: ``name`` has ``z`` beside the columns ``keep`` of ``source``."""
    m = "18446744073709551616::UHUGEINT"
    return f"""{name}a AS (SELECT {keep}, (({h})::UHUGEINT + (({salt})::UHUGEINT * 11400714819323198485::UHUGEINT) % {m}) % {m} AS z FROM {source}),
{name}b AS (SELECT {keep}, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {m} AS z FROM {name}a),
{name}c AS (SELECT {keep}, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {m} AS z FROM {name}b),
{name} AS (SELECT {keep}, xor(z, z // 2147483648::UHUGEINT) AS z FROM {name}c)"""


def _chained_sql(rounds: int = 25, m: int = 5, seed: int = 2025) -> str:
    """Two columns with gaps and a complete one, redrawn in turn; u is the one with fewer gaps. All rounds are written out."""
    parts = [f"""o AS ({_ORDERS_SQL.replace("SELECT o_orderkey, c_acctbal / 1000 AS balance", "SELECT o_orderkey, CASE WHEN o_orderpriority <> '5-LOW' THEN c_acctbal / 1000 END AS balance")}),
f AS (SELECT avg(balance) AS mb, avg(price) AS mp, avg(closed) AS mc, count(balance) >= count(price) AS swap FROM o),
r AS MATERIALIZED (SELECT o_orderkey AS id, coalesce(CASE WHEN swap THEN balance - mb ELSE price - mp END, 0) AS u, coalesce(CASE WHEN swap THEN price - mp ELSE balance - mb END, 0) AS v, closed - mc AS c,
  CASE WHEN swap THEN balance ELSE price END IS NULL AS gu, CASE WHEN swap THEN price ELSE balance END IS NULL AS gv, swap::INT AS swap FROM o, f)""",
        _mixed_steps("hh", "r", "id", str(seed), "id, u, v, c, gu, gv, swap"),
        f"s0 AS MATERIALIZED (SELECT id, u, v, c, gu, gv, swap, k, (z + k::UHUGEINT) % 18446744073709551616::UHUGEINT AS h FROM hh, (SELECT unnest(range(1, {m + 1})) AS k))"]
    step = 0
    for r in range(rounds):
        for target, other in (("u", "v"), ("v", "u")):
            # columns are numbered balance, price, closed
            column = f"(CASE WHEN swap = 1 THEN {0 if target == 'u' else 1} ELSE {1 if target == 'u' else 0} END)"
            salt, n = f"({3 * r} + {column})", step + 1
            parts.append(f"""m{n} AS MATERIALIZED (SELECT k, count(*)::DOUBLE AS n, avg({other}) AS mx, avg(c) AS mc, avg({target}) AS my, var_pop({other}) * count(*) AS sxx, var_pop(c) * count(*) AS scc, covar_pop({other}, c) * count(*) AS sxc,
  covar_pop({other}, {target}) * count(*) AS sxy, covar_pop(c, {target}) * count(*) AS scy, var_pop({target}) * count(*) AS syy FROM s{step} WHERE NOT g{target} GROUP BY k),
g{n} AS (SELECT *, (sxx + scc) / 2 + sqrt((sxx - scc) ** 2 / 4 + sxc ** 2) AS e1, (sxx + scc) / 2 - sqrt((sxx - scc) ** 2 / 4 + sxc ** 2) AS e2 FROM m{n}),
i{n} AS (SELECT k, 0 AS i, 1 / (syy / n + 2.220446049250313e-16) AS al, 1.0::DOUBLE AS la, 0.0::DOUBLE AS b, 0.0::DOUBLE AS d, false AS done FROM g{n}
 UNION ALL SELECT k, i + 1, (n - us + 2e-6) / (rs + 2e-6), (us + 2e-6) / (nb * nb + nd * nd + 2e-6), nb, nd, i > 0 AND abs(nb - b) + abs(nd - d) < 1e-3
  FROM (SELECT *, al * e1 / (la + al * e1) + al * greatest(e2, 0) / (la + al * greatest(e2, 0)) AS us,
      greatest(syy - 2 * (nb * sxy + nd * scy) + nb * nb * sxx + 2 * nb * nd * sxc + nd * nd * scc, 0) AS rs
    FROM (SELECT i{n}.i, i{n}.al, i{n}.la, i{n}.b, i{n}.d, g{n}.*, ((scc + la / al) * sxy - sxc * scy) / ((sxx + la / al) * (scc + la / al) - sxc * sxc) AS nb,
        ((sxx + la / al) * scy - sxc * sxy) / ((sxx + la / al) * (scc + la / al) - sxc * sxc) AS nd FROM i{n} JOIN g{n} USING (k) WHERE NOT done AND i < 300))),
c{n} AS MATERIALIZED (SELECT g.k, mx, mc, my, al, sxx + la / al AS a, scc + la / al AS e, sxc AS f, (sxx + la / al) * (scc + la / al) - sxc * sxc AS det, sxy, scy
  FROM g{n} g JOIN (SELECT k, arg_max(al, i) AS al, arg_max(la, i) AS la FROM i{n} GROUP BY k) USING (k))""")
            keep = "id, k"
            parts.append(_mixed_steps(f"p{n}", f"(SELECT id, k, h, swap FROM s{step} WHERE g{target})", "h", f"2 * {salt} + 1", keep + ", swap"))
            parts.append(_mixed_steps(f"q{n}", f"(SELECT id, k, swap, z AS w FROM p{n})", "w", f"2 * {salt} + 2", keep + ", w"))
            parts.append(f"""s{n} AS MATERIALIZED (SELECT s.* REPLACE (CASE WHEN s.g{target} THEN my + ((e * sxy - f * scy) * ({other} - mx) + (a * scy - f * sxy) * (c - mc)) / det
   + sqrt((e * ({other} - mx) ** 2 - 2 * f * ({other} - mx) * (c - mc) + a * (c - mc) ** 2) / det / al + 1 / al)
   * sqrt(-2 * ln(((w // 2048::UHUGEINT)::DOUBLE + 0.5) / 9007199254740992)) * cos(2 * pi() * ((z // 2048::UHUGEINT)::DOUBLE / 9007199254740992)) ELSE {target} END AS {target})
  FROM s{step} s JOIN c{n} USING (k) LEFT JOIN q{n} q ON q.id = s.id AND q.k = s.k)""")
            step = n
    done = f"SELECT k AS mi_id, CASE WHEN s.swap = 1 THEN u ELSE v END + mb AS balance, CASE WHEN s.swap = 1 THEN v ELSE u END + mp AS price FROM s{step} s, f"
    return (f"WITH RECURSIVE {', '.join(parts)} SELECT mi_id::INT AS mi_id, count(*) AS n, count(price) AS n_price, round(avg(price), 3) AS mean, round(stddev_samp(price), 3) AS sd, "
            f"round(avg(balance), 3) AS balance FROM ({done}) GROUP BY mi_id")


@check(_chained_sql())
def multiple_imputation(spark, sf):
    """Five chains of posterior draws for two columns with gaps, summarised per chain."""
    o = _priced(spark, sf).withColumn("balance", F.when(F.col("priority") != "5-LOW", F.col("balance")))
    done = impute.mice(o, ["o_orderkey"], ["balance", "price", "closed"], draw_id="o_orderkey")
    return rounded(done.groupBy("mi_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("n_price"), F.avg("price").alias("mean"), F.stddev_samp("price").alias("sd"), F.avg("balance").alias("balance")
    ), 3)


# ---- models --------------------------------------------------------------

@check(f"""WITH {L}, g AS (SELECT line, bulk, sum(w * returned) / sum(w) AS p, sum(w) AS sw, sum(w * w * returned) AS w2y, sum(w * w) AS w2, count(*) AS n FROM l GROUP BY 1, 2),
v AS (SELECT *, (w2y - 2 * p * w2y + p * p * w2) / (p * sw) ** 2 AS v FROM g), r AS (SELECT a.line, ln(b.p / a.p) AS b1, a.v + b.v AS var, a.n + b.n AS n FROM v a JOIN v b ON a.line = b.line AND a.bulk = 0 AND b.bulk = 1)
SELECT 'line ' || line::INT AS stratum, n, round(b1, 6) AS b, round(sqrt(var), 6) AS se FROM r""")
def closed_form_ratio(spark, sf):
    """Binary exposure without covariates, one model per stratum: known in closed form."""
    specs = [glm.ModelSpec(f"line {i}", "returned", ("bulk",), (("line", float(i)),), f"line {i}") for i in range(1, 8)]
    batch = glm.GlmBatch(lines(spark, sf), specs, "w")
    out = glm.estimates(batch.fit_frame()).select(F.col("label").alias("stratum"), "n", "b", "se")
    batch.close()
    return rounded(out)


@check(f"""WITH {L}, {fit_sql("SELECT o AS m, CASE o WHEN 'returned' THEN returned ELSE finished END AS y, w, score AS x1, tax AS x2 FROM l, (SELECT unnest(['returned', 'finished']) AS o)", 2)},
{se_of(0, 2, "v0")}, {se_of(1, 2, "v1")}, {se_of(2, 2, "v2")}
SELECT f.m AS outcome, t.term, meat.n, round(t.b, 6) AS b, round(sqrt(t.v), 6) AS se FROM fit f JOIN meat USING (m) JOIN v0 USING (m) JOIN v1 USING (m) JOIN v2 USING (m),
 LATERAL (SELECT unnest(['Intercept', 'score', 'tax']) AS term, unnest([f.b0, f.b1, f.b2]) AS b, unnest([v0.var, v1.var, v2.var]) AS v) t""")
def poisson_models(spark, sf):
    """Two outcomes, continuous score and covariate: coefficients and robust errors of every term."""
    specs = [glm.ModelSpec(o, o, ("score", "tax")) for o in ("returned", "finished")]
    batch = glm.GlmBatch(lines(spark, sf), specs, "w")
    out = glm.estimates(batch.fit_frame(), "*").select("outcome", "term", "n", "b", "se")
    batch.close()
    return rounded(out)


@check(f"""WITH {L}, z AS (SELECT *, least(score, 40) AS s2 FROM l), {fit_sql("SELECT 1 AS m, returned AS y, w, score / 10 AS x1, tax AS x2, price / 50000 AS x3 FROM z", 3)}, {se_of(1, 3)}
SELECT (SELECT n FROM meat) AS n, round(b1, 6) AS b, round(sqrt(var), 6) AS se FROM fit JOIN v USING (m)""")
def poisson_distinct_rows(spark, sf):
    """A continuous covariate: no two design rows agree, so rows are not merged."""
    l = lines(spark, sf).withColumn("score", F.col("score") / 10).withColumn("price", F.col("price") / 50000)
    batch = glm.GlmBatch(l, [glm.ModelSpec("one", "returned", ("score", "tax", "price"))], "w")
    out = glm.estimates(batch.fit_frame()).select("n", "b", "se")
    batch.close()
    return rounded(out)


@check(f"""WITH {L}, e AS (SELECT flag, line, avg(price) AS b, stddev_samp(price) / sqrt(count(*)) AS se FROM l GROUP BY 1, 2),
p AS (SELECT flag, count(*) AS m, avg(b) AS bb, avg(se * se) AS w, var_samp(b) AS bv FROM e GROUP BY 1)
SELECT flag, m, round(bb, 4) AS beta_bar, round(w, 4) AS "W", round(bv, 4) AS "B", round(w + (1 + 1.0 / m) * bv, 4) AS "T", round(sqrt(w + (1 + 1.0 / m) * bv), 4) AS se_bar FROM p""")
def pooled_estimates(spark, sf):
    e = lines(spark, sf).groupBy("flag", "line").agg(F.avg("price").alias("b"), (F.stddev_samp("price") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"))
    return rounded(effects.rubin_pool(e, ["flag"]), 4)


@check(f"""WITH {L}, e AS (SELECT flag, line, avg(price) - 53000 AS b, stddev_samp(price) / sqrt(count(*)) AS se FROM l GROUP BY 1, 2),
p AS (SELECT flag, avg(b) AS bb, sqrt(avg(se * se) + (1 + 1.0 / count(*)) * var_samp(b)) AS s FROM e GROUP BY 1), z AS (SELECT flag, s, bb / s AS z FROM p)
SELECT flag, round(s, 4) AS se_bar, round(z, 6) AS z, round({normal_tail('z')}, 8) AS p FROM z""")
def wald_p_values(spark, sf):
    e = lines(spark, sf).groupBy("flag", "line").agg((F.avg("price") - 53000).alias("b"), (F.stddev_samp("price") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("se"))
    out = effects.rubin_pool(e, ["flag"]).withColumn("p", effects.wald_p("beta_bar", "se_bar"))
    return out.select("flag", F.round("se_bar", 4).alias("se_bar"), F.round(F.col("beta_bar") / F.col("se_bar"), 6).alias("z"), F.round("p", 8).alias("p"))


@check(f"""WITH {L}, m AS (SELECT returned, avg(price) AS a, var_samp(price) AS v, count(*) AS n FROM l GROUP BY 1),
z AS (SELECT (h.a - g.a) / sqrt(h.v / h.n + g.v / g.n) AS z FROM m h, m g WHERE h.returned = 1 AND g.returned = 0),
s AS (SELECT k::BIGINT AS k, z * k / 4.0 AS z FROM z, range(0, 60) t(k)) SELECT k, round({normal_tail('z')}, 8) AS p FROM s""")
def normal_tails(spark, sf):
    """The native normal tail over a range of z values taken from the data."""
    m = lines(spark, sf).groupBy("returned").agg(F.avg("price").alias("a"), F.var_samp("price").alias("v"), F.count(F.lit(1)).alias("n"))
    one = lambda g, c: F.max(F.when(F.col("returned") == g, F.col(c)))
    z = m.agg(((one(1, "a") - one(0, "a")) / F.sqrt(one(1, "v") / one(1, "n") + one(0, "v") / one(0, "n"))).alias("z"))
    rows = z.select("z", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("k"))
    return rows.select(F.col("k").cast("bigint").alias("k"), F.round(tails.normal_p(F.col("z") * F.col("k") / 4.0), 8).alias("p"))


_RD = f"""{fit_sql("SELECT o AS m, CASE o WHEN 'returned' THEN returned ELSE finished END AS y, w, score / 10 AS x1, tax AS x2 FROM l, (SELECT unnest(['returned', 'finished']) AS o)", 2)}, {se_of(1, 2)},
mu AS (SELECT m, sw, x1, x2, least(exp(b0 + b1 * x1 + b2 * x2), 1) AS m0, least(exp(b0 + b1 * (x1 + 1) + b2 * x2), 1) AS m1 FROM pat JOIN fit USING (m)),
gr AS (SELECT m, sum(sw * (m1 - m0)) / sum(sw) AS h0, sum(sw * (m1 * (x1 + 1) - m0 * x1)) / sum(sw) AS h1, sum(sw * (m1 - m0) * x2) / sum(sw) AS h2 FROM mu GROUP BY 1),
gi AS (SELECT * FROM gr JOIN info USING (m)), {variance("rv", 3, "h", "gi", "rvar")}"""


@check(f"""WITH {L}, {_RD} SELECT m AS outcome, round(h0 * 100, 6) AS "aRD", round((h0 - 1.96 * sqrt(rvar)) * 100, 6) AS "aRD_LCL", round((h0 + 1.96 * sqrt(rvar)) * 100, 6) AS "aRD_UCL" FROM gr JOIN rv USING (m)""")
def risk_difference(spark, sf):
    """g-computation for exposure + 1 with delta-method interval, in percentage points."""
    l = lines(spark, sf).withColumn("score", F.col("score") / 10)
    batch = glm.GlmBatch(l, [glm.ModelSpec(o, o, ("score", "tax")) for o in ("returned", "finished")], "w")
    out = effects.percent_difference(effects.rubin_pool(batch.risk_difference(1.0), ["outcome"]))
    batch.close()
    return rounded(out)


_SWEEP = f"""s AS (SELECT m AS outcome, b1, var, exp(b1) AS rr, exp(b1 - 1.96 * sqrt(var)) AS lo, exp(b1 + 1.96 * sqrt(var)) AS hi, h0, rvar FROM fit JOIN v USING (m) JOIN gr USING (m) JOIN rv USING (m)),
 ev AS (SELECT *, CASE WHEN rr < 1 THEN 1 / rr ELSE rr END AS a, CASE WHEN rr < 1 THEN 1 / hi ELSE lo END AS b, CASE WHEN rr < 1 THEN 1 / lo ELSE hi END AS c FROM s),
 ab AS (SELECT 'returned' AS outcome, count(returned) AS n, sum(returned)::BIGINT AS e, sum(w * returned) / sum(w) AS p FROM l UNION ALL
        SELECT 'finished', count(finished), sum(finished)::BIGINT, sum(w * finished) / sum(w) FILTER (finished IS NOT NULL) FROM l)"""


@check(f"""WITH {L}, {_RD}, {_SWEEP} SELECT ev.outcome, 'ok' AS status, n AS "N_total", e AS "N_events", 1::BIGINT AS m, round(rr, 6) AS "RR", round(lo, 6) AS "LCL", round(hi, 6) AS "UCL", round(b1, 6) AS beta_bar,
 round(sqrt(var), 6) AS se_bar, round(h0 * 100, 6) AS "aRD", round((h0 - 1.96 * sqrt(rvar)) * 100, 6) AS "aRD_LCL", round((h0 + 1.96 * sqrt(rvar)) * 100, 6) AS "aRD_UCL", round(p * 100, 6) AS "AbsoluteRisk_pct",
 round(a + sqrt(a * (a - 1)), 4) AS "E_value_point", round(CASE WHEN b > 1 THEN b + sqrt(b * (b - 1)) ELSE 1 END, 4) AS "E_value_CI_lower", round(CASE WHEN c > 1 THEN c + sqrt(c * (c - 1)) ELSE 1 END, 4) AS "E_value_CI_upper"
FROM ev JOIN ab ON ab.outcome = ev.outcome""")
def outcome_sweep(spark, sf):
    """Primary sweep over outcomes: ratios, risk differences, E-values, prevalence."""
    l = lines(spark, sf).withColumn("score", F.col("score") / 10)
    out = sweeps.outcome_sweep(l, l, ["returned", "finished"], "score", ["tax"], "w", 1, None, with_p=False).drop("m_requested", "m_fitted")
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("E_value_point", "E_value_CI_lower", "E_value_CI_upper")}))


@check()
def outcome_sweep_imputed(spark, sf):
    """The same sweep over five imputations of the score, with p-values and both corrections."""
    base = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderkey", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_totalprice") / 100000).alias("price"), (F.col("c_acctbal") / 1000).alias("balance"),
        (F.col("o_orderstatus") == "F").cast("double").alias("closed"), (F.col("o_orderstatus") == "P").cast("double").alias("pending"), ((F.col("c_nationkey") + 5) / F.lit(20.0)).alias("w"),
    )
    stack = impute.mice(base, ["o_orderkey"], ["price", "balance"])
    return sweeps.outcome_sweep(stack, base, ["closed", "pending"], "price", ["balance"], "w", 5)


@check(f"""WITH {L}, {_RD}, {_SWEEP}, cc AS (SELECT 'returned' AS outcome, count(returned) AS k, sum(returned)::BIGINT AS ke, sum(w * returned) / sum(w) AS kp FROM l WHERE score IS NOT NULL UNION ALL
  SELECT 'finished', count(finished), sum(finished)::BIGINT, sum(w * finished) / sum(w) FILTER (finished IS NOT NULL) FROM l WHERE score IS NOT NULL)
SELECT ev.outcome, 'ok' AS status, k AS "N_complete", ke AS "N_events", round(k * 100.0::DOUBLE / (SELECT count(*) FROM l), 6) AS completeness_pct, round(rr, 6) AS "RR", round(lo, 6) AS "LCL", round(hi, 6) AS "UCL",
 round(a + sqrt(a * (a - 1)), 4) AS "E_value_point", round(CASE WHEN b > 1 THEN b + sqrt(b * (b - 1)) ELSE 1 END, 4) AS "E_value_CI_lower", round(CASE WHEN c > 1 THEN c + sqrt(c * (c - 1)) ELSE 1 END, 4) AS "E_value_CI_upper",
 round(kp * 100, 6) AS "AbsoluteRisk_pct" FROM ev JOIN cc ON cc.outcome = ev.outcome""")
def complete_case_sweep(spark, sf):
    l = lines(spark, sf).withColumn("score", F.col("score") / 10)
    out = sweeps.complete_case_sweep(l, ["returned", "finished"], "score", ["tax"], "w", with_p=False)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("E_value_point", "E_value_CI_lower", "E_value_CI_upper")}))


_BINNED = """b AS (SELECT *, CASE WHEN score IS NULL THEN NULL WHEN score <= q[1] THEN 1 WHEN score <= q[2] THEN 2 WHEN score <= q[3] THEN 3 ELSE 4 END AS quartile,
 CASE WHEN score IS NULL THEN NULL WHEN score <= t[1] THEN 1 WHEN score <= t[2] THEN 2 ELSE 3 END AS tertile
 FROM l, (SELECT quantile_cont(score, [0.25, 0.5, 0.75]) AS q, quantile_cont(score, [1.0/3, 2.0/3]) AS t FROM l))"""


def _rest_sql(bin_col, levels, prefix):
    rows = f"SELECT lv AS m, returned AS y, w, CASE WHEN {bin_col} = lv THEN 1.0::DOUBLE ELSE 0.0 END AS x1, tax AS x2 FROM b, (SELECT unnest({levels}) AS lv)"
    return f"""WITH {L}, {_BINNED}, {fit_sql(rows, 2)}, {se_of(1, 2)} SELECT 'returned' AS outcome, '{prefix}' || m || ' vs {prefix}1' AS comparison, 1::BIGINT AS m, {_rr()} FROM fit JOIN v USING (m)"""


def _contrast(spark, sf, q, prefix, reference="rest", null_in_reference=True):
    b = qn.qcut(lines(spark, sf), "score", q, "level")
    return rounded(sweeps.level_contrasts(
        b, ["returned"], "level", list(range(2, q + 1)), ["tax"], "w", 1, None, reference, prefix, null_in_reference, with_p=False
    ).drop("status", "m_requested", "m_fitted"))


@check(_rest_sql("quartile", [2, 3, 4], "Q"))
def quartile_contrasts(spark, sf):
    """Each quartile against all other rows (unbinned rows included)."""
    return _contrast(spark, sf, 4, "Q")


@check(f"""WITH {L} SELECT o AS outcome, 'Q' || q || ' vs Q1' AS comparison, CASE o WHEN 'none' THEN 'no_events' ELSE 'ok' END AS status, 1::BIGINT AS m_requested, CASE o WHEN 'none' THEN 0 ELSE 1 END::BIGINT AS m_fitted,
 CASE o WHEN 'none' THEN NULL ELSE 1 END::BIGINT AS m FROM (SELECT unnest(['returned', 'none']) AS o), (SELECT unnest([2, 3, 4]) AS q) WHERE (SELECT count(*) FROM l) > 0""")
def contrasts_without_events(spark, sf):
    """An outcome that never happens keeps its rows, with their status."""
    b = qn.qcut(lines(spark, sf), "score", 4, "level").withColumn("none", F.lit(0.0))
    out = sweeps.level_contrasts(b, ["returned", "none"], "level", [2, 3, 4], ["tax"], "w", 1, None, with_p=False)
    return rounded(out.select("outcome", "comparison", "status", "m_requested", "m_fitted", "m"))


@check(_rest_sql("tertile", [2, 3], "T"))
def tertile_contrasts(spark, sf):
    return _contrast(spark, sf, 3, "T")


_FIRST_ROWS = "SELECT 1 AS m, returned AS y, w, CASE quartile WHEN 2 THEN 1.0::DOUBLE ELSE 0.0 END AS x1, CASE quartile WHEN 3 THEN 1.0::DOUBLE ELSE 0.0 END AS x2, CASE quartile WHEN 4 THEN 1.0::DOUBLE ELSE 0.0 END AS x3, tax AS x4 FROM b WHERE quartile IS NOT NULL"


@check(f"""WITH {L}, {_BINNED}, {fit_sql(_FIRST_ROWS, 4, 7)}, {se_of(1, 4, "v1")}, {se_of(2, 4, "v2")}, {se_of(3, 4, "v3")}
SELECT 'returned' AS outcome, t.comparison, 1::BIGINT AS m, {_rr("t.b", "sqrt(t.var)")} FROM fit JOIN v1 USING (m) JOIN v2 USING (m) JOIN v3 USING (m),
LATERAL (SELECT unnest(['Q2 vs Q1', 'Q3 vs Q1', 'Q4 vs Q1']) AS comparison, unnest([fit.b1, fit.b2, fit.b3]) AS b, unnest([v1.var, v2.var, v3.var]) AS var) t""")
def quartiles_against_first(spark, sf):
    """One joint model: each quartile against the first; unbinned rows leave the model."""
    return _contrast(spark, sf, 4, "Q", "first", False)


@check(f"""WITH {L}, g AS (SELECT bulk, high_tax, sum(w * returned) / sum(w) AS p, sum(w) AS sw, sum(w * w * returned) AS w2y, sum(w * w) AS w2 FROM l GROUP BY 1, 2),
v AS (SELECT *, ln(p) AS lp, (w2y - 2 * p * w2y + p * p * w2) / (p * sw) ** 2 AS v FROM g),
c AS (SELECT sum(lp) FILTER (bulk = 1 AND high_tax = 1) - sum(lp) FILTER (bulk = 1 AND high_tax = 0) - sum(lp) FILTER (bulk = 0 AND high_tax = 1) + sum(lp) FILTER (bulk = 0 AND high_tax = 0) AS b, sum(v) AS var,
 sum(lp) FILTER (bulk = 1 AND high_tax = 0) - sum(lp) FILTER (bulk = 0 AND high_tax = 0) AS mb, sum(v) FILTER (high_tax = 0) AS mvar FROM v)
SELECT 'high_tax' AS modifier, 'interaction' AS part, 1::BIGINT AS m, round(b, 6) AS beta_bar, round(sqrt(var), 6) AS se_bar FROM c UNION ALL SELECT 'high_tax', 'main_effect', 1, round(mb, 6), round(sqrt(mvar), 6) FROM c""")
def interaction(spark, sf):
    """Saturated binary by binary model: the product term is a log ratio of ratios."""
    return rounded(sweeps.interaction_test(lines(spark, sf), "returned", "bulk", "high_tax", ["high_tax"], "w", 1, None).select("modifier", "part", "m", "beta_bar", "se_bar"))


_PRODUCT_ROWS = "SELECT 1 AS m, returned AS y, w, tax * 10 AS x1, score / 10 AS x2, tax * score AS x3, line AS x4 FROM l"
_HALF_ROWS = "SELECT CASE WHEN score >= 25 THEN 1 ELSE 0 END AS m, returned AS y, w, tax * 10 AS x1, line AS x2 FROM l"


@check(f"""SELECT * FROM (WITH {L}, {fit_sql(_PRODUCT_ROWS, 4, 10)}, {se_of(1, 4, "v1")}, {se_of(3, 4, "v3")},
 e AS (SELECT 'main_effect' AS part, b1 AS b, sqrt(v1.var) AS s FROM fit JOIN v1 USING (m) UNION ALL SELECT 'interaction', b3, sqrt(v3.var) FROM fit JOIN v3 USING (m)),
 z AS (SELECT part, b, s, b / s AS z, part = 'main_effect' AS main FROM e), t AS (SELECT *, {normal_tail('z')} AS p FROM z)
 SELECT 'score' AS modifier, part, NULL::VARCHAR AS stratum, round(b, 6) AS beta_bar, round(s, 6) AS se_bar, CASE WHEN main THEN round(exp(b), 6) END AS "RR", CASE WHEN main THEN round(exp(b - 1.96 * s), 6) END AS "LCL",
  CASE WHEN main THEN round(exp(b + 1.96 * s), 6) END AS "UCL", round(p, 6) AS p, CASE WHEN NOT main THEN p < 0.05 END AS significant, NULL::BIGINT AS n, 'ok' AS status FROM t)
UNION ALL SELECT * FROM (WITH {L}, {fit_sql(_HALF_ROWS, 2, 10)}, {se_of(1, 2)}, c AS (SELECT CASE WHEN score >= 25 THEN 1 ELSE 0 END AS m, count(*) AS n FROM l GROUP BY 1),
 z AS (SELECT m, n, b1 AS b, sqrt(var) AS s, b1 / sqrt(var) AS z FROM fit JOIN v USING (m) JOIN c USING (m)), t AS (SELECT *, {normal_tail('z')} AS p FROM z)
 SELECT 'score', 'stratified', 'score=' || m, NULL::DOUBLE, NULL::DOUBLE, round(exp(b), 6), round(exp(b - 1.96 * s), 6), round(exp(b + 1.96 * s), 6), round(p, 6), NULL::BOOLEAN, n, 'ok' FROM t)""")
def effect_modification(spark, sf):
    """Interaction, main effect and both strata of a continuous modifier cut at 25 (2.5 tens)."""
    l = lines(spark, sf).withColumn("tax", F.col("tax") * 10).withColumn("score", F.col("score") / 10)
    out = sweeps.effect_modification(l, "returned", "tax", "score", ["score", "line"], "w", 1, None, cut_at=2.5)
    return rounded(out)


@check(f"""WITH {L}, {fit_sql("SELECT high_tax AS m, returned AS y, w, score / 10 AS x1, line AS x2 FROM l", 2)}, {se_of(1, 2)},
c AS (SELECT high_tax AS m, count(*) AS n, sum(returned) AS e, sum(w * returned) / sum(w) AS p FROM l GROUP BY 1)
SELECT 'Tax' AS category, CASE m WHEN 0 THEN 'low tax' ELSE 'high tax' END AS stratum, m::BIGINT AS position, n AS rows_first, n AS n_sum, n::DOUBLE AS n_mean, floor(e)::BIGINT AS events, round(p * 100, 6) AS absolute_risk_pct, {_rr()} FROM fit JOIN v USING (m) JOIN c USING (m)""")
def stratified_ratios(spark, sf):
    l = lines(spark, sf).withColumn("score", F.col("score") / 10)
    return rounded(sweeps.stratified_rr(
        l, "returned", "score", [("Tax", "high_tax", [(0, "low tax"), (1, "high tax")])], ["line", "high_tax"], "w", 1, None, with_p=False
    ).drop("status", "m_requested", "m_fitted"))


@check(f"""WITH {L}, s AS (SELECT unnest([1, 2, 99]) AS line, unnest(['one', 'two', 'absent']) AS stratum),
c AS (SELECT line, count(*) AS n FROM l GROUP BY 1) SELECT s.stratum, coalesce(n, 0)::BIGINT AS rows_first, CASE WHEN coalesce(n, 0) > g THEN 'ok' ELSE 'below_gate' END AS status,
 CASE WHEN coalesce(n, 0) > g THEN 1 ELSE 0 END::BIGINT AS m_fitted FROM s LEFT JOIN c ON c.line = s.line, (SELECT n AS g FROM c WHERE line = 2)""")
def strata_below_gate(spark, sf):
    """Strata at or under the size gate keep their rows, with their status."""
    l = lines(spark, sf)
    gate = l.filter("line = 2").count()
    out = sweeps.stratified_rr(l, "returned", "tax", [("Line", "line", [(1, "one"), (2, "two"), (99, "absent")])], ["high_tax"], "w", 1, None, gate, with_p=False)
    return rounded(out.select("stratum", "rows_first", "status", "m_fitted"))


_U = "((least(greatest(score, 1), 50) - 1) / 49.0::DOUBLE)"


@check(f"""WITH {L}, k AS (SELECT score, {_U} AS u FROM l WHERE score IS NOT NULL)
SELECT score, count(*) AS n, round(min(3 * u * (1 - u) ** 2), 6) AS bs1, round(min(3 * u * u * (1 - u)), 6) AS bs2, round(min(u ** 3), 6) AS bs3 FROM k GROUP BY 1""")
def spline_basis(spark, sf):
    wide, names, _ = spline.spline_terms(lines(spark, sf).filter(F.col("score").isNotNull()), "score", 1, 50)
    return rounded(wide.groupBy("score").agg(F.count(F.lit(1)).alias("n"), *[F.min(n).alias(n) for n in names]))


_GRID = "3 * u * (1 - u) ** 2 - 3 * r * (1 - r) ** 2 AS h1, 3 * u * u * (1 - u) - 3 * r * r * (1 - r) AS h2, u ** 3 - r ** 3 AS h3"


@check(f"""WITH {L}, {fit_sql(f"SELECT 1 AS m, returned AS y, w, 3 * u * (1 - u) ** 2 AS x1, 3 * u * u * (1 - u) AS x2, u ** 3 AS x3, tax AS x4 FROM (SELECT *, {_U} AS u FROM l WHERE score IS NOT NULL)", 4, 7)},
gx AS (SELECT x::DOUBLE AS m, 0.0::DOUBLE AS h0, {_GRID}, 0.0::DOUBLE AS h4 FROM (SELECT x, (x - 1) / 49.0::DOUBLE AS u, 24 / 49.0::DOUBLE AS r FROM (SELECT unnest(range(1, 51)) AS x))),
gi AS (SELECT gx.*, info.* EXCLUDE (m) FROM gx, info), sm AS (SELECT * FROM meat), {variance("rv", 5, "h", "gi", "rvar").replace("JOIN meat USING (m)", "CROSS JOIN (SELECT * EXCLUDE (m) FROM sm) q")}
SELECT gx.m AS x, round(exp(b1 * h1 + b2 * h2 + b3 * h3), 6) AS "RR", round(exp(b1 * h1 + b2 * h2 + b3 * h3 - 1.96 * sqrt(greatest(rvar, 0))), 6) AS "LCL", round(exp(b1 * h1 + b2 * h2 + b3 * h3 + 1.96 * sqrt(greatest(rvar, 0))), 6) AS "UCL",
 'ok' AS status FROM gx JOIN rv USING (m), (SELECT * EXCLUDE (m) FROM fit) f""")
def spline_curve(spark, sf):
    """Cubic dose-response against 25 on the unit grid, with one covariate."""
    return rounded(spline.spline_rr(lines(spark, sf), "returned", "score", "w", ["tax"], 1, 50, 25))


@check()
def spline_with_knots(spark, sf):
    """Five degrees of freedom: two interior knots at score terciles."""
    return spline.spline_rr(lines(spark, sf), "returned", "score", "w", ["tax"], 1, 50, 25, df_spline=5)


@check(f"""WITH {L}, {_BINNED}, k AS (SELECT * FROM b WHERE score IS NOT NULL) SELECT quartile::BIGINT AS bin, round(avg(score), 6) AS mean_x, round(avg(returned), 6) AS mean_y, count(*) AS n FROM k GROUP BY 1""")
def quantile_means(spark, sf):
    return rounded(spline.quantile_means(lines(spark, sf), "returned", "score"))


