"""Sources, recodes, joins, filters and set operations."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from checks.tables import (
    LINES_SQL, WAVES_SQL, baseline_wave, exposure_wave, lines, outcome_wave, panel, rounded, table,
)
from panelwright.functions import codes as c, formats as f
from panelwright.operators import charts, panel as pn, quantiles as qn
from panelwright.session import ensure_checkpoint_dir
from panelwright.sources.columns import numeric, observed, resolve
from panelwright.sources.sinks import commit_result, read_result, write_snapshot
from panelwright.sources.text import read_csv_any_encoding

CHECKS: dict = {}


def check(sql: str | None = None):
    def add(fn):
        CHECKS[fn.__name__] = (fn, sql)
        return fn

    return add


@check("""SELECT c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, min(c_custkey) AS first_key,
       'utf-8' AS encoding FROM customer GROUP BY 1""")
def csv_scan(spark, sf):
    """Write the customers as CSV, detect the encoding over the whole file, read back as text."""
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    write_snapshot(table(spark, sf, "customer"), path, "csv")
    df, encoding = read_csv_any_encoding(spark, path)
    return df.groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(numeric(df, "C_ACCTBAL", "c_acctbal")), 2).alias("balance"),
        F.min(c.to_num("c_custkey")).cast("bigint").alias("first_key"), F.lit(encoding).alias("encoding"),
    )


@check("""SELECT e.asked, e.found, c_mktsegment AS segment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, sum(length(c_name || chr(10) || '健康'))::BIGINT AS note_chars
FROM customer, (SELECT unnest(['UTF-8', 'windows-31j', 'Shift_JIS']) AS asked, unnest(['utf-8', 'cp932', 'cp932']) AS found) e GROUP BY ALL""")
def csv_encodings(spark, sf):
    """The customers as CSV in three charsets, with line breaks inside quoted fields, read back as found."""
    rows = table(spark, sf, "customer").select("c_mktsegment", "c_acctbal", F.concat("c_name", F.lit("\n健康")).alias("note"))
    out = []
    for asked in ("UTF-8", "windows-31j", "Shift_JIS"):
        path, setting = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}", "spark.sql.legacy.javaCharsets"
        before = spark.conf.get(setting)
        spark.conf.set(setting, "true")  # to write the legacy charsets; reading them needs no setting
        try:
            rows.write.option("header", True).option("encoding", asked).option("escape", '"').csv(path)
        finally:
            spark.conf.set(setting, before)
        df, found = read_csv_any_encoding(spark, path)
        out.append(df.groupBy(F.lit(asked).alias("asked"), F.lit(found).alias("found"), F.col("c_mktsegment").alias("segment")).agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum(numeric(df, "c_acctbal")), 2).alias("balance"), F.sum(F.length("note")).alias("note_chars")))
    return reduce(lambda a, b: a.unionByName(b), out)


@check("""
WITH t AS (SELECT p_partkey, p_size, p_brand, p_name, substr(p_brand, 7) AS a, ' ' || p_size || ' ' AS b, p_size || 'd' AS d,
                  p_size || '.5e1' AS e, '-.' || p_size AS f, '' AS g FROM part),
n AS (SELECT p_partkey, unnest([a, b, d, e, f, g, p_name]) AS v, unnest(['a', 'b', 'd', 'e', 'f', 'g', 'name']) AS k FROM t)
SELECT k, count(*) AS n_rows, count(x) AS n_numbers, round(sum(x), 4) AS total
FROM (SELECT k, CASE WHEN regexp_matches(v, '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') THEN TRY_CAST(trim(v) AS DOUBLE) END AS x FROM n)
GROUP BY k""")
def numeric_coercion(spark, sf):
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    texts = {
        "a": F.expr("substr(p_brand, 7)"), "b": F.concat(F.lit(" "), size, F.lit(" ")), "d": F.concat(size, F.lit("d")),
        "e": F.concat(size, F.lit(".5e1")), "f": F.concat(F.lit("-."), size), "g": F.lit(""), "name": F.col("p_name"),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), c.to_num(v).alias("x")) for k, v in texts.items()])
    return p.select(F.explode(pairs).alias("s")).groupBy("s.k").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("s.x").alias("n_numbers"), F.round(F.sum("s.x"), 4).alias("total")
    )


@check("""SELECT o_orderkey,
  CASE WHEN o_orderstatus IN ('F') THEN 1.0::DOUBLE WHEN o_orderstatus IN ('O') THEN 0.0 END AS two_value,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0::DOUBLE WHEN o_orderpriority IS NOT NULL THEN 0.0 END AS membership,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1.0::DOUBLE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 0.0 END AS two_sets,
  CASE WHEN o_totalprice >= 150000 THEN 1.0::DOUBLE ELSE 0.0 END AS threshold,
  CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0 END AS indicator
FROM orders""")
def recode_orders(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", c.recode("o_orderstatus", ["F"], ["O"]).alias("two_value"),
        c.recode("o_orderpriority", ["1-URGENT", "2-HIGH"], "other_non_null").alias("membership"),
        c.recode("o_orderpriority", ["1-URGENT", "2-HIGH"], ["4-NOT SPECIFIED", "5-LOW"]).alias("two_sets"),
        c.threshold("o_totalprice", ">=", 150000).alias("threshold"), c.bin_indicator("o_orderstatus", "P").alias("indicator"),
    )


@check(f"""WITH l AS ({LINES_SQL}),
r AS (SELECT flag, CASE WHEN score IS NULL OR finished IS NULL THEN NULL WHEN score >= 20 AND finished = 1 THEN 1.0::DOUBLE ELSE 0.0 END AS heavy FROM l)
SELECT flag, heavy, count(*) AS n FROM r GROUP BY 1, 2""")
def strict_conjunction(spark, sf):
    r = lines(spark, sf).select(
        "flag", c.all_of_strict([F.col("score") >= 20, F.col("finished") == 1], ["score", "finished"]).alias("heavy")
    )
    return r.groupBy("flag", "heavy").agg(F.count(F.lit(1)).alias("n"))


@check(f"""WITH l AS ({LINES_SQL}),
r AS (SELECT line, flag, CASE WHEN h = 0 AND price > 0 THEN 60.0::DOUBLE WHEN h IS NULL THEN NULL
                        ELSE least(greatest(price / 10 / ((h / 100) * (h / 100)), 10), 60) END AS ratio
      FROM (SELECT *, CASE WHEN score = 1 THEN 0 ELSE score * 40 END AS h FROM l))
SELECT flag, line, count(*) AS n, count(ratio) AS n_ratio, round(avg(ratio), 6) AS mean_ratio, min(ratio) AS lo, max(ratio) AS hi FROM r GROUP BY 1, 2""")
def clipped_ratio(spark, sf):
    h = F.when(F.col("score") == 1, F.lit(0.0)).otherwise(F.col("score") * 40)
    r = lines(spark, sf).select("flag", "line", c.body_mass_index(h, F.col("price") / 10).alias("ratio"))
    return r.groupBy("flag", "line").agg(
        F.count(F.lit(1)).alias("n"), F.count("ratio").alias("n_ratio"), F.round(F.avg("ratio"), 6).alias("mean_ratio"),
        F.min("ratio").alias("lo"), F.max("ratio").alias("hi"),
    )


ITEMS_SQL = "SELECT l_orderkey AS orderkey, " + ", ".join(
    f"max(CASE WHEN l_linenumber = {i} THEN ceil(l_quantity / 12.5) END) AS i{i}" for i in range(1, 8)
) + " FROM lineitem GROUP BY 1"
_SUM = " + ".join(f"coalesce({'5 - ' if i in (5, 6) else ''}i{i}, 0)" for i in range(1, 8))
_ANSWERED = " + ".join(f"(i{i} IS NOT NULL)::INT" for i in range(1, 8))


def items(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        *[F.max(F.when(F.col("l_linenumber") == i, F.ceil(F.col("l_quantity") / 12.5).cast("double"))).alias(f"i{i}") for i in range(1, 8)]
    )


@check(f"""WITH t AS ({ITEMS_SQL}) SELECT orderkey, CASE WHEN {_ANSWERED} >= 3 THEN CAST({_SUM} AS DOUBLE) END AS total FROM t""")
def reversed_row_sum(spark, sf):
    """Item score per order: line quantities as 1-4 answers, items 5-6 reversed, at least 3 answered."""
    cols = [c.reverse_code(f"i{i}", 5) if i in (5, 6) else F.col(f"i{i}") for i in range(1, 8)]
    return items(spark, sf).select("orderkey", c.row_sum(cols, 3).alias("total"))


_FLAGS = [(r, s) for r in "ANR" for s in "FO"]
FLAGS_SQL = "SELECT l_orderkey AS orderkey, " + ", ".join(
    f"max(CASE WHEN l_returnflag = '{r}' AND l_linestatus = '{s}' THEN 1 ELSE 0 END) AS {r}{s}" for r, s in _FLAGS
) + " FROM lineitem GROUP BY 1"


@check(f"""WITH t AS ({FLAGS_SQL}),
r AS (SELECT orderkey, CASE WHEN AF + AO + NF = 0 OR NO + RF + RO = 0 THEN NULL WHEN RF + RO > 0 THEN 1.0::DOUBLE WHEN AF + AO + NF + NO > 0 THEN 0.0 END AS status FROM t)
SELECT status, count(*) AS n, sum(orderkey)::BIGINT AS keys FROM r GROUP BY 1""")
def multiselect_status(spark, sf):
    li = table(spark, sf, "lineitem")
    t = li.groupBy(F.col("l_orderkey").alias("orderkey")).agg(
        *[F.max(((F.col("l_returnflag") == r) & (F.col("l_linestatus") == s)).cast("int")).alias(r + s) for r, s in _FLAGS]
    )
    status = c.multiselect_status(["RF", "RO"], ["AF", "AO", "NF", "NO"], [["AF", "AO", "NF"], ["NO", "RF", "RO"]])
    return t.select("orderkey", status.alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("orderkey").alias("keys")
    )


@check(f"""WITH l AS ({LINES_SQL}),
r AS (SELECT CASE WHEN score > 0 AND score <= 25 THEN 0 WHEN score > 25 AND score <= 45 THEN 1 END AS age_bin,
             CASE WHEN score >= 25 THEN 1.0::DOUBLE WHEN score IS NOT NULL THEN 0.0 END AS old, score * tax AS product FROM l)
SELECT age_bin::BIGINT AS age_bin, old, count(*) AS n, round(sum(product), 6) AS total FROM r GROUP BY 1, 2""")
def fixed_bins(spark, sf):
    r = lines(spark, sf).select(
        c.cut("score", [0, 25, 45]).cast("bigint").alias("age_bin"), c.at_least("score", 25, null_as_low=False).alias("old"),
        c.product("score", "tax").alias("product"),
    )
    return r.groupBy("age_bin", "old").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("product"), 6).alias("total"))


@check("""SELECT c_mktsegment AS segment, printf('%.2f-%.2f', lo, hi) AS ci, printf('%.1f (%.1f-%.1f)', a, lo, hi) AS risk,
  format('{:,}', n) || printf(' (%.1f)', pct) AS count_pct, printf('%.1f ± %.1f', a, sd) AS mean_sd, printf('%.1f%%', pct) AS pct,
  CASE WHEN p < 0.001 THEN '<0.001' ELSE printf('%.3f', p) END AS p, printf('(n=%s)', format('{:,}', n)) AS n
FROM (SELECT c_mktsegment, avg(c_acctbal) AS a, stddev_samp(c_acctbal) AS sd, avg(c_acctbal) - stddev_samp(c_acctbal) / sqrt(count(*)) AS lo,
             avg(c_acctbal) + stddev_samp(c_acctbal) / sqrt(count(*)) AS hi, count(*) AS n,
             avg(CASE WHEN c_acctbal < 0 THEN 100.0::DOUBLE ELSE 0 END) AS pct, exp(-avg(c_acctbal) / 1000) AS p FROM customer GROUP BY 1)""")
def display_strings(spark, sf):
    a, sd = F.avg("c_acctbal"), F.stddev_samp("c_acctbal")
    half = sd / F.sqrt(F.count(F.lit(1)).cast("double"))
    g = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        a.alias("a"), sd.alias("sd"), (a - half).alias("lo"), (a + half).alias("hi"), F.count(F.lit(1)).alias("k"),
        F.avg(F.when(F.col("c_acctbal") < 0, 100.0).otherwise(0.0)).alias("q"), F.exp(-a / 1000).alias("pv"),
    )
    return g.select(
        "segment", f.fmt_ci("lo", "hi").alias("ci"), f.fmt_risk("a", "lo", "hi").alias("risk"), f.fmt_count_pct("k", "q").alias("count_pct"),
        f.fmt_mean_sd("a", "sd").alias("mean_sd"), f.fmt_pct("q").alias("pct"), f.fmt_p("pv").alias("p"), f.fmt_n("k").alias("n"),
    )


_SUFFIX = "CASE WHEN p_size <= 10 THEN '_22' WHEN p_size <= 25 THEN '_23' ELSE '' END"


@check(f"""WITH v AS (SELECT DISTINCT p_type || {_SUFFIX} AS var FROM part), b AS (SELECT p_type || '_23' AS name, max(p_brand) AS label FROM part WHERE p_size = 11 GROUP BY 1)
SELECT var, coalesce(label, regexp_replace(var, '_2[23]$', '')) AS label,
       CASE WHEN var IN ('ECONOMY_22', 'SMALL_22') THEN 1 WHEN contains(var, '_23') THEN 2 ELSE 0 END::BIGINT AS tier
FROM v LEFT JOIN b ON var = name""")
def labels_and_tiers(spark, sf):
    p = table(spark, sf, "part")
    v = p.select(F.concat("p_type", F.expr(_SUFFIX)).alias("var")).distinct()
    book = p.filter(F.col("p_size") == 11).groupBy(F.concat("p_type", F.lit("_23")).alias("name")).agg(F.max("p_brand").alias("label"))
    return charts.with_label(v, "var", book).withColumn("tier", c.tier("var", ["ECONOMY_22", "SMALL_22"]).cast("bigint"))


_BACK_SQL = """SELECT o_orderpriority AS priority, count(*) AS n, round(avg(o_totalprice), 4) AS price, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'a "quoted", ' || chr(10) || 'broken note' END AS note,
 min(o_orderdate)::DATE AS first_day FROM orders GROUP BY 1"""


@check(f"""WITH r AS ({_BACK_SQL}), w AS (SELECT unnest(['csv', 'parquet', 'csv', 'parquet']) AS format, unnest([false, false, true, true]) AS none)
SELECT w.format, w.none, 'priority n price note first_day' AS columns, r.priority, r.n, r.price, r.note, r.first_day FROM w LEFT JOIN r ON NOT w.none""")
def result_round_trip(spark, sf):
    """Results committed as one file and read back, one of them empty, with equal columns and types."""
    first = F.col("o_orderpriority") == "1-URGENT"
    rows = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"),
        F.first(F.when(~first, F.lit('a "quoted", \nbroken note'))).alias("note"), F.min("o_orderdate").cast("date").alias("first_day"))
    base, out = f"{ensure_checkpoint_dir(spark)}/results-{uuid.uuid4().hex}", []
    for fmt in ("csv", "parquet"):
        for none, df in ((False, rows), (True, rows.filter("n < 0"))):
            commit_result(df, f"{base}/{none}.{fmt}", fmt)
            back = read_result(spark, f"{base}/{none}.{fmt}")
            told = spark.createDataFrame([(fmt, none, " ".join(back.columns))], "format string, none boolean, columns string")
            out.append(told.join(back, F.lit(True), "left"))  # one row beside a result table
    return rounded(reduce(lambda a, b: a.unionByName(b), out), 4)


@check("""WITH k AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END AS custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price FROM orders)
SELECT 'orders' AS frame, count(*) AS n, count(*) - count(custkey) AS null_keys, count(*) - count(price) AS missing_price, count(*) AS missing_absent, count(custkey) > 1.5 * count(DISTINCT custkey) AS repeated FROM k
UNION ALL SELECT 'customer', count(*), 0, count(*) - count(c_acctbal), count(*), false FROM customer""")
def contract_counts(spark, sf):
    """Violations of key and columns, counted by the job that writes each frame."""
    orders = table(spark, sf, "orders").select(
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("custkey"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("price"))
    told = []
    for name, df in (("orders", orders), ("customer", customer)):
        contract = observed(df, ["custkey"], ["price", "absent"])
        write_snapshot(contract.df, f"{ensure_checkpoint_dir(spark)}/panel-{uuid.uuid4().hex}")
        v = contract.violations()
        told.append((name, v["rows"], v["null_keys"], v["missing_price"], v["missing_absent"], v["repeated_keys"] > 0.3 * v["rows"]))
    return spark.createDataFrame(told, "frame string, n long, null_keys long, missing_price long, missing_absent long, repeated boolean")


_HEAVY_SQL = """a AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey END AS k, c_mktsegment AS segment, c_acctbal AS balance FROM customer),
b AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS k, o_orderstatus AS status, o_totalprice AS price FROM orders)"""


def _heavy_waves(spark, sf):
    """Two waves with one key in a third of the rows of both."""
    third = lambda c, k: F.when(F.col(c) % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col(k).cast("bigint")).alias("k")
    a = table(spark, sf, "customer").select(third("c_custkey", "c_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return a, table(spark, sf, "orders").select(third("o_orderkey", "o_custkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@check(f"""WITH {_HEAVY_SQL} SELECT segment, status, count(*) AS n, count(DISTINCT a.k) AS n_keys, round(avg(price), 4) AS price, round(avg(balance), 4) AS balance
FROM a JOIN b ON a.k = b.k GROUP BY ALL""")
def heavy_key_join(spark, sf):
    """The join of two waves that share one heavy key."""
    a, b = _heavy_waves(spark, sf)
    return pn.skewed_join(a, b, ["k"], cell_rows=100_000).groupBy("segment", "status").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("n_keys"), F.round(F.avg("price"), 4).alias("price"), F.round(F.avg("balance"), 4).alias("balance"))


@check(f"""WITH {_HEAVY_SQL} SELECT segment, status, count(*) AS n, round(avg(price), 4) AS price FROM a LEFT JOIN b ON a.k = b.k GROUP BY ALL""")
def heavy_key_left_join(spark, sf):
    a, b = _heavy_waves(spark, sf)
    joined = pn.skewed_join(a, b, ["k"], "left", cell_rows=100_000)
    return joined.groupBy("segment", "status").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("price"), 4).alias("price"))


@check(f"""WITH {WAVES_SQL} SELECT custkey, n_base, round(price_base, 6) AS price_base, urgent_base, round(score, 6) AS score, n_mid, urgent, pending FROM panel""")
def panel_join(spark, sf):
    return rounded(panel(spark, sf))


@check(f"""WITH {WAVES_SQL}, w AS (SELECT wave1.custkey, wave1.n_base / 2 + 0.5 AS weight, CASE WHEN p.custkey IS NULL THEN 0 ELSE 1 END AS complete
  FROM wave1 LEFT JOIN panel p ON p.custkey = wave1.custkey)
SELECT p.custkey, round(w.weight, 6) AS weight, p.urgent FROM panel p LEFT JOIN w ON w.custkey = p.custkey WHERE w.complete = 1""")
def followed_with_weight(spark, sf):
    joined = panel(spark, sf)
    w = pn.membership_flag(baseline_wave(spark, sf), joined, ["custkey"], "complete").select(
        "custkey", (F.col("n_base") / 2 + 0.5).alias("weight"), "complete"
    )
    return rounded(pn.followed_up(pn.attach(joined.select("custkey", "urgent"), w, ["custkey"]), "complete").select("custkey", "weight", "urgent"))


@check(f"""WITH {WAVES_SQL} SELECT w.custkey, CASE WHEN p.custkey IS NULL THEN 0 ELSE 1 END::BIGINT AS complete, w.n_base FROM wave1 w LEFT JOIN panel p ON p.custkey = w.custkey""")
def membership_flag(spark, sf):
    return rounded(pn.membership_flag(baseline_wave(spark, sf).select("custkey", "n_base"), panel(spark, sf), ["custkey"], "complete"))


@check(f"""WITH {WAVES_SQL} SELECT 'shared' AS part, count(*) AS n, sum(custkey)::BIGINT AS keys FROM (SELECT custkey FROM wave2 INTERSECT SELECT custkey FROM wave3)
UNION ALL SELECT 'second', count(*), sum(custkey)::BIGINT FROM wave2 WHERE custkey IN (SELECT custkey FROM wave3)
UNION ALL SELECT 'third', count(*), sum(custkey)::BIGINT FROM wave3 WHERE custkey IN (SELECT custkey FROM wave2)""")
def shared_units(spark, sf):
    a, b = exposure_wave(spark, sf), outcome_wave(spark, sf)
    left, right = pn.restrict_to_shared(a, b, ["custkey"])
    parts = {"shared": pn.shared_keys(a, b, ["custkey"]), "second": left.select("custkey"), "third": right.select("custkey")}
    return pn.tag_union(parts, "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("custkey").alias("keys"))


@check(f"""WITH l AS ({LINES_SQL}) SELECT flag, count(*) AS n, round(sum(score), 4) AS total FROM l WHERE score IS NOT NULL AND finished IS NOT NULL GROUP BY 1""")
def complete_cases(spark, sf):
    kept = pn.complete_cases(lines(spark, sf), ["score", "finished"])
    return kept.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("total"))


@check(f"""WITH l AS ({LINES_SQL}), g AS (SELECT flag, line, count(*) AS n FROM l GROUP BY 1, 2)
SELECT g.flag, g.line, g.n, CASE WHEN g.n > (SELECT avg(n) FROM g) THEN 'ok' ELSE 'too_few' END AS status,
       CASE WHEN g.n > (SELECT floor(avg(n)) FROM g) THEN g.n ELSE 0 END AS kept FROM g""")
def size_gate(spark, sf):
    """Groups above the average size pass; every group is reported with its status."""
    l = lines(spark, sf)
    limit = int(l.groupBy("flag", "line").agg(F.count(F.lit(1)).alias("n")).agg(F.floor(F.avg("n"))).first()[0])
    kept, report = pn.gate(l, ["flag", "line"], limit)
    return report.join(kept.groupBy("flag", "line").agg(F.count(F.lit(1)).alias("kept")), ["flag", "line"], "left").select(
        "flag", "line", "n", "status", F.coalesce("kept", F.lit(0)).cast("bigint").alias("kept")
    )


@check(f"""WITH l AS ({LINES_SQL}), s AS (SELECT 'returned' AS outcome, flag, count(*) AS n, sum(returned) AS events FROM l GROUP BY ALL
UNION ALL SELECT 'finished', flag, count(finished), sum(finished) FROM l GROUP BY ALL) SELECT * FROM s""")
def stacked_results(spark, sf):
    l = lines(spark, sf)
    each = {o: l.groupBy("flag").agg(F.count(o).alias("n"), F.sum(o).alias("events")) for o in ("returned", "finished")}
    return pn.tag_union(each, "outcome")


@check("""SELECT i AS mi_id, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_totalprice, unnest([1, 2, 3, 4, 5])::BIGINT AS i FROM orders) GROUP BY 1""")
def replicated_rows(spark, sf):
    return pn.replicate(table(spark, sf, "orders"), 5).groupBy(F.col("mi_id").cast("bigint").alias("mi_id")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


@check("""SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1 HAVING count(*) > 1""")
def repeated_keys(spark, sf):
    from panelwright.sources.columns import unique_key

    o = table(spark, sf, "orders")
    return unique_key(o, [resolve(o, "CUSTKEY", "o_custkey")])
