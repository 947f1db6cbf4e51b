"""Shared bindings: the driver tables read as coded survey-like tables.

The tables hold no missing values, so missing answers are declared by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE_COLUMNS = {
    "score": "CASE WHEN l_discount = 0.07 THEN NULL ELSE l_quantity END",
    "qty": "l_quantity",
    "w": "0.5 + l_discount",
    "returned": "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE)",
    "finished": "CAST(CASE WHEN l_returnflag = 'A' AND l_tax = 0.05 THEN NULL WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE)",
    "high_tax": "CAST(CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END AS DOUBLE)",
    "bulk": "CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS DOUBLE)",
    "tax": "l_tax",
    "line": "CAST(l_linenumber AS DOUBLE)",
    "price": "l_extendedprice",
    "flag": "l_returnflag",
    "supplier": "l_suppkey",
}
LINES_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in LINE_COLUMNS.items()) + " FROM lineitem"


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in LINE_COLUMNS.items()])


def spread_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows for models: a small file is one scan task, so they are dealt out before many passes read them."""
    return lines(spark, sf).repartition(spark.sparkContext.defaultParallelism)


def wave(spark: SparkSession, sf: str, year: int, *aggs) -> DataFrame:
    day = lambda y: F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz")  # a range, so that it reaches the scan
    date = F.col("o_orderdate").cast("timestamp_ntz")
    o = table(spark, sf, "orders").filter((date >= day(year)) & (date < day(year + 1)))
    return o.groupBy(F.col("o_custkey").alias("custkey")).agg(*aggs)


def baseline_wave(spark: SparkSession, sf: str) -> DataFrame:
    return wave(
        spark, sf, 1995, F.count(F.lit(1)).cast("double").alias("n_base"), F.avg("o_totalprice").alias("price_base"),
        F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent_base"),
    )


def exposure_wave(spark: SparkSession, sf: str) -> DataFrame:
    return wave(spark, sf, 1998, F.avg("o_totalprice").alias("score"), F.count(F.lit(1)).cast("double").alias("n_mid"))


def outcome_wave(spark: SparkSession, sf: str) -> DataFrame:
    return wave(
        spark, sf, 2001, F.max((F.col("o_orderpriority") == "1-URGENT").cast("double")).alias("urgent"),
        F.max((F.col("o_orderstatus") == "P").cast("double")).alias("pending"),
    )


WAVES_SQL = """
wave1 AS (SELECT o_custkey AS custkey, CAST(count(*) AS DOUBLE) AS n_base, avg(o_totalprice) AS price_base,
                 max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0 END) AS urgent_base
          FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
wave2 AS (SELECT o_custkey AS custkey, avg(o_totalprice) AS score, CAST(count(*) AS DOUBLE) AS n_mid
          FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1),
wave3 AS (SELECT o_custkey AS custkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0 END) AS urgent,
                 max(CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE ELSE 0.0 END) AS pending
          FROM orders WHERE year(o_orderdate) = 2001 GROUP BY 1),
panel AS (SELECT * FROM wave1 JOIN wave2 USING (custkey) JOIN wave3 USING (custkey))"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    from panelwright.operators.panel import panel_join

    return panel_join([baseline_wave(spark, sf), exposure_wave(spark, sf), outcome_wave(spark, sf)], ["custkey"])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to ``digits`` places, integers to bigint: comparable in any engine."""
    kinds = dict(df.dtypes)
    pick = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "float": lambda c: F.round(c.cast("double"), digits), "int": lambda c: c.cast("bigint")}
    return df.select(*[pick.get(kinds[c], lambda x: x)(F.col(f"`{c}`")).alias(c) for c in df.columns])
