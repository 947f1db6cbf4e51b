"""Joins on keys that repeat on both sides, against the plain join."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import panel as pn


@pytest.fixture
def waves(spark):
    """Key 0 in a third of both waves, a heavy key on one side only, NULL keys, repeated rows."""
    a = [(0 if i % 3 == 0 else 7 if i % 10 == 1 else None if i % 17 == 0 else i, "x", i % 5) for i in range(900)]
    b = [(0 if i % 3 == 0 else 8 if i % 10 == 1 else None if i % 17 == 0 else i, "x", i) for i in range(1200)]
    names = "k long, `s.t` string, v{} long"
    return spark.createDataFrame(a, names.format(1)), spark.createDataFrame(b, names.format(2))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("cell_rows", [500, 10_000_000])
def test_same_rows_as_the_plain_join(waves, how, cell_rows):
    a, b = waves
    b = b.withColumnRenamed("s.t", "s2")
    got = pn.skewed_join(a, b, ["k"], how, share=0.02, cell_rows=cell_rows)
    assert got.columns == a.join(b, ["k"], how).columns and rows(got) == rows(a.join(b, ["k"], how))


def test_two_part_keys(waves):
    a, b = waves
    got = pn.skewed_join(a, b, ["k", "s.t"], share=0.02, cell_rows=400)
    want = a.withColumnRenamed("s.t", "st").join(b.withColumnRenamed("s.t", "st"), ["k", "st"])
    assert rows(got) == rows(want)


def test_heavy_keys_are_those_with_their_share(waves):
    a, _ = waves
    n = a.filter("k IS NOT NULL").count()
    want = {r["h"] for r in a.filter("k IS NOT NULL").groupBy(F.xxhash64("k").alias("h")).count().filter(F.col("count") >= 0.05 * n).collect()}
    assert set(pn.heavy_keys(a, ["k"], 0.05)) == want and len(want) == 2


def test_no_task_holds_the_heavy_key(spark):
    """A third of both waves under one key: the largest task makes less than a twentieth of the output."""
    a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    b = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("w"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in pn.skewed_join(a, b, ["k"], cell_rows=4000).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plain = [r["count"] for r in a.hint("merge").join(b, "k").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == sum(plain) and max(sizes) <= 0.05 * sum(sizes) and max(plain) > 0.5 * sum(plain)


def _shuffled_rows(plan):
    """Rows written to shuffles by a plan that has run."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled_rows(plan.plan())
    below = plan.children()
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.metrics().contains("shuffleRecordsWritten") else 0
    return own + sum(_shuffled_rows(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_a_heavy_key_are_not_copied(spark, how):
    """4.5 million pairs in cells of 100: the shuffles carry the rows of both sides a few times, not a copy for each cell they meet in."""
    a = spark.range(1500).select(F.lit(0).alias("k"), F.col("id").alias("v"))
    b = spark.range(3000).select(F.lit(0).alias("k"), F.col("id").alias("w"))
    met = pn.skewed_join(a, b, ["k"], how, cell_rows=100).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w"))
    assert tuple(met.collect()[0]) == (1500 * 3000, 3000 * sum(range(1500)), 1500 * sum(range(3000)))
    assert 0 < _shuffled_rows(met._jdf.queryExecution().executedPlan()) < 4 * 4500


def test_empty_sides_and_other_joins(waves):
    a, b = waves
    b = b.drop("s.t")
    assert pn.skewed_join(a, b.limit(0), ["k"]).count() == 0
    assert rows(pn.skewed_join(a, b.limit(0), ["k"], "left")) == rows(a.join(b.limit(0), ["k"], "left"))
    assert pn.skewed_join(a.limit(0), b, ["k"], "left").count() == 0
    with pytest.raises(ValueError):
        pn.skewed_join(a, b, ["k"], "full")
