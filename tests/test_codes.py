"""Null rules and edge cases of the recodes."""

import pytest
from pyspark.sql import functions as F

from panelwright.functions import codes as c


def values(df, *cols):
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.select(*cols).collect()]


def test_to_num_accepts_plain_numbers_only(spark):
    text = ["abc", "", " 3 ", "1d", "5f", "NaN", "-2.5e1", "+.5", "7.", None, "0x1F", "1,000"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string").orderBy("i")
    assert values(df, c.to_num("t")) == [None, None, 3.0, None, None, None, -25.0, 0.5, 7.0, None, None, None]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert values(df, c.nan_to_null("x")) == [None, 1.0]


def test_recode_variants(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (9.0,), (None,)], "x double")
    assert values(df, c.recode("x", [1], [2])) == [1.0, 0.0, None, None]
    assert values(df, c.recode("x", [1], "other_non_null")) == [1.0, 0.0, 0.0, None]
    assert values(df, c.threshold("x", ">=", 2)) == [0.0, 1.0, 1.0, None]


def test_strict_conjunction_is_missing_when_any_input_is(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, 3.0), (5.0, 1.0), (None, 3.0)], "f double, a double")
    assert values(df, c.all_of_strict([F.col("f") >= 5, F.col("a") >= 3], ["f", "a"])) == [None, 1.0, 0.0, None]


def test_body_mass_index(spark):
    df = spark.createDataFrame([(0.0, 60.0), (None, 60.0), (170.0, None), (200.0, 20.0), (170.0, 68.0), (0.0, 0.0)], "h double, w double")
    got = values(df, c.body_mass_index("h", "w"))
    assert got[:4] == [60.0, None, None, 10.0]
    assert got[4] == pytest.approx(68 / 1.7**2)
    assert got[5] is None


def test_row_sum_needs_enough_answers_and_does_not_prorate(spark):
    cols = [f"i{k}" for k in range(13)]
    rows = [tuple([2.0] * 9 + [None] * 4), tuple([2.0] * 10 + [None] * 3), tuple([2.0] * 13)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in cols))
    assert values(df, c.row_sum(cols, 10)) == [None, 20.0, 26.0]


def test_reverse_code_keeps_missing(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (None,)], "x double")
    assert values(df, c.reverse_code("x", 5)) == [4.0, 1.0, None]


def test_multiselect_status(spark):
    cols = ["p1", "n1", "p2", "n2"]
    rows = [(1, 0, 0, 1), (0, 1, 0, 1), (1, 0, None, None), (None, 1, 0, 0), (1, 1, 1, 0)]
    df = spark.createDataFrame(rows, "p1 int, n1 int, p2 int, n2 int")
    assert values(df, c.multiselect_status(["p1", "p2"], ["n1", "n2"], [["p1", "n1"], ["p2", "n2"]])) == [1.0, 0.0, None, None, 1.0]
    assert cols


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (65.0,), (65.1,), (100.0,), (101.0,), (None,)], "x double")
    assert values(df, c.cut("x", [0, 65, 100])) == [None, 0, 0, 1, 1, None, None]
    assert values(df, c.cut("x", [0, 65, 100], include_lowest=True))[0] == 0
    with pytest.raises(ValueError):
        c.cut("x", [0, 65, 100], [1])


def test_age_65_differs_between_bins_and_flag(spark):
    df = spark.createDataFrame([(65.0,)], "age double")
    assert values(df, c.cut("age", [0, 65, 100]), c.at_least("age", 65)) == [(0, 1.0)]


def test_missing_bins_join_the_reference_unless_told_otherwise(spark):
    df = spark.createDataFrame([(2,), (1,), (None,)], "q int")
    assert values(df, c.bin_indicator("q", 2)) == [1.0, 0.0, 0.0]
    assert values(df, c.bin_indicator("q", 2, null_in_reference=False)) == [1.0, 0.0, None]


def test_tier_by_name(spark):
    df = spark.createDataFrame([("age",), ("HI_sum_22",), ("Stroke_23",)], "v string")
    assert values(df, c.tier("v", ["HI_sum_22"])) == [0, 1, 2]
