import math

import pytest
from pyspark.sql import functions as F

from panelwright.functions import tails as t


def test_normal_and_chi_square():
    assert t.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert t.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert t.chi2_upper(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-10)
    assert t.chi2_upper(2 * 3.0, 2) == pytest.approx(math.exp(-3.0), rel=1e-12)
    assert t.chi2_upper(0.0, 3) == 1.0


def test_student_t():
    assert t.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert t.t_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert t.t_two_sided(1.959963984540054, 1e9) == pytest.approx(0.05, abs=1e-7)


def _fisher_brute(a, b, c, d):
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    pmf = {k: math.comb(col, k) * math.comb(n - col, row - k) / math.comb(n, row) for k in range(lo, hi + 1)}
    return sum(v for v in pmf.values() if v <= pmf[a] * (1 + 1e-7))


@pytest.mark.parametrize("cells", [(3, 1, 1, 3), (8, 2, 1, 5), (4, 96, 20, 80), (0, 10, 5, 5), (1, 9, 11, 3), (2, 300, 40, 500), (5, 0, 0, 5)])
def test_fisher_matches_enumeration(cells):
    assert t.fisher_2x2(*cells) == pytest.approx(_fisher_brute(*cells), rel=1e-9)


def test_large_tables_stay_fast():
    assert 0.0 <= t.fisher_2x2(4, 10**8, 30, 10**8) < 1e-4


def test_corrected_chi_square():
    assert t.chi2_2x2(10, 20, 30, 40) == pytest.approx(0.5040358664525046, rel=1e-9)
    assert math.isnan(t.chi2_2x2(0, 0, 3, 4))


def test_small_cell_takes_the_exact_test(spark):
    df = spark.createDataFrame([(4.0, 96.0, 20.0, 80.0), (10.0, 20.0, 30.0, 40.0), (None, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(t.two_by_two_p("a", "b", "c", "d")).collect()]
    assert got[0] == pytest.approx(_fisher_brute(4, 96, 20, 80), rel=1e-9)
    assert got[1] == pytest.approx(t.chi2_2x2(10, 20, 30, 40), rel=1e-12)
    assert got[2] is None
    assert [r[0] for r in df.select(t.normal_p(F.lit(None).cast("double"))).limit(1).collect()] == [None]


def test_native_normal_tail(spark):
    import math

    z = [k / 8 for k in range(-20, 300)] + [0.0, 37.0, 1e3, math.inf]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(t.normal_p("z")).collect()]
    for x, p in zip(z, got):
        assert p == pytest.approx(t.normal_two_sided(x), rel=1e-11, abs=1e-300)
    assert spark.createDataFrame([(math.nan,)], "z double").select(t.normal_p("z")).first()[0] is None
