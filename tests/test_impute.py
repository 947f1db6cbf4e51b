"""Chained imputation against a plain loop over the whole table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.operators.impute import hashed_normal, mice, ridge_from_moments

COLS = ["a", "b", "c", "bin"]


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(4)
    n = 1200
    a = rng.normal(50, 10, n)
    b = 0.5 * a + rng.normal(0, 5, n)
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "c": 2 * b - a + rng.normal(0, 3, n), "bin": (a > 50).astype(float), "keep": a.round(2)})
    full = pdf.copy()
    for c, share in (("a", 0.05), ("b", 0.2), ("bin", 0.1)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    df = spark.createDataFrame(pdf)
    return df.select("id", "keep", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in COLS]), pdf, full


def _ridge(x, y, tol):
    z = np.column_stack([np.ones(len(x)), x, y])
    return ridge_from_moments(z.T @ z, x.shape[1], tol)


def _plain_chain(pdf, rounds, tol=1e-3):
    x = pdf[COLS].to_numpy().copy()
    hole = np.isnan(x)
    x = np.where(hole, np.nanmean(x, axis=0), x)
    for _ in range(rounds):
        for j in np.argsort(hole.sum(axis=0), kind="stable"):
            if hole[:, j].any():
                rest = [k for k in range(x.shape[1]) if k != j]
                seen = ~hole[:, j]
                m = _ridge(x[np.ix_(seen, rest)], x[seen, j], tol)
                x[hole[:, j], j] = m.intercept + x[np.ix_(hole[:, j], rest)] @ m.coef[:-1]
    return x


def test_conditional_means_match_a_plain_loop(gappy):
    df, pdf, _ = gappy
    got = mice(df, ["id"], COLS, m=1, rounds=3, sample=False, checkpoint_every=2).toPandas().sort_values("id")
    assert got[COLS].to_numpy() == pytest.approx(_plain_chain(pdf, 3), abs=1e-6)


def test_large_samples_approach_least_squares():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5000, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=5000)
    m = _ridge(x, y, 1e-12)
    ols = np.linalg.lstsq(np.column_stack([np.ones(5000), x]), y, rcond=None)[0]
    assert [m.intercept, *m.coef[:3]] == pytest.approx(ols, abs=2e-3)
    assert m.noise == pytest.approx(1.0, abs=0.1) and m.coef[3] == 0.0


def test_draws_do_not_depend_on_partitioning_or_checkpoints(gappy):
    df, _, _ = gappy
    pick = lambda d: d.toPandas().sort_values(["mi_id", "id"])[COLS].to_numpy()
    one = pick(mice(df.repartition(2), ["id"], COLS, m=2, rounds=2, checkpoint_every=1))
    two = pick(mice(df.repartition(9, "keep"), ["id"], COLS, m=2, rounds=2, checkpoint_every=5))
    assert one == pytest.approx(two, abs=1e-6)
    other = pick(mice(df, ["id"], COLS, m=2, rounds=2, seed=1))
    assert np.abs(one - other).max() > 0.5


def test_observed_cells_and_other_columns_are_untouched(gappy):
    df, pdf, full = gappy
    got = mice(df, ["id"], COLS, m=3, rounds=2).toPandas()
    assert sorted(got["mi_id"].unique()) == [1, 2, 3] and len(got) == 3 * len(pdf)
    assert list(got.columns) == ["id", "keep", *COLS, "mi_id"]
    for _, part in got.groupby("mi_id"):
        part = part.sort_values("id").reset_index(drop=True)
        seen = pdf[COLS].notna().to_numpy()
        assert (part[COLS].to_numpy()[seen] == pdf[COLS].to_numpy()[seen]).all()
        assert part[COLS].notna().all().all() and (part["keep"] == pdf["keep"]).all()
        hole = pdf["b"].isna()
        assert np.corrcoef(part["b"][hole], full["b"][hole])[0, 1] > 0.7
        assert part["b"].std() == pytest.approx(full["b"].std(), rel=0.1)


def test_chains_differ_and_binary_rounding_is_optional(gappy):
    df, pdf, _ = gappy
    got = mice(df, ["id"], COLS, m=2, rounds=1).toPandas().sort_values("id")
    hole = pdf["bin"].isna().to_numpy()
    first, second = (got[got["mi_id"] == k]["bin"].to_numpy() for k in (1, 2))
    assert not np.isin(first[hole], [0, 1]).any() and (first[hole] != second[hole]).all()
    rounded = mice(df, ["id"], COLS, m=1, rounds=1, round_binary=True).toPandas().sort_values("id")
    assert np.isin(rounded["bin"], [0, 1]).all()
    assert (rounded["b"][pdf["b"].isna().to_numpy()] % 1 != 0).all()


def test_columns_without_values_and_tables_without_gaps(spark):
    df = spark.createDataFrame([(i, float(i), None if i == 3 else float(i * 2)) for i in range(20)], "id int, a double, b double").withColumn("void", F.lit(None).cast("double"))
    got = mice(df, ["id"], ["a", "b", "void"], m=2, rounds=1, sample=False).toPandas()
    assert got["void"].isna().all() and got["b"].notna().all() and len(got) == 40
    whole = mice(df.select("id", "a"), ["id"], ["a"], m=2)
    assert whole.count() == 40


def test_hashed_normals_look_normal():
    z = hashed_normal(np.arange(200000, dtype=np.uint64) * np.uint64(7919), 12)
    assert abs(z.mean()) < 0.01 and z.std() == pytest.approx(1.0, abs=0.01)
    assert np.corrcoef(z[:-1], z[1:])[0, 1] == pytest.approx(0.0, abs=0.01)
    assert np.corrcoef(z, hashed_normal(np.arange(200000, dtype=np.uint64) * np.uint64(7919), 13))[0, 1] == pytest.approx(0.0, abs=0.01)


def test_repeated_keys_keep_their_rows_and_missing_keys_are_refused(spark):
    rows = [(i // 2, float(i), None if i % 5 == 0 else float(3 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    got = mice(df, ["id"], ["a", "b"], m=2, rounds=2).toPandas()
    assert len(got) == 80 and got["b"].notna().all()
    for _, part in got.groupby("mi_id"):
        assert sorted(zip(part["id"], part["a"])) == sorted((r[0], r[1]) for r in rows)
    with pytest.raises(ValueError, match="no id"):
        mice(df.withColumn("id", F.when(F.col("a") > 1, F.col("id"))), ["id"], ["a", "b"])


def test_large_means_lose_no_digits(gappy):
    df, pdf, _ = gappy
    shifted = df.withColumns({c: F.col(c) + 1e9 for c in ("a", "b")})
    got = mice(shifted, ["id"], COLS, m=1, rounds=2, sample=False).toPandas().sort_values("id")
    want = mice(df, ["id"], COLS, m=1, rounds=2, sample=False).toPandas().sort_values("id")
    assert got["b"].to_numpy() - 1e9 == pytest.approx(want["b"].to_numpy(), abs=1e-4)


def test_rounds_rewrite_packed_blocks(spark):
    """A round's checkpoint takes blocks and leaves blocks: doubles, whole numbers beyond 2 ** 53 and all rows survive."""
    from panelwright.operators import sums

    df = spark.range(20_000, numPartitions=3).select(F.col("id").cast("double").alias("x"), (F.col("id") + (1 << 60)).alias("n"))
    kept = sums.keep_blocks(df)
    blocks = kept.df.count()
    for _ in range(2):
        kept = kept.settled(lambda b: {"x": b["x"] + 0.5})
    assert kept.df.columns == ["n", "data"] and kept.df.count() == blocks < 10
    got = sorted(map(tuple, kept.rows(["n", "x"]).collect()))
    assert got == [(i + (1 << 60), i + 1.0) for i in range(20_000)]
