"""Hard negatives against brute force: whole tables, odd rows, and the intervals themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import hardneg, queries

SCHEMA = "vec_id long, embedding array<float>, label int, score double, row long, rank int"


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90, scale=256):
    """Sorted result rows, every anchor with every row."""
    kept = [(i, np.floor(np.array(e, np.float32).astype(float) * scale), l) for i, e, l in rows
            if l is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    size = max((len(e) for _, e, _ in kept), default=0)
    kept = [(i, np.pad(e, (0, size - len(e))).astype(np.int64), l) for i, e, l in kept]
    out = []
    last = lambda i: (i is None, i or 0)
    for k, (i, e, l) in enumerate(kept):
        if i is None or i % every:
            continue
        told = [(int(e @ f), j, m) for n, (j, f, m) in enumerate(kept) if n != k]
        told.sort(key=lambda t: (-t[0], last(t[1])))
        for p, j, _ in [t for t in told if t[2] == l][:positives]:
            inside = [t for t in told if t[2] != l and low * p <= 100 * t[0] <= high * p][:negatives]
            out += [(i, j, r, n, p, s) for r, (s, n, _) in enumerate(inside, 1)]
    return sorted(out, key=str)


def mined(df, **options):
    options = {"every": 100} | options
    every = options.pop("every")
    got = hardneg.mine(df, F.col("vec_id") % every == 0, **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted(map(tuple, got.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = queries.op11_hard_negatives(spark, sf).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def odd_vectors(size=24, many=300):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(4, size))
    rows = [(k, (centres[k % 4] * 0.3 + rng.normal(size=size) * 0.4).astype(np.float32).tolist(), int(rng.integers(0, 3))) for k in range(many)]
    rows += [rows[10], rows[10], rows[20], (20, rows[20][1], 2)]  # repeated rows, an anchor among them, and one id under two labels
    rows += [(900 + k, rows[5][1], k % 2) for k in range(40)]  # one vector many times: ties
    rows += [(None, rows[0][1], 0), (1000, None, 1), (1001, rows[3][1], None), (1020, [float("nan")] * size, 1), (1003, [None] * size, 1), (1004, [float("inf")] * size, 0)]
    return rows + [(1040, [], 1), (1006, [1.0, 2.0], 0), (1007, [0.5] * (size + 1), 2)]  # other lengths


@pytest.mark.parametrize("block", [2048, 7])
@pytest.mark.parametrize("pilot", [64, 3])
def test_odd_rows(spark, block, pilot):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, 0.5, 7, 1) for r in rows], SCHEMA).repartition(5)
    assert mined(df, every=20, block=block, pilot=pilot) == brute(rows, every=20)


def test_other_parameters_and_few_levels(spark):
    rows = odd_vectors(size=70, many=120)
    df = spark.createDataFrame([(*r, 0.5, 7, 1) for r in rows], SCHEMA)
    options = dict(positives=2, negatives=3, low=50, high=99, scale=100)
    assert mined(df, every=10, levels=2, **options) == brute(rows, every=10, **options)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []


def test_no_partner(spark):
    assert mined(spark.createDataFrame([(0, [1.0], 1, None, None, None)], SCHEMA)) == []


def test_too_large_components_raise(spark):
    df = spark.createDataFrame([(0, [1e30], 1, None, None, None)], SCHEMA)
    with pytest.raises(ValueError):
        mined(df)


@pytest.mark.parametrize("size", [64, 128])
def test_intervals_hold_every_score(size):
    rng = np.random.default_rng(1)
    x = rng.integers(-200, 200, (300, size))
    x[:3] = 0
    x[3] = 199  # all alike
    coder = hardneg.Coder(size)
    codes, aligned, norm = coder.codes(x)
    anchors = hardneg.Anchors(coder, np.arange(40), np.zeros(40, int), x[:40])
    score = x @ x[:40].T
    widths = []
    for levels in range(1, coder.levels + 1):
        est, off, half = hardneg._intervals(anchors, codes, aligned, norm, slice(0, 40), slice(None), range(levels), 0.0, 0.0)
        assert (np.abs(est - score) <= half).all()
        widths.append(half.mean())
    assert all(b < 0.75 * a for a, b in zip(widths, widths[1:]))  # every level's rest is shorter
