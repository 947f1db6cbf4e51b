"""Toxic passages as maximum-scoring segments over token log-odds, and a calibrated score per document.

1. Token weights: log-odds of toxic against clean labelled documents with an informative Dirichlet prior (the tokens' shares
   in all labelled rows). A word's tokens are itself and its first 6 and 4 bytes; the longest one with a z-score of at least
   ``least_z`` weighs the word. All other words share one weight, which makes the expected score of clean text negative. A token
   counts once per document, and documents with the same smallest shingle hash (copies, mostly) count once.
2. Every text is scanned once: all maximal scoring segments by the linear-time method of Ruzzo and Tompa. Only tokens
   with a positive weight start or end a segment, so the scan's steps are the positive tokens, on prefix sums of all weights.
3. Extreme-value calibration: lambda solves sum p(w) exp(lambda s(w)) = 1 over clean tokens, and K comes from the clean
   training documents' best scores (Gumbel mean). A segment is significant when lambda S - ln(K N) > 0.
4. A logistic model on the best normalised score and the sum over significant segments gives the probability; it is
   fitted on counts of rounded values, so no document reaches the driver.

Labels are learnt only where crc32(doc_id) mod 4 is not 2, from at most ``most`` rows of each class (seeded hash order);
labels, lang, source and doc_id are never inputs of a score. NULL and empty texts have no segments and get the score of such documents;
without labels of both classes every score is 0.5. Repeated rows get equal scores; repeated labels of a doc_id count as toxic if any is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm import shared
from panelwright.llm.words import PUNCTUATION, U, WHITE, Words, fold_table, pieces, shingles

_TABLE = fold_table(WHITE + PUNCTUATION)


_PREFIXES = (6, 4)


@dataclass
class Weights:
    """Sorted token hashes with their weights, the weight of all other words, and lambda."""

    token: np.ndarray
    weight: np.ndarray
    other: float
    scale: float

    def of(self, w: Words) -> np.ndarray:
        out = np.full(len(w.hash), self.other)
        if len(self.token):
            near = np.zeros(1 << 16, bool)  # most tokens are done with one look at their hash prefix
            near[(self.token >> U(48)).astype(np.int64)] = True
            for h in [*reversed(w.prefixes), w.hash]:  # longer tokens have the last word
                at = np.flatnonzero(near[(h >> U(48)).astype(np.int64)])
                place = np.minimum(np.searchsorted(self.token, h[at]), len(self.token) - 1)
                hit = self.token[place] == h[at]
                out[at[hit]] = self.weight[place[hit]]
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(labels: DataFrame, most: int, seed: int) -> DataFrame:
    """doc_id and toxic of the rows to learn from: at most ``most`` of each class."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(seed))
    return own.filter("toxic = 1").orderBy(order).limit(most).union(own.filter("toxic = 0").orderBy(order).limit(most))


def sketches(docs: DataFrame) -> DataFrame:
    """key, toxic and the smallest five-word shingle hash of labelled documents."""

    def run(batches):
        for batch in batches:
            low = []
            for _, _, w in pieces(batch.column("text"), _TABLE):
                s, first = shingles(w, 5)
                none = first[1:] == first[:-1]
                own = np.minimum.reduceat(np.r_[s, U(0)], first[:-1]) if w.rows else s
                low.append(np.where(none, U(0), own))
            if low:
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(np.concatenate(low).view(np.int64))], names=["key", "toxic", "sketch"])

    return docs.select("key", "toxic", "text").mapInArrow(run, "key long, toxic int, sketch long")


def token_counts(docs: DataFrame) -> DataFrame:
    """token (hash), and in how many toxic and clean documents it is (columns text, toxic)."""

    def run(batches):
        for batch in batches:
            flag = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            for a, b, w in pieces(batch.column("text"), _TABLE, prefixes=_PREFIXES):
                row = w.row_of()
                found = []
                for h in (w.hash, *w.prefixes):
                    order = np.lexsort((row, h))
                    t, r = h[order], row[order]
                    new = np.r_[True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])] if len(t) else np.zeros(0, bool)
                    found.append((t[new], r[new]))
                t, r = (np.concatenate(x) for x in zip(*found))
                token, inverse = np.unique(t, return_inverse=True)
                y = np.bincount(inverse, flag[a:b][r], len(token)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(token)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(y), pa.array(n - y)], names=["token", "toxic", "clean"])

    return docs.mapInArrow(run, "token long, toxic long, clean long").groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(y1: np.ndarray, y0: np.ndarray, n1: float, n0: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds with a Dirichlet prior of ``strength`` of the tokens seen, shared as all of them are, and their z-scores."""
    prior, all_ = strength * (y1 + y0), strength * (n1 + n0)
    odds = lambda y, n: np.log((y + prior) / (n + all_ - y - prior))
    return odds(y1, n1) - odds(y0, n0), (odds(y1, n1) - odds(y0, n0)) / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def fit_weights(counts: DataFrame, strength: float = 0.05, least_z: float = 3.5, least_count: int = 4, vocabulary: int = 50_000) -> Weights:
    """Weights of the (at most ``vocabulary``) most significant tokens; only these reach the driver."""
    total = counts.agg(F.sum("toxic").alias("n1"), F.sum("clean").alias("n0")).first()
    n1, n0 = float(total["n1"] or 0), float(total["n0"] or 0)
    if not n1 or not n0:
        return Weights(np.zeros(0, U), np.zeros(0), -1.0, 1.0)
    prior, all_ = F.lit(strength) * (F.col("toxic") + F.col("clean")), strength * (n1 + n0)
    odds = lambda y, n: F.log((F.col(y) + prior) / (F.lit(n + all_) - F.col(y) - prior))
    z = (odds("toxic", n1) - odds("clean", n0)) / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior))
    best = counts.filter(F.col("toxic") + F.col("clean") >= least_count).withColumn("z", z).filter(F.abs("z") >= least_z)
    found = best.orderBy(F.abs("z").desc(), "token").limit(vocabulary).select("token", "toxic", "clean").toPandas()
    token = found["token"].to_numpy(np.int64).view(U)
    y1, y0 = found["toxic"].to_numpy(float), found["clean"].to_numpy(float)
    weight, _ = log_odds(y1, y0, n1, n0, strength)
    rest1, rest0 = max(n1 - y1.sum(), 1.0), max(n0 - y0.sum(), 1.0)
    other = min(np.log((rest1 / n1) / (rest0 / n0)), 0.0) - 0.05  # the margin keeps clean drift negative
    p0 = np.r_[(y0 + 0.5), rest0]
    p0 /= p0.sum()
    s = np.r_[weight, other]
    if (s * p0).sum() >= 0:
        s, other = s - (s * p0).sum() - 0.05, other - (s * p0).sum() - 0.05
    low, high = 1e-6, 50.0  # the positive root: the sum is below 1 before it and above after
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (low, mid) if (p0 * np.exp(np.minimum(mid * s, 700))).sum() > 1 else (mid, high)
    order = np.argsort(token)
    return Weights(token[order], s[:-1][order], float(other), float(low))


def maximal_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order; linear in the positive scores."""
    up = np.flatnonzero(s > 0)
    if not len(up):
        return []
    run = np.concatenate([[0.0], np.cumsum(s)])
    stack: list[list] = []  # [sum before, sum after, start, end, place of the nearest earlier segment with a smaller sum before]
    for i in up.tolist():
        left, right, start = float(run[i]), float(run[i + 1]), i
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][0] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= right:
                stack.append([left, right, start, i + 1, j])
                break
            left, start = stack[j][0], stack[j][2]  # merge with all segments from j on
            j, before = stack[j][4], j
            del stack[before:]
    return [(a, b, r - l) for l, r, a, b, _ in stack]


def scan(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, key, n (words), segments: array<struct<start, end, score>> (word places) of every text."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        w8 = held.value
        for batch in batches:
            count, found = [], []
            for _, _, w in pieces(batch.column("text"), _TABLE, prefixes=_PREFIXES):
                s = w8.of(w)
                positive = np.concatenate([[0], np.cumsum(s > 0)])
                count.append(np.diff(w.first))
                some = positive[w.first[1:]] > positive[w.first[:-1]]
                for r in range(w.rows):
                    found.append([{"start": a, "end": b, "score": x} for a, b, x in maximal_segments(s[w.first[r] : w.first[r + 1]])] if some[r] else [])
            if count:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), pa.array(np.concatenate(count), pa.int64()), pa.array(found, kind)], names=["doc_id", "key", "n", "segments"])

    return docs.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key long, n long, segments array<struct<start:int,end:int,score:double>>")


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    z, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-3] + [1e-1] * x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (n * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = 50_000, cut: float = 0.3, seed: int = 11) -> DataFrame:
    """doc_id, key, held_out, score, predicted, segments (significant ones): one row per document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text")).withColumn("key", shared.row_key("doc_id", "text"))
    rows = shared.written(training_rows(labels, most, seed), "training")
    few = F.broadcast(rows)  # at most 2 * most rows
    own = shared.written(sketches(d.join(few, "doc_id")), "sketches").groupBy("sketch", "toxic").agg(F.min("key").alias("key")).select("key", "toxic")
    weights = fit_weights(shared.written(token_counts(d.join(F.broadcast(own), "key").select("text", "toxic")), "tokens"))
    raw = shared.written(scan(d, weights), "segments")
    lam = weights.scale
    best = F.coalesce(F.array_max(F.transform("segments", lambda s: s["score"])), F.lit(0.0))
    seen = raw.withColumn("best", best).withColumn("size", F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    clean = seen.join(few, "doc_id").filter("toxic = 0 AND best > 0").agg(F.avg(lam * F.col("best") - F.col("size")).alias("m")).first()["m"]
    log_k = (clean if clean is not None else 0.0) - 0.5772156649015329  # the Gumbel distribution's mean is ln(K N) + gamma
    norm = lambda s: F.lit(lam) * s - F.col("size") - F.lit(log_k)
    seen = seen.withColumn("segments", F.filter("segments", lambda s: norm(s["score"]) > 0))
    top = F.when(F.col("best") > 0, norm(F.col("best")))
    total = F.aggregate("segments", F.lit(0.0), lambda a, s: a + norm(s["score"]))
    step = lambda c: F.round(c * 4) / 4
    seen = seen.withColumn("top", step(F.greatest(F.least(F.coalesce(top, F.lit(-20.0)), F.lit(60.0)), F.lit(-20.0)))).withColumn("total", step(F.sqrt(F.least(total, F.lit(1e4)))))
    cells = seen.join(few, "doc_id").groupBy("top", "total").agg(F.sum("toxic").alias("y"), F.count(F.lit(1)).alias("n")).toPandas()
    if not len(cells) or not 0 < cells["y"].sum() < cells["n"].sum():
        chance = F.lit(0.5)
    else:
        features = np.c_[cells["top"].clip(lower=-5), cells["total"], cells["top"] <= -5].astype(float)
        n = cells["n"].to_numpy(float)
        w = _logistic(features, cells["y"].to_numpy(float) / n, n)
        z = F.lit(float(w[0])) + F.lit(float(w[1])) * F.greatest(F.col("top"), F.lit(-5.0)) + F.lit(float(w[2])) * F.col("total") + F.lit(float(w[3])) * (F.col("top") <= -5).cast("double")
        chance = 1 / (1 + F.exp(-z))
    return seen.withColumn("score", chance).select(
        "doc_id", "key", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "segments")


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns (clashing names too)."""
    bad = score_toxicity(docs, labels, cut=cut).filter("predicted = 1").select(F.col("key").alias("__toxic")).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), shared.whole_text())
    return docs.withColumn("__toxic", key).join(bad, "__toxic", "left_anti").drop("__toxic")
