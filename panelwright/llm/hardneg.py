"""Hard negatives by rotated one-bit codes, exact at the end.

A vector is rotated (two rounds of random signs and a Walsh-Hadamard transform), its signs become a code, and the *alignment*
of vector and code vector is stored. What the code leaves over is coded again, ``levels`` times, each in a rotation of its own,
so the rest shrinks to about 0.6 of its length with every level. For an anchor, a row's inner product is the sum of alignment x
(code . anchor), counted by popcounts over the bit planes of the quantised anchor, plus the rest's part. That part is at most
|rest| * |anchor| (Cauchy-Schwarz) and the quantisation error at most the sum of the anchor's rounding errors, so every row
has an interval that surely holds its score. Rows whose interval misses the wanted scores go; the others are scored exactly
as integers.

1. All rows are coded once into a stored table. Anchors come in blocks of about ``block``; only a block is ever sent to all tasks.
2. *Pilot*: the same search over a 64th of the rows gives each anchor scores that its k-th best row reaches at least, so tasks
   hand on a number of rows that depends on k, not on the number of tasks. It decides about speed only.
3. First positives over all rows, then negatives inside each positive's range of scores. Tasks keep k rows for each list.

Rows with a NULL label, a NULL vector or any NULL or non-finite component take no part; a NULL id is no anchor and comes last
among ties. Repeated rows are rows of their own (an anchor's copy can be its positive). Vectors of different lengths are
padded with zeros. Scores are 64-bit integers; components too large for them raise an error. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm import shared

_LAST = np.iinfo(np.int64).max
_PLANES = 8  # bits of a quantised anchor component
_LOW = np.iinfo(np.int64).min
CODED = "row long, vec_id long, label long, anchor boolean, ints binary, codes binary, alignment binary, norm double"


class Rotation:
    """Random signs and a Walsh-Hadamard transform, twice: orthogonal, without a matrix."""

    def __init__(self, size: int, level: int, seed: int):
        rng = np.random.default_rng([seed, level, size])
        self.signs = rng.integers(0, 2, (2, size)) * 2.0 - 1.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for signs in self.signs:
            x = _hadamard(x * signs)
        return x


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, size = x.shape
    step = 1
    while step < size:
        pairs = x.reshape(n, size // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


@dataclass(frozen=True)
class Coder:
    size: int  # components after padding: a power of two, 64 at least
    levels: int = 6
    seed: int = 11

    def rotations(self) -> list[Rotation]:
        return [Rotation(self.size, k, self.seed) for k in range(self.levels)]

    def codes(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes [rows, levels, words], alignments [rows, levels], norms)."""
        rest, words, aligned = vectors.astype(float), [], []
        for rotate in self.rotations():
            rest = rotate(rest)
            up = rest >= 0
            along = np.abs(rest).sum(1) / np.sqrt(self.size)
            rest = rest - np.where(up, 1.0, -1.0) * (along / np.sqrt(self.size))[:, None]
            words.append(np.ascontiguousarray(np.packbits(up, axis=1, bitorder="little")).view("<u8"))
            aligned.append(along)
        return np.stack(words, 1), np.stack(aligned, 1), np.sqrt((vectors.astype(float) ** 2).sum(1))


class Anchors:
    """A block of anchors: integers, and the bit planes of each level's rotated vector."""

    def __init__(self, coder: Coder, rows: np.ndarray, labels: np.ndarray, ints: np.ndarray):
        self.rows, self.labels, self.ints, self.coder = rows, labels, ints, coder
        u = ints.astype(float)
        self.norm = np.sqrt((u * u).sum(1))
        self.planes, self.low, self.step, self.total, self.lost = [], [], [], [], []
        for rotate in coder.rotations():
            u = rotate(u)
            low = u.min(1)
            step = np.maximum((u.max(1) - low) / (2**_PLANES - 1), 1e-300)
            q = np.clip(np.rint((u - low[:, None]) / step[:, None]), 0, 2**_PLANES - 1).astype(np.int64)
            bits = (q[:, :, None] >> np.arange(_PLANES) & 1).astype(bool).transpose(2, 0, 1)
            self.planes.append(np.ascontiguousarray(np.packbits(bits, axis=2, bitorder="little")).view("<u8"))  # [plane, anchor, word]
            self.low.append(low)
            self.step.append(step)
            self.total.append(q.sum(1))
            self.lost.append(np.abs(u - low[:, None] - q * step[:, None]).sum(1))

    def along(self, level: int, codes: np.ndarray, at: np.ndarray | slice, dense: bool) -> tuple[np.ndarray, np.ndarray]:
        """code . anchor and the most it can be off, from popcounts; dense: every code with every anchor of ``at``."""
        wide = (lambda x: x[None, :]) if dense else (lambda x: x)
        planes, spread = self.planes[level][:, at], codes[:, None, :] if dense else codes
        weighted = np.zeros((len(codes), planes.shape[1]) if dense else len(codes), np.int64)
        for k in range(_PLANES):
            both = np.bitwise_count(spread & (planes[k][None] if dense else planes[k]))
            weighted += (both.sum(-1, dtype=np.int64) if both.shape[-1] > 1 else both[..., 0].astype(np.int64)) << k
        ones = np.bitwise_count(codes).sum(-1, dtype=np.int64)
        ones = ones[:, None] if dense else ones
        size = self.coder.size
        value = wide(self.low[level][at]) * (2 * ones - size) + wide(self.step[level][at]) * (2 * weighted - wide(self.total[level][at]))
        return value / np.sqrt(size), wide(self.lost[level][at]) / np.sqrt(size)


def _intervals(anchors: Anchors, codes: np.ndarray, aligned: np.ndarray, norm: np.ndarray, a, r, levels: range, at, off):
    """Estimate and half-width for pairs (row r, anchor a) after ``levels``; ``at``, ``off``: those of the levels before."""
    dense = isinstance(a, slice)
    for level in levels:
        value, lost = anchors.along(level, codes[r, level], a, dense)
        weight = aligned[r, level][:, None] if dense else aligned[r, level]
        at, off = at + weight * value, off + weight * lost
    squares = norm[r] ** 2 - (aligned[r, : levels.stop] ** 2).sum(1)
    rest = np.sqrt(np.maximum(squares, 0) + 1e-12 * norm[r] ** 2)
    whole = anchors.norm[a][None, :] if dense else anchors.norm[a]
    rest, length = (rest[:, None], norm[r][:, None]) if dense else (rest, norm[r])
    return at, off, off + rest * whole + 1e-9 * length * whole + 1e-6


class Lists:
    """The best ``most`` rows of each list (list = anchor, or anchor and positive), merged batch by batch."""

    def __init__(self, lists: int, most: int, floor_score: np.ndarray, floor_id: np.ndarray):
        self.most, self.lists = most, lists
        self.score, self.id = floor_score.copy(), floor_id.copy()  # what a row has to reach: this score, and this id among equals
        self.held = tuple(np.zeros(0, np.int64) for _ in range(4))  # list, score, id, row

    def add(self, which, score, ids, rows) -> None:
        good = (score > self.score[which]) | ((score == self.score[which]) & (ids <= self.id[which]))
        new = (which[good], score[good], ids[good], rows[good])
        if not len(new[0]):
            return
        held = tuple(np.concatenate(x) for x in zip(self.held, new))
        order = np.lexsort((held[3], held[2], -held[1], held[0]))
        held = tuple(x[order] for x in held)
        start = np.searchsorted(held[0], np.arange(self.lists + 1))
        rank = np.arange(len(order)) - start[held[0]]
        self.held = tuple(x[rank < self.most] for x in held)
        full = np.flatnonzero(np.diff(np.searchsorted(self.held[0], np.arange(self.lists + 1))) == self.most)
        end = np.searchsorted(self.held[0], full, "right") - 1
        self.score[full], self.id[full] = self.held[1][end], self.held[2][end]


def _search(anchors: Anchors, floors, ceilings, owner, most: int, same: bool, first: int = 3, rows: int = 1024, width: int = 512):
    """A task's search: floors and ceilings of score by list, ``owner``: the anchor of each list (in order)."""
    by_anchor = np.searchsorted(owner, np.arange(len(anchors.rows) + 1))
    per = int(np.diff(by_anchor).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, coder = Lists(len(owner), most, *floors), anchors.coder
        dense = range(min(first, coder.levels))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                column = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind).reshape(part.num_rows, -1)
                ints, norm = column("ints", "<i4"), part.column("norm").to_numpy()
                codes, aligned = column("codes", "<u8").reshape(part.num_rows, coder.levels, -1), column("alignment", "<f8")
                ids, row, label = part.column("vec_id").fill_null(_LAST).to_numpy(), part.column("row").to_numpy(), part.column("label").to_numpy()
                for left in range(0, len(anchors.rows), width):
                    a = slice(left, min(left + width, len(anchors.rows)))
                    asked = np.diff(by_anchor[left : a.stop + 1]) > 0
                    low = np.full(a.stop - left, np.inf)
                    high = np.full(a.stop - left, -np.inf)
                    mine = slice(by_anchor[left], by_anchor[a.stop])
                    np.minimum.at(low, owner[mine] - left, lists.score[mine].astype(float))
                    np.maximum.at(high, owner[mine] - left, ceilings[mine].astype(float))
                    alike = label[:, None] == anchors.labels[a][None, :]
                    open_ = (alike if same else ~alike) & asked[None, :] & (row[:, None] != anchors.rows[a][None, :])
                    est, off, half = _intervals(anchors, codes, aligned, norm, a, slice(None), dense, 0.0, 0.0)
                    r, c = np.nonzero(open_ & (est + half >= low[None, :]) & (est - half <= high[None, :]))
                    if len(r) and coder.levels > first:
                        est, off, half = _intervals(anchors, codes, aligned, norm, left + c, r, range(first, coder.levels), est[r, c], off[r, c])
                        stays = (est + half >= low[c]) & (est - half <= high[c])
                        r, c = r[stays], c[stays]
                    for k in range(0, len(r), 1 << 15):
                        x, y = r[k : k + (1 << 15)], left + c[k : k + (1 << 15)]
                        score = np.einsum("ij,ij->i", ints[x].astype(np.int64), anchors.ints[y])
                        for j in range(per):
                            which = by_anchor[y] + j
                            has = which < by_anchor[y + 1]
                            which = np.minimum(which, len(owner) - 1)
                            has &= (score <= ceilings[which]) & (score >= lists.score[which])
                            if has.any():
                                lists.add(which[has], score[has], ids[x[has]], row[x[has]])
        which, score, ids, found = lists.held
        out = [pa.array(which), pa.array(score), pa.array(ids, pa.int64(), mask=ids == _LAST), pa.array(found)]
        if len(which):
            yield pa.RecordBatch.from_arrays(out, names=["list", "score", "vec_id", "row"])

    return run


def code_rows(vectors: DataFrame, is_anchor: Column, levels: int, seed: int, scale: int) -> tuple[DataFrame, Coder]:
    """The stored table of codes; columns as in ``CODED``."""
    v = F.col("embedding")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("scaled"),
    )
    facts = rows.agg(F.max(F.size("scaled")).alias("size"), F.max(F.array_max(F.transform("scaled", F.abs))).alias("most")).first()
    longest, most = facts["size"] or 0, facts["most"] or 0.0
    if most >= 1 << 31 or longest * most * most >= 1 << 62:
        raise ValueError("components too large for 64-bit integer scores")
    coder = Coder(max(64, 1 << max(0, longest - 1).bit_length()), levels, seed)

    def run(batches):
        for batch in batches:
            n, values = batch.num_rows, batch.column("scaled")
            sizes = values.value_lengths().to_numpy()
            x = np.zeros((n, coder.size), np.int64)
            x[np.repeat(np.arange(n), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.flatten().to_numpy().astype(np.int64)
            codes, aligned, norm = coder.codes(x)
            blob = lambda y: pa.array([z.tobytes() for z in y], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("vec_id"), batch.column("label"), batch.column("anchor"), blob(x.astype("<i4")), blob(codes), blob(aligned), pa.array(norm)],
                names=["row", "vec_id", "label", "anchor", "ints", "codes", "alignment", "norm"])

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    return shared.written(numbered.mapInArrow(run, CODED), "codes"), coder


def _best(found: DataFrame, most: int) -> DataFrame:
    """Tasks' lists merged: ``rank`` from 1. A list gets a few rows from each task at most."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _searched(table: DataFrame, anchors: Anchors, floors, ceilings, owner, most: int, same: bool) -> DataFrame:
    found = table.drop("anchor").mapInArrow(_search(anchors, floors, ceilings, owner, most, same), "list long, score long, vec_id long, row long")
    return _best(found, most)


def _floors(best: DataFrame, lists: int, most: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k-th best (score, id) of each list that is full, else ``least``."""
    score, ids = least.copy(), np.full(lists, _LAST)
    for r in best.filter(F.col("rank") == most).collect():  # a row for each list of the block at most
        score[r["list"]], ids[r["list"]] = r["score"], _LAST if r["vec_id"] is None else r["vec_id"]
    return score, ids


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    levels: int = 6, block: int = 2048, pilot: int = 64, seed: int = 11,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: vec_id, embedding, label (integers). Positives: the anchor's ``positives`` best other rows of its label. Negatives: the
    ``negatives`` best rows of other labels with ``low``% to ``high``% of the positive's score.
    """
    spark = vectors.sparkSession
    table, coder = code_rows(vectors, is_anchor, levels, seed, scale)
    sampled = shared.written(table.filter(F.pmod(F.xxhash64("row"), F.lit(pilot)) == 0), "pilot")
    asked = table.filter("anchor")
    blocks = max(1, -(-asked.count() // block))
    folder, any_ = shared.fresh_folder(spark, "negatives"), False
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    for k in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).orderBy("row").select("row", "vec_id", "label", "ints").collect()  # a block
        if not own:
            continue
        ints = np.frombuffer(b"".join(bytes(r["ints"]) for r in own), "<i4").reshape(len(own), -1).astype(np.int64)
        anchors = Anchors(coder, np.array([r["row"] for r in own]), np.array([r["label"] for r in own]), ints)
        owner, none = np.arange(len(own)), np.full(len(own), _LOW)
        tops = np.full(len(own), _LAST)
        near = _searched(sampled, anchors, (none, tops), tops, owner, positives, True)
        best = _searched(table, anchors, _floors(near, len(own), positives, none), tops, owner, positives, True)
        chosen = sorted((r["list"], r["rank"], r["vec_id"], r["score"]) for r in best.collect())  # ``positives`` rows an anchor
        # a negative score has an empty range
        chosen = [(a, i, s) for a, _, i, s in chosen if s >= 0]
        if not chosen:
            continue
        owner, score = np.array([a for a, _, _ in chosen]), [s for _, _, s in chosen]
        least, most = (np.array(x, np.int64) for x in ([-(-low * s // 100) for s in score], [high * s // 100 for s in score]))
        tops = np.full(len(owner), _LAST)
        near = _searched(sampled, anchors, (least, tops), most, owner, negatives, False)
        found = _searched(table, anchors, _floors(near, len(owner), negatives, least), most, owner, negatives, False)
        told = spark.createDataFrame([(n, own[a]["vec_id"], i, s) for n, (a, i, s) in enumerate(chosen)], "list long, anchor_id long, positive_id long, positive_score long")
        rows = found.join(F.broadcast(told), "list").select(  # ``positives`` rows for each anchor of the block
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        rows.write.mode("append").parquet(folder)
        any_ = True
    return spark.read.schema(schema).parquet(folder) if any_ else spark.createDataFrame([], schema)
