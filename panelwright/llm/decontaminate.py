"""Benchmark passages in documents: keys of CGK walks over windows that edits must leave whole, exact edit verification.

Words (lower-cased ASCII, punctuation and white space as separators) are the letters. At most ``k = (1 - least) * n`` edits cut an
item of n words into k + 1 runs, of which the longest keeps at least ``(n - k) / (k + 1)`` words without an edit. An item's windows are no
longer than that run and start at every word, in items and documents alike, so every copy within k edits has a window with the
item's own letters: no length of item and no place of the edits loses one.

A window's key is what a CGK walk reads: at each of 3w steps a random bit of the letter just read decides whether it moves on. Equal
windows have equal keys. Every hit is verified: an item word that the place lacks costs an edit, then the edit distance
between the item and the best stretch around the hit, at most k.

The benchmark goes to the tasks in blocks of at most ``block`` items' words; more items mean more passes, not a larger broadcast.
NULL or empty texts and items match nothing; an item of one word matches that word; repeated rows are reported each; empty tables give no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import shared
from panelwright.llm.workercache import held as worker_held
from panelwright.llm.words import PUNCTUATION, U, WHITE, fold_table, mix, pieces

_TABLE = fold_table(WHITE + PUNCTUATION)
_CHUNK = 1 << 15
#: Bits of a key that a first look takes.
_NEAR = 21
#: Words of the windows that are used; few sizes mean few walks over a document.
SIZES = (1, 2, 3, 4, 8, 16)


def most_edits(n: int, least: float) -> int:
    return int((1 - least) * n + 1e-9)


def window_size(n: int, least: float = 0.8) -> int:
    """Largest of ``SIZES`` within the run of words that any allowed edits leave whole; 0 for an item without words."""
    k = most_edits(n, least)
    whole = -(-(n - k) // (k + 1))
    return max((w for w in SIZES if w <= whole), default=0) if n else 0


class Sampler:
    """Keys of windows of one size: the letters that a CGK walk reads."""

    def __init__(self, w: int, seed: int):
        self.w, self.seed = w, seed

    def keys(self, letters: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Key of each window; a walk never leaves its window."""
        steps = 3 * self.w
        coins = [mix(letters, 1000 + 100 * self.seed + k) for k in range((steps - 1) // 64 + 1)]
        out = np.empty(len(start), U)
        for a in range(0, len(start), _CHUNK):
            i = start[a : a + _CHUNK].astype(np.int64)
            end = i + (self.w - 1)
            key = np.full(len(i), self.w, U)
            for step in range(steps):
                key = (key ^ letters.take(i)) * U(0x9FB21C651E98DF25)
                key ^= key >> U(29)
                i += ((coins[step // 64].take(i) >> U(step % 64)) & U(1)).view(np.int64)
                np.minimum(i, end, out=i)
            out[a : a + _CHUNK] = key
        return out


def edit_place(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int]:
    """(smallest edit distance of the item to any stretch of ``text``, end of the first such stretch); ``most + 1`` if above."""
    m = len(text)
    place = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)  # a stretch may start anywhere
    for k, letter in enumerate(item, 1):
        new = np.empty(m + 1, np.int64)
        new[0] = k
        new[1:] = np.minimum(row[:-1] + (text != letter), row[1:] + 1)
        row = np.minimum.accumulate(new - place) + place  # a letter of the text left out
        if row.min() > most:
            return most + 1, 0
    return int(row.min()), int(row.argmin())


class Index:
    """Key tables of one block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray]], least: float, seed: int):
        self.items, self.least = items, least
        self.words = [set(letters.tolist()) for _, letters in items]
        self.sizes: dict[int, Sampler] = {}
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by: dict[int, list[int]] = {}
        for k, (_, letters) in enumerate(items):
            if w := window_size(len(letters), least):
                by.setdefault(w, []).append(k)
        for w, members in by.items():
            sampler = self.sizes[w] = Sampler(w, seed)
            owner = np.concatenate([np.full(len(items[k][1]) - w + 1, k) for k in members])
            offset = np.concatenate([np.arange(len(items[k][1]) - w + 1) for k in members])
            flat = np.concatenate([items[k][1] for k in members])
            base = np.concatenate([[0], np.cumsum([len(items[k][1]) for k in members])])
            start = np.concatenate([b + np.arange(len(items[k][1]) - w + 1) for b, k in zip(base, members)])
            key = sampler.keys(flat, start)
            order = np.argsort(key, kind="stable")
            near = np.zeros(1 << _NEAR, bool)
            near[(key >> U(64 - _NEAR)).astype(np.int64)] = True
            self.tables[w] = (key[order], owner[order], offset[order], near)

    def hits(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (row, item, place where the item would start in ``letters``) of all key matches."""
        found = []
        n = np.diff(first)
        for w, sampler in self.sizes.items():
            count = np.maximum(0, n - w + 1)
            row = np.repeat(np.arange(len(n)), count)
            if not len(row):
                continue
            start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            key = sampler.keys(letters, start)
            keys, owner, offset, near = self.tables[w]
            at = np.flatnonzero(near[(key >> U(64 - _NEAR)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            many = hi - lo
            if many.any():
                place = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                at = np.repeat(at, many)
                found.append(np.stack([row[at], owner[place], start[at] - offset[place]]))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)

    def matches(self, letters: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, edit distance, first word of the passage) for each row and item that match."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for row, k, place in self.hits(letters, first).T.tolist():
            item = self.items[k][1]
            n, most = len(item), most_edits(len(item), self.least)
            key = (row, k)
            if best.get(key, (1, 0))[0] == 0 or place - tried.get(key, -(10**9)) <= most // 2:
                continue  # found exactly, or looked at the same stretch before
            if place >= first[row] and place + n <= first[row + 1] and np.array_equal(letters[place : place + n], item):
                best[key] = (0, place - int(first[row]))
                continue
            tried[key] = place
            lo, hi = max(int(first[row]), place - 2 * most - 1), min(int(first[row + 1]), place + n + 2 * most + 1)
            if len(self.words[k].difference(letters[lo:hi].tolist())) > most:
                continue
            distance, end = edit_place(item, letters[lo:hi], most)
            if distance <= most and distance < best.get(key, (most + 1, 0))[0]:
                best[key] = (distance, max(0, lo + end - n - int(first[row])))
        for (row, k), (distance, place) in best.items():
            yield row, k, distance, place


def item_letters(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, w in pieces(pa.array(texts, pa.string()), _TABLE):
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Distinct items in blocks of at most about ``block`` words, fetched one block after the other."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        letters = item_letters([row["text"]])
        if letters and len(letters[0]):
            held.append((row["item_id"], letters[0]))
            size += len(letters[0])
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, least: float = 0.8, block: int = 200_000, seed: int = 17,
) -> DataFrame:
    """doc_id, key, item_id, distance (edits in words), similarity, first_word: one row for each document and item that match."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text")).withColumn("key", shared.row_key("doc_id", "text"))
    spark, schema = docs.sparkSession, "doc_id long, key long, item_id long, distance int, similarity double, first_word long"
    names = [c.split()[0] for c in schema.split(", ")]

    def search(held, token):
        def run(batches):
            index = worker_held(("leaks", token), lambda: Index(held.value, least, seed))
            for batch in batches:
                rows = []
                for a, _, w in pieces(batch.column("text"), _TABLE):
                    for row, k, distance, place in index.matches(w.hash, w.first):
                        rows.append((a + row, index.items[k][0], distance, 1 - distance / len(index.items[k][1]), place))
                if rows:
                    at = pa.array([r[0] for r in rows])
                    cols = [batch.column("doc_id").take(at), batch.column("key").take(at), *[pa.array([r[i] for r in rows], t) for i, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.float64()), (4, pa.int64()))]]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        return run

    parts = [d.mapInArrow(search(spark.sparkContext.broadcast(items), uuid.uuid4().hex), schema) for items in _blocks(benchmark, block)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema)


def drop_leaked(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents without any benchmark passage, with all their columns (clashing names too)."""
    bad = shared.written(find_leaks(docs, benchmark, least).select(F.col("key").alias("__leak")).distinct(), "leaks")
    key = F.xxhash64(F.col("doc_id").cast("long"), shared.whole_text())
    return docs.withColumn("__leak", key).join(bad, "__leak", "left_anti").drop("__leak")
