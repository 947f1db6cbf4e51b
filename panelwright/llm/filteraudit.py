"""How a chain of filters interacts, for every order of its filters, from one walk over their subsets.

1. Each document gets a *mask* of the filters it fails; documents are counted by (part, mask), at most 2^n cells a part, so no
   document is looked at twice however many orders are asked for.
2. Per part, the subsets of filters are visited in Gray-code order: one filter is toggled at a time. Every cell keeps the number
   of active filters it fails, and the running survivors change by the cells whose number becomes or leaves zero. The 2^n states
   (documents, good and toxic ones left) are stored.
3. A step of an order is the difference of two stored states: those of its prefix without and with the step's filter.

The "same text as a smaller id" filter needs no join of copies: documents are counted by (text hash, part, ...), first by id as
well, and a text's rows with its smallest id are the ones that pass. Texts are compared by their SHA-256. A NULL id has no
smaller id and is none; if all ids of a text are NULL, all its rows pass. NULL text is empty, NULL part is the empty
string. Repeated rows (equal id and text) are documents of their own, alike in every filter. Several label rows of an id:
one that says 1 counts. Documents without a label row, or with a NULL id, are neither good nor toxic. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm import shared

STATE = ("n", "good", "toxic")


def text_filters(text: Column, words: Column) -> list[Column]:
    """Failure conditions A to D on a text and its words (neither NULL)."""
    small = F.length(F.regexp_replace(text, "[A-Z]+", ""))
    count = F.size(words)
    return [count < 200, 100 * F.size(F.array_distinct(words)) < 50 * count, 100 * (F.length(text) - small) > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def masked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit k: fails filter k of ABCDE), n, good, toxic: the cells of all documents."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), shared.whole_text().alias("text"))
    bare = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    d = d.withColumn("words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \x09-\x0D]+")))
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_filters(F.col("text"), F.col("words")))]
    d = d.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("hash"), reduce(Column.__add__, bits).alias("own"))
    by_id = d.groupBy("doc_id", "hash", "part", "own").agg(F.count("*").alias("n"))
    flags = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality"), F.col("toxic")).filter("id IS NOT NULL")
    flags = flags.groupBy("id").agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(f"is_{c}") for c in ("quality", "toxic")], F.lit(0).cast("long").alias("spread"))
    # NULL ids match no label: their rows are dealt by text, not all to one task
    keyed = by_id.withColumn("id", F.coalesce("doc_id", F.lit(0))).withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("hash").bitwiseOR(F.lit(1))).otherwise(F.lit(0)))
    keyed = keyed.join(flags, ["id", "spread"], "left").select("doc_id", "hash", "part", "own", "n", *[F.coalesce(f"is_{c}", F.lit(0)).alias(c) for c in ("quality", "toxic")])
    # at most 4 rows for each (text, part): all copies of a text meet as counts
    first = F.min_by("n", F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max).cast("long")))
    copies = keyed.groupBy("hash", "part", "own", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), first.alias("at_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    least = F.min("least").over(Window.partitionBy("hash"))
    passes = F.col("unnamed") + F.when(F.col("least") == F.col("of_text"), F.col("at_least")).otherwise(0)
    copies = copies.withColumn("of_text", least).withColumn("passes", passes)
    rows = copies.select("part", "quality", "toxic", F.explode(F.array(
        F.struct(F.col("own").alias("mask"), F.col("passes").alias("n")), F.struct((F.col("own") + 16).alias("mask"), (F.col("n") - F.col("passes")).alias("n")))).alias("c"))
    return rows.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("quality")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def gray_walk(cells: np.ndarray, filters: int) -> np.ndarray:
    """States [part, subset, value] from cells [part, mask, value]: what every subset of the filters leaves."""
    masks = np.arange(1 << filters)
    failed = np.zeros(1 << filters, np.int64)  # active filters that each cell fails
    left = cells.sum(1)
    states = np.empty_like(cells)
    subset = 0
    states[:, subset] = left
    for step in range(1, 1 << filters):
        toggled = (step & -step).bit_length() - 1
        subset ^= 1 << toggled
        hit = (masks >> toggled & 1).astype(bool)
        if subset >> toggled & 1:
            left = left - cells[:, hit & (failed == 0)].sum(1)
            failed[hit] += 1
        else:
            failed[hit] -= 1
            left = left + cells[:, hit & (failed == 0)].sum(1)
        states[:, subset] = left
    return states


def step_rows(states: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """All orders and steps of all parts, from differences of states; arrays [part, order * step]."""
    n, whole = len(names), (1 << len(names)) - 1
    orders = list(permutations(range(n)))
    filt = np.array(orders).ravel()
    after = np.array([np.bitwise_or.accumulate([1 << f for f in o]) for o in orders]).ravel()
    before = after ^ (1 << filt)
    kept, gone = states[:, after, 0], states[:, before] - states[:, after]
    fails = states[:, [0], 0] - states[:, 1 << np.arange(n), 0]  # each filter alone
    only = states[:, whole ^ (1 << np.arange(n)), 0] - states[:, [whole], 0]
    shapley = np.stack([gone[:, filt == f, 0].sum(1) for f in range(n)], 1)
    return {
        "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], n), "step": np.tile(np.arange(1, n + 1), len(orders)),
        "kept": kept, "removed": gone[:, :, 0], "redundant": fails[:, filt] - gone[:, :, 0], "unique_fails": only[:, filt],
        "good_lost": gone[:, :, 1], "toxic_lost": gone[:, :, 2], "shapley": shapley[:, filt],
    }


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(cells: DataFrame, names: str = "ABCDE") -> DataFrame:
    """A row for each part, order of the filters and step, from the cells (part, mask, n, good, toxic)."""
    size = 1 << len(names)
    columns = [F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).cast("long").alias(f"{c}{m}") for m in range(size) for c in STATE]
    wide = cells.groupBy("part").agg(F.array(*columns).alias("cells"))  # one array a part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                told = step_rows(gray_walk(part.column("cells").flatten().to_numpy().reshape(part.num_rows, size, len(STATE)), len(names)), names)
                per = len(told["step"])
                parts = part.column("part").take(pa.array(np.repeat(np.arange(part.num_rows), per)))
                orders, steps = np.tile(told["filter_order"], part.num_rows), np.tile(told["step"], part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [parts, pa.array(orders, pa.string()), pa.array(steps, pa.int32()), *[pa.array(told[c].ravel(), pa.int64()) for c in _COUNTS]],
                    names=["part", "filter_order", "step", *_COUNTS])

    return wide.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))
