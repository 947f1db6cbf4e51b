"""Distributed sums of small vectors computed from Arrow batches.

A kernel sees the batches of one partition, keeps a fixed-size accumulator per
key and emits it once; Spark adds the partials. What reaches the driver has
the size of the accumulators, never of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.storagelevel import StorageLevel

from panelwright.session import cut_lineage

SCHEMA = "k int, pos int, val double"
BLOCK_ROWS = 8192


class Columns:
    """Numpy view of an Arrow batch; missing doubles read as NaN."""

    def __init__(self, batch: pa.RecordBatch):
        self.batch = batch

    def __len__(self) -> int:
        return self.batch.num_rows

    def __getitem__(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)

    def matrix(self, names: Sequence[str]) -> np.ndarray:
        """Columns side by side, each contiguous in memory."""
        out = np.empty((len(self), len(names)), order="F")
        for i, name in enumerate(names):
            out[:, i] = self[name]
        return out


class Block(Columns):
    """The same view of a stored block; reads are free of copies."""

    def __init__(self, rows: int, data: bytes, place: dict[str, int], whole: frozenset[str]):
        self.rows, self.place, self.whole = rows, place, whole
        self.values = np.frombuffer(data, dtype=float).reshape(len(place), rows)

    def __len__(self) -> int:
        return self.rows

    def __getitem__(self, name: str) -> np.ndarray:
        v = self.values[self.place[name]]
        return v.view(np.int64) if name in self.whole else v

    def matrix(self, names: Sequence[str]) -> np.ndarray:
        at = [self.place[n] for n in names]
        if at == list(range(at[0], at[0] + len(at))) and not self.whole.intersection(names):
            return self.values[at[0] : at[0] + len(at)].T
        return super().matrix(names)


@dataclass
class BlockFrame:
    """Rows of numeric columns packed column by column into binary blocks.

    Passes over many columns spend most of their time handing single values to
    Python; a block crosses as one value. Lost blocks are recomputed from
    lineage.
    """

    df: DataFrame
    names: list[str]
    whole: frozenset[str]

    def unpersist(self) -> None:
        self.df.unpersist()

    def _parts(self, batch: pa.RecordBatch) -> Iterator[Block]:
        place = {n: i for i, n in enumerate(self.names)}
        for n, raw in zip(batch.column(0), batch.column(1)):
            yield Block(n.as_py(), raw.as_buffer(), place, self.whole)

    def settled(self, change: Callable[[Block], dict[str, np.ndarray]]) -> BlockFrame:
        """The blocks with the columns that ``change`` gives in place of the old ones, in a reliable checkpoint."""
        shape = BlockFrame(None, self.names, self.whole)  # tasks get no frame

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in shape._parts(batch):
                    values = part.values.copy()
                    for name, column in change(part).items():
                        values[part.place[name]] = column
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)], type=pa.int32()), pa.array([values.tobytes()])], names=["n", "data"])

        after = BlockFrame(cut_lineage(self.df.mapInArrow(run, "n int, data binary")), self.names, self.whole)
        self.unpersist()
        return after

    def rows(self, names: Sequence[str]) -> DataFrame:
        """The named columns, unpacked."""
        shape = BlockFrame(None, self.names, self.whole)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in shape._parts(batch):
                    yield pa.RecordBatch.from_arrays([pa.array(part[n]) for n in names], names=list(names))

        return self.df.mapInArrow(run, ", ".join(f"{n} {'bigint' if n in self.whole else 'double'}" for n in names))


def keep_blocks(df: DataFrame) -> BlockFrame:
    """Pack a frame of doubles (NULL becomes NaN) and non-null integers, cached."""
    names = df.columns
    whole = frozenset(n for n, t in df.dtypes if t != "double")
    cast = df.select(*[F.col(n) if n not in whole else F.col(n).cast("bigint").alias(n) for n in names])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = Columns(batch.slice(start, BLOCK_ROWS))
                out = np.empty((len(names), len(part)))
                for i, n in enumerate(names):
                    if n in whole:
                        out[i].view(np.int64)[:] = part[n]
                    else:
                        out[i] = part[n]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], type=pa.int32()), pa.array([out.tobytes()])], names=["n", "data"])

    return BlockFrame(keep_for_passes(cast.mapInArrow(pack, "n int, data binary")), names, whole)


def vector_sums(
    data: DataFrame | BlockFrame, widths: list[int], accumulate: Callable[[Columns, list[np.ndarray]], None]
) -> list[np.ndarray]:
    """Add up ``accumulate(batch, accumulators)`` over all batches.

    ``widths[k]`` is the length of accumulator ``k``.
    """
    blocked = isinstance(data, BlockFrame)
    df = data.df if blocked else data
    place = {n: i for i, n in enumerate(data.names)} if blocked else {}
    whole = data.whole if blocked else frozenset()

    def parts(batch: pa.RecordBatch) -> Iterator[Columns]:
        if not blocked:
            yield Columns(batch)
            return
        for n, raw in zip(batch.column(0), batch.column(1)):
            yield Block(n.as_py(), raw.as_buffer(), place, whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [np.zeros(w) for w in widths]
        seen = False
        for batch in batches:
            for part in parts(batch):
                if len(part):
                    seen = True
                    accumulate(part, acc)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(widths), dtype="int32"), widths)),
                    pa.array(np.concatenate([np.arange(w, dtype="int32") for w in widths])),
                    pa.array(np.concatenate(acc)),
                ],
                names=["k", "pos", "val"],
            )

    # a task emits one partial per key and position; they are combined per position, over the session's shuffle partitions
    added = df.mapInArrow(run, SCHEMA).groupBy("k", "pos").agg(F.sum("val").alias("val")).toPandas()
    out = [np.zeros(w) for w in widths]
    for k, part in added.groupby("k"):
        out[int(k)][part["pos"].to_numpy()] = part["val"].to_numpy(dtype=float)
    return out


def keep_for_passes(df: DataFrame) -> DataFrame:
    """Cache a narrow frame that several passes read, in the partitions it has. Lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
