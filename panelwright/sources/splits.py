"""CSV records from byte splits: line breaks inside quotes, any charset that keeps ASCII bytes apart, many tasks a file.

Spark cuts a file into byte splits and gives each its lines. Whether a line starts a record depends on the quotes before it,
so a split alone cannot know. But what a split does to the reader's state is a function of two values, state at its first
line -> state after its last, and functions compose:

1. Every split reports where it ends if it starts outside quotes, and if it starts inside (two flags a split).
2. The functions are composed in file order; each split then knows its first line's state.
3. Every split cuts its own records. A record that ends in a later split is put together from its pieces, at most one head and
   one tail a split.

The separator and quote bytes never occur inside a character of UTF-8, CP932 or Shift_JIS, and splits end at line feeds, so a
record's bytes are decoded whole. Empty records are skipped, a carriage return before the line feed belongs to the line end, and the
first record of each file (in its first split) is its header. A file without line feeds is one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from panelwright.session import cut_lineage

WHOLE, TAIL, HEAD = 0, 1, 2


def ends_inside(line: bytes, inside: bool, sep: bytes = b",") -> bool:
    """Whether a quoted field is open after the line, if one was (``inside``) or none was open before it."""
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(sep, at) + 1  # a quote inside an unquoted field is a character
                if not at:
                    return False
                continue
            at += 1
        at = line.find(b'"', at)
        if at < 0:
            return True
        if line[at + 1 : at + 2] == b'"':
            inside, at = True, at + 2
            continue
        at = line.find(sep, at + 1) + 1  # whatever follows the closing quote belongs to the field
        if not at:
            return False
        inside = False


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file (hash of its path), start (of the split), raw: the lines as bytes, in order inside each split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, int]]:
    """Stretches of a batch that come from one split."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    edges = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)]):
        if b > a:
            yield (int(file[a]), int(start[a])), a, b


def split_states(lines: DataFrame) -> DataFrame:
    """file, start, inside, stays_open: whether each split starts and ends inside quotes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[int, int], list[bool]] = {}
        for batch in batches:
            raw = batch.column("raw")
            for split, a, b in _runs(batch):
                ends = told.setdefault(split, [False, True])
                for line in raw.slice(a, b - a).to_pylist():
                    if b'"' in line:  # without a quote the state stays
                        after = (ends_inside(line, False), ends_inside(line, True))
                        ends[:] = after[ends[0]], after[ends[1]]
        if told:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in told], pa.int64()) for i in (0, 1)] + [pa.array([v[i] for v in told.values()]) for i in (0, 1)],
                names=["file", "start", "from_outside", "from_inside"])

    ends = lines.mapInArrow(run, "file long, start long, from_outside boolean, from_inside boolean")
    # a split keeps the state, turns it round, or ends in one state whatever came before: what counts is the last of these
    # constants and the turns since. One row per split, so a window holds a file's splits.
    before = W.partitionBy("file").orderBy("start")
    upto = before.rowsBetween(W.unboundedPreceding, 0)
    constant = F.col("from_outside") == F.col("from_inside")
    turned = ends.withColumn("turns", F.sum((F.col("from_outside") & ~F.col("from_inside")).cast("int")).over(upto))
    known = turned.withColumn("known", F.last(F.when(constant, F.col("from_outside").cast("int") + F.col("turns")), ignorenulls=True).over(upto))
    after = known.withColumn("after", (F.coalesce("known", F.lit(0)) + F.col("turns")) % 2 == 1)
    return after.select("file", "start", F.lag("after", 1, False).over(before).alias("inside"), F.col("after").alias("stays_open"))


def _cut(encoding: str, errors: str):
    """Records of the splits; lines bring their split's first state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, head, seq, top = None, [], False, False, 0, False
        out: list[tuple] = []

        def close(kind: int) -> None:
            nonlocal seq, top
            text = b"\n".join(held)
            held.clear()
            if kind == WHOLE:
                text = text.removesuffix(b"\r")
            header = top and bool(text.strip())
            top = top and not header
            out.append((*at, seq, kind, header, text))
            seq += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            text = [b.decode(encoding, errors) if k == WHOLE else None for b, k in zip(columns[5], columns[3])]
            raw = [None if k == WHOLE else b for b, k in zip(columns[5], columns[3])]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(columns[:5], kinds)] + [pa.array(text, pa.string()), pa.array(raw, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "start", "seq", "kind", "header", "value", "piece"])

        for batch in batches:
            raw, states = batch.column("raw"), batch.column("inside")
            for split, a, b in _runs(batch):
                if split != at:
                    if held:
                        close(HEAD if head else TAIL)
                    at, seq, inside = split, 0, states[a].as_py()
                    head, top = inside, split[1] == 0
                for line in raw.slice(a, b - a).to_pylist():
                    if b'"' in line:
                        inside = ends_inside(line, inside)
                    held.append(line)
                    if not inside:
                        close(HEAD if head else WHOLE)
                        head = False
                        if len(out) >= 5000:
                            yield flush()
        if held:
            close(HEAD if head else TAIL)
        if out:
            yield flush()

    return run


def records(spark: SparkSession, path: str, encoding: str, errors: str = "strict") -> DataFrame:
    """header (is it its file's), value: the records as text, empty records included."""
    lines = split_lines(spark, path)
    states = cut_lineage(split_states(lines))
    # one row per split; a file that is split in another way later must not be read with these states
    split_anew = F.raise_error(F.lit("the files are split in another way than when they were scanned: read them anew")).cast("boolean")
    known = lines.join(F.broadcast(states.drop("stays_open")), ["file", "start"], "left").withColumn("inside", F.coalesce("inside", split_anew))
    columns = "file long, start long, seq long, kind int, header boolean, value string, piece binary"
    cut = known.select("file", "start", "inside", "raw").mapInArrow(_cut(encoding, errors), columns)
    whole = cut.filter(F.col("kind") == WHOLE).select("header", "value")
    if not states.filter("stays_open").limit(1).count():  # no record goes on in the next split, or ends with the file inside quotes
        return whole
    pieces = cut_lineage(cut.filter(F.col("kind") != WHOLE).select("file", "start", "seq", "kind", "header", "piece"))  # two a split at most
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(W.partitionBy("file").orderBy("start", "seq"))
    met = pieces.withColumn("number", number).groupBy("file", "number").agg(
        F.bool_or("header").alias("header"), F.array_sort(F.collect_list(F.struct("start", "seq", "piece"))).alias("p"))
    raw = F.aggregate(F.slice("p", 2, F.size("p")), F.col("p")[0]["piece"], lambda s, x: F.concat(s, F.lit(b"\n"), x["piece"]))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [b.removesuffix(b"\r").decode(encoding, errors) for b in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("header"), pa.array(text, pa.string())], names=["header", "value"])

    return whole.unionByName(met.select("header", raw.alias("raw")).mapInArrow(decode, "header boolean, value string"))


def read_records(spark: SparkSession, path: str, encoding: str, errors: str = "strict") -> DataFrame:
    """All columns of the CSV files as text, named by the header of the file read first."""
    found = records(spark, path, encoding, errors).filter(F.btrim("value", F.lit(" \t\r\n")) != "")
    top = found.filter("header").select("value").first()  # in the first split of its file
    if top is None:
        return spark.createDataFrame([()], StructType()).limit(0)
    options = {"escape": '"', "multiLine": "true", "lineSep": "\n"}
    names = spark.read.options(header=True, **options).csv(spark.sparkContext.parallelize([top["value"].removeprefix("\ufeff")], 1)).columns
    schema = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    return found.filter("NOT header").select(F.from_csv("value", schema, options).alias("r")).select("r.*")
