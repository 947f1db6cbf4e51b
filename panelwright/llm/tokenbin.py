"""Token ids in wavelet matrices: one compressed file per shard, documents in ascending doc_id order.

A shard's ids are stored as bit planes, highest bit first; below each plane the ids are stably parted by that bit. Packed
planes with running counts of ones answer ``access``, ``rank`` (counting) and ``select`` (occurrences) in one step per plane.

File: b"WVM1", header length (4 bytes), JSON header (ids, levels, zeros per plane, places of the sections), then
zstd-compressed sections: doc ids, NULL flags, lengths, planes. Tasks write to a name of their own and rename, so a
repeated attempt leaves one file with the same content. Files go to a folder that all executors share.

NULL text is empty (only the end id); NULL doc_ids come first; equal doc_ids are ordered by text hash; an empty table writes no file.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from panelwright.llm import shared
from panelwright.llm.bytelevel import Model
from panelwright.llm.idtable import IdTable
from panelwright.llm.words import fold_table, pieces, text_buffers
from panelwright.llm.workercache import held as worker_held

MAGIC = b"WVM1"
_BLOCK = 64  # bytes of a plane per running count


class WaveletMatrix:
    """``planes``: packed bits, most significant first; ``zeros``: zeros of each; ``ones``: ones before each block."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._ones: list[np.ndarray] | None = None

    @classmethod
    def of(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        planes, zeros = [], []
        for k in range(levels - 1, -1, -1):
            bit = (ids & ids.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(bit))
            low = ids[~bit]
            zeros.append(len(low))
            ids = np.concatenate([low, ids[bit]])
        return cls(int(len(ids)), planes, zeros)

    @property
    def levels(self) -> int:
        return len(self.planes)

    @property
    def ones(self) -> list[np.ndarray]:
        if self._ones is None:
            self._ones = []
            for p in self.planes:
                count = np.bitwise_count(np.pad(p, (0, -len(p) % _BLOCK))).reshape(-1, _BLOCK).sum(1)
                self._ones.append(np.concatenate([[0], np.cumsum(count)]))
        return self._ones

    def _rank1(self, level: int, i: int) -> int:
        plane, block = self.planes[level], i // (8 * _BLOCK)
        whole = i // 8
        n = int(self.ones[level][block]) + int(np.bitwise_count(plane[block * _BLOCK : whole]).sum())
        return n + (int(plane[whole]) >> (8 - i % 8)).bit_count() if i % 8 else n

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        lo, hi = 0, end
        for level in range(self.levels):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            if token >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of ``token`` before ``end`` (default: in the shard)."""
        if token >> self.levels:
            return 0
        lo, hi = self._range(token, self.n if end is None else end)
        return hi - lo

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th ``bit`` of a plane."""
        ones = self.ones[level]
        blocks = ones if bit else np.arange(len(ones)) * 8 * _BLOCK - ones
        block = int(np.searchsorted(blocks, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][block * _BLOCK : (block + 1) * _BLOCK])
        return block * 8 * _BLOCK + int(np.flatnonzero(bits == bit)[k - int(blocks[block])])

    def select(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of ``token``."""
        if k < 0 or k >= self.count(token):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        ids = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n).view(bool)
            above = np.empty(self.n, kind)
            z = self.zeros[level]
            above[~bit] = ids[:z]
            above[bit] = ids[z:] | kind(1 << (self.levels - 1 - level))
            ids = above
        return ids


def to_file(matrix: WaveletMatrix, doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, order: tuple[int, int]) -> bytes:
    parts = [np.ascontiguousarray(x).view(np.uint8) for x in (doc_ids.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<i8"), *matrix.planes)]
    packed = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) for p in parts]
    head = {"ids": matrix.n, "docs": len(doc_ids), "zeros": matrix.zeros, "order": order, "raw": [len(p) for p in parts], "packed": [len(p) for p in packed]}
    text = json.dumps(head).encode()
    return b"".join([MAGIC, len(text).to_bytes(4, "little"), text, *packed])


def from_file(data: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """(matrix, doc ids, NULL flags, lengths, place of the shard) of a file's bytes."""
    if bytes(data[:4]) != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(data[4:8], "little")
    head, at = json.loads(bytes(data[8 : 8 + size])), 8 + size
    parts = []
    for raw, packed in zip(head["raw"], head["packed"]):
        body = pa.decompress(data[at : at + packed], decompressed_size=raw, codec="zstd") if raw else b""
        parts.append(np.frombuffer(body, np.uint8))
        at += packed
    ids, nulls, lengths, planes = parts[0].view("<i8"), parts[1].astype(bool), parts[2].view("<i8"), parts[3:]
    return WaveletMatrix(head["ids"], planes, head["zeros"]), ids, nulls, lengths, tuple(head["order"])


class WordEncoder:
    """Token ids of texts, word by word, for tokenizers that drop white space.

    Words are hashed on the column's bytes (see ``words``) and looked up in the worker's table of ``most`` bytes. Only a word that is
    not there becomes a string: it is normalised, cut into pre-tokens by the tokenizer's own pattern, and these go through its
    model; unusual words go through the library whole.
    """

    _TABLE = fold_table(lower=False)
    _PARTS = 150_000  # pre-tokens that are kept beside the words: one word comes with several marks

    def __init__(self, path: str, most: int):
        import regex

        with open(path) as f:
            told = json.load(f)
        steps = [s["type"] for s in (told["normalizer"] or {}).get("normalizers", [])]
        cut = [s for s in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"] or cut[0]["behavior"] != "Removed" or not cut[0]["invert"]:
            raise ValueError("a tokenizer with lower-cased words and white space dropped is needed")
        self.model = Model(path)
        self.find = regex.compile(cut[0]["pattern"]["Regex"]).findall
        self.kind = np.uint16 if self.model.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.table = IdTable(most, self.kind)
        self.parts: dict[str, tuple[int, ...]] = {}
        self.same = list(range(self.model.tokenizer.get_vocab_size()))  # one object for each id

    def word(self, word: str) -> list[int]:
        if not self.model.usual(word):
            return self.model.whole(word)
        text = (word if word.isascii() else normalize("NFC", word)).lower()
        if text.isalpha():  # letters alone are one pre-token, and so is one mark after them
            cut = (text,)
        elif text[-1] in ".,;:!?" and text[:-1].isalpha():
            cut = (text[:-1], text[-1])
        else:
            cut = self.find(text)
        out: list[int] = []
        for part in cut:
            ids = self.parts.get(part)
            if ids is None:
                ids = tuple(map(self.same.__getitem__, self.model.ids(part)))
                if len(self.parts) >= self._PARTS:  # those learnt first are the frequent ones
                    self.parts = dict(islice(self.parts.items(), self._PARTS // 2))
                self.parts[part] = ids
            out += ids
        return out

    def encode(self, texts, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of rows: ids of all texts with the end id after each, and how many ids each has."""
        data, offsets = text_buffers(texts)
        for a, b, w in pieces(texts, self._TABLE):
            shift = (offsets[a:b] - offsets[a])[w.row_of()]
            table, index = self.table.look_up(w.hash, data[offsets[a] : offsets[b]].tobytes(), w.start + shift, w.end + shift, self.word)
            upto = np.concatenate([[0], np.cumsum(table.sizes(index))])
            stop = upto[w.first[1:]]
            yield np.insert(table.take(index), stop, self.kind(end)), np.diff(np.concatenate([[0], stop])) + 1


def write_tokens(docs: DataFrame, path: str, folder: str, end: int = 1, shard_bytes: int = 16 << 20, shard_ids: int = 4 << 20, table_bytes: int = 64 << 20) -> DataFrame:
    """Encode and write all documents; the manifest: part, seq, name, docs, ids of each file.

    Shards are ranges of doc_id with about ``shard_bytes`` of text; a task starts another file after ``shard_ids`` ids, which bounds what it holds.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text")).withColumn("h", F.xxhash64("text"))
    total = docs.select(F.octet_length(shared.whole_text()).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // shard_bytes))

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        encoder = worker_held(("token files", path, table_bytes), lambda: WordEncoder(path, table_bytes))
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        levels = max(1, (encoder.model.tokenizer.get_vocab_size() - 1).bit_length())
        held: list[tuple] = []

        def flush(seq: int):
            ids = np.concatenate([x[0] for x in held])
            lengths, docs_, nulls = (np.concatenate([x[i] for x in held]) for i in (1, 2, 3))
            name = f"shard-{part:06d}-{seq:04d}.wvm"
            own = f"{base}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(to_file(WaveletMatrix.of(ids, levels), docs_, nulls, lengths, (part, seq)))
            store.move(own, f"{base}/{name}")
            row = (part, seq, name, len(docs_), len(ids))
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "seq", "name", "docs", "ids"])

        seq = n = 0
        for batch in batches:
            keys = batch.column("doc_id")
            flags = np.array(keys.is_null())
            values = keys.fill_null(0).to_numpy()
            a = 0
            for ids, lengths in encoder.encode(batch.column("text"), end):
                b = a + len(lengths)
                held.append((ids, lengths, values[a:b], flags[a:b]))
                a, n = b, n + len(ids)
                if n >= shard_ids:
                    yield flush(seq)
                    seq, n = seq + 1, 0
                    held.clear()
        if held:
            yield flush(seq)

    ordered = d.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return shared.written(ordered.mapInArrow(run, "part long, seq long, name string, docs long, ids long"), "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the files."""

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                matrix, doc_ids, nulls, lengths, order = from_file(memoryview(data.as_buffer()))
                ids, ends = matrix.ids().astype("<u4"), np.cumsum(lengths)
                raw, first = memoryview(ids.tobytes()), ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist())]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64(), mask=nulls), pa.array([order[0]] * n, pa.int64()), pa.array([order[1]] * n, pa.int64()),
                     pa.array(first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "part", "seq", "local", "n_tokens", "ids_crc32"])

    if not manifest.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wvm").load(folder).select("content")
    rows = files.mapInArrow(run, "doc_id long, part long, seq long, local long, n_tokens long, ids_crc32 long")
    # one row per file: the window's single partition is bounded by the number of files
    before = F.sum("ids").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    offsets = manifest.select("part", "seq", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(offsets, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end: int = 1, folder: str | None = None) -> DataFrame:
    """Write the token files (to a new shared folder unless one is given) and read them back."""
    spark = docs.sparkSession
    folder = folder or shared.fresh_folder(spark, "tokens")
    return read_tokens(spark, folder, write_tokens(docs, path, folder, end))
