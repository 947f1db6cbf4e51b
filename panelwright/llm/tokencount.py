"""Token counts by two tiers of pre-token lengths, without moving any pre-token between tasks.

A byte-level BPE tokenizer cuts a text into pre-tokens and merges each on its own, so a text's tokens are the sum over its
pre-tokens. Tier one is a broadcast table of frequent pre-tokens (at most ``table_size`` entries, taken from a bounded
sample of ``sample`` documents: it only affects speed). Tier two is each worker's own cache of at most ``cache`` pre-tokens; what both miss is encoded
by the tokenizer itself. Texts with special strings, or with characters whose Unicode class the two regular-expression
engines may see differently, are encoded whole by the library.

NULL text is empty and has no tokens; empty tables give no rows.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import shared
from panelwright.llm.bytelevel import Model

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_workers: dict[tuple, Counting] = {}


def pack(lengths: dict[str, int]) -> bytes:
    """A table of pre-token lengths in few bytes: one byte a length, then the NUL-joined tokens."""
    short = {t: n for t, n in lengths.items() if n < 256 and "\0" not in t}
    return len(short).to_bytes(4, "little") + zlib.compress(bytes(short.values()) + "\0".join(short).encode())


def unpack(data: bytes) -> dict[str, int]:
    n = int.from_bytes(data[:4], "little")
    if not n:
        return {}
    raw = zlib.decompress(data[4:])
    return dict(zip(raw[n:].decode().split("\0"), raw[:n]))


class Counting:
    """A worker's tokenizer, its tables and its cache."""

    def __init__(self, path: str, table: bytes, cache: int):
        import regex

        with open(path) as f:
            told = json.load(f)
        cut = told["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or told["normalizer"] or told["model"].get("ignore_merges"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.model, self.find = Model(path), regex.compile(PATTERN).findall
        self.frequent, self.cache, self.most = unpack(table), {}, cache

    def pre_tokens(self, text: str) -> list[str] | None:
        """None: the text has to be encoded whole."""
        return self.find(text) if self.model.usual(text) else None

    def counts(self, texts: list[str]) -> list[int]:
        out: list = [0] * len(texts)
        missed: dict[str, int] = {}
        again: list[tuple[int, list[str]]] = []
        first, second = self.frequent.get, self.cache.get
        for k, text in enumerate(texts):
            tokens = self.pre_tokens(text)
            if tokens is None:
                out[k] = len(self.model.whole(text))
                continue
            known = list(map(first, tokens))
            rest = [t for t, n in zip(tokens, known) if n is None]
            total = sum(filter(None, known))
            if rest:
                later = list(map(second, rest))
                total += sum(filter(None, later))
                unknown = [t for t, n in zip(rest, later) if n is None]
                if unknown:
                    missed.update(dict.fromkeys(unknown, 0))
                    again.append((k, unknown))
            out[k] = total
        if missed:
            for t in missed:
                missed[t] = len(self.model.ids(t))
            for k, unknown in again:
                out[k] += sum(map(missed.__getitem__, unknown))
            if len(self.cache) + len(missed) > self.most:  # the older half goes
                for t in list(self.cache)[: len(self.cache) // 2 + 1]:
                    del self.cache[t]
            if len(self.cache) + len(missed) <= self.most:
                self.cache.update(missed)
        return out


def _worker(path: str, table: bytes, cache: int) -> Counting:
    key = (path, zlib.crc32(table), cache)
    if key not in _workers:
        _workers.clear()
        _workers[key] = Counting(path, table, cache)
    return _workers[key]


def frequent_table(docs: DataFrame, path: str, table_size: int, sample: int, seed: int = 5) -> bytes:
    """Packed lengths of the most frequent pre-tokens of a bounded sample of documents."""
    n = docs.count()
    texts = docs.select(shared.whole_text().alias("text"))
    if n > sample:
        texts = texts.sample(fraction=sample / n, seed=seed)

    def run(batches):
        worker, seen = _worker(path, b"", 1), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(worker.pre_tokens(text) or ())
        top = seen.most_common(table_size)
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["token", "n"])

    total: Counter = Counter()
    for row in texts.mapInArrow(run, "token string, n long").toLocalIterator():
        total[row["token"]] += row["n"]
    tokens = [t for t, _ in total.most_common(table_size)]
    model = Model(path)
    return pack({t: len(model.ids(t)) for t in tokens})


def token_counts(docs: DataFrame, path: str, limit: int = 1024, table_size: int = 1 << 16, sample: int = 5_000, cache: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""
    held = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, path, table_size, sample))

    def run(batches):
        worker = _worker(path, held.value, cache)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts: list[int] = []
            for a in range(0, len(texts), 500):
                counts += worker.counts(texts[a : a + 500])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = d.select("doc_id", "n_bytes", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
