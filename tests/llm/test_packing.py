"""Packing: ids against the tokenizers library, places, and the number of sequences."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwright.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, rows, size=2048, end=0):
    out = []
    for i, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        cut = [0, *range(len(ids) - size * ((len(ids) - 1) // size), len(ids) + 1, size)]
        out += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    return sorted(out, key=str)


def checked(found, size=2048):
    """Rows without places; every sequence is gapless from 0 and no longer than ``size``."""
    rows, sequences = found.collect(), {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str), len(sequences)


def test_query_against_the_library(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got, n = checked(queries.op13_best_fit_packing(spark, sf))
    assert got == wanted(library, rows)
    assert n <= 1.02 * -(-sum(r[3] for r in got) // 2048) + 1


def test_odd_rows(spark, odd_docs, odd_rows, library):
    got, _ = checked(packing.placements(packing.pack_documents(odd_docs, PATH), 2))
    assert got == wanted(library, [(i, t) for i, t, _ in odd_rows])
    got, _ = checked(packing.placements(packing.pack_documents(odd_docs, PATH, size=7, open_bins=3, task_bytes=1000), 2), 7)
    assert got == wanted(library, [(i, t) for i, t, _ in odd_rows], size=7)


def test_empty_table(spark, no_docs):
    assert packing.pack_documents(no_docs, PATH).count() == 0


def test_same_sequences_for_any_order_of_rows(spark, odd_docs):
    rows = lambda d: sorted((bytes(r["ids"]) for r in packing.pack_documents(d, PATH, task_bytes=50_000).collect()))
    assert rows(odd_docs.repartition(3)) == rows(odd_docs.orderBy(F.desc("text")).coalesce(1))


def test_sequences_hold_their_parts(spark, odd_docs):
    wide = packing.id_bytes(PATH)
    for r in packing.pack_documents(odd_docs, PATH, size=64).collect():
        assert len(r["ids"]) == wide * sum(p["length"] for p in r["parts"])


def encoded(encoder, texts):
    return [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(pa.array(texts, pa.string()))]


def test_encoder_on_odd_white_space(library):
    rng = random.Random(3)
    alphabet = ["a", "Bc", "'s", "'", "7", "12", ".", "!?", " ", " ", " ", "\n", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "é", "日本", "<|endoftext|>", "\0", "\u0378", "Σ", "İ"]
    plain = ["a", "Bc", "don't,", "12", "x.", "é", "日本!", "ab"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(20_000)]
    texts += ["".join(rng.choice(plain) + rng.choice([" ", " ", "\n", "\n\n", "  ", ""]) for _ in range(rng.randint(1, 9))) for _ in range(20_000)]
    rng.shuffle(texts)
    encoder = packing.TextEncoder(PATH, 1 << 20)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(encoder, texts) == want
    assert encoded(encoder, [None, "", *texts[:50]]) == [[], [], *want[:50]]


def test_encoder_with_a_small_table(library):
    encoder = packing.TextEncoder(PATH, 3000)
    size = lambda: sum(x.nbytes for x in vars(encoder.table).values() if isinstance(x, np.ndarray))
    for k in range(300):
        few = [f"word{k} and word{k // 2},\nthe {k * 77} end", "the end and"]
        many = [f"{j} b{j * k}" for j in range(100)] if k % 50 == 0 else []
        assert encoded(encoder, few + many) == [library.encode(t, add_special_tokens=False).ids for t in few + many]
        assert size() <= 3000


def best_fit(lengths, size, most):
    """Bins by a plain search over all open ones."""
    open_, closed = [], []
    for n in lengths:
        fits = [b for b in open_ if sum(b) + n <= size]
        b = max(fits, key=sum) if fits else []
        if not fits:
            open_.append(b)
        b.append(n)
        if sum(b) == size or len(open_) > most:
            full = max(open_, key=sum)
            open_ = [x for x in open_ if x is not full]
            closed.append(full)
    return closed + open_


@pytest.mark.parametrize("most", [1, 4, 1000])
def test_bins_place_as_a_plain_search(most):
    rng = random.Random(most)
    lengths = [rng.randint(1, 50) for _ in range(500)]
    bins, closed = packing.Bins(50, most), []
    for n in lengths:
        if done := bins.place(n, n):
            closed.append(done)
        assert bins.open <= most
    closed += bins.rest()
    assert sorted(map(sum, closed)) == sorted(map(sum, best_fit(lengths, 50, most)))


def test_bins_near_the_best_possible():
    """Against the least number of sequences, found by trying all ways for a few pieces."""
    rng = random.Random(8)

    def least(lengths, size):
        best = len(lengths)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(lengths):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + lengths[k] <= size and bins[j] not in bins[:j]:
                    go(k + 1, bins[:j] + [bins[j] + lengths[k]] + bins[j + 1 :])
            go(k + 1, [*bins, lengths[k]])

        go(0, [])
        return best

    for _ in range(30):
        lengths = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        bins = packing.Bins(20, 100)
        n = sum(bins.place(x, x) is not None for x in lengths) + len(list(bins.rest()))
        assert n <= 11 / 9 * least(lengths, 20) + 6 / 9
