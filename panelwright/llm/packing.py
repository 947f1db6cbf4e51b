"""Pack tokenised documents into sequences by bounded-space best-fit.

1. Documents become token ids (with an end id). Only documents longer than a sequence are cut, into whole sequences; the first
   piece is the shorter one, so a document has at most one piece that needs a place beside others.
2. Pieces are dealt to tasks by a hash of their content, about ``task_bytes`` of text each, and come longest first.
3. A task packs online: each piece goes into the open bin with the least free space that holds it. Free spaces with an open bin
   are bits of one integer, so the best fit is its lowest bit from the piece's length on. At most ``open_bins`` bins are
   open; beyond that the fullest closes. Full bins close at once. Memory is the open bins' ids.

A sequence is a row: ``sequence_id``, its ``ids`` (little-endian, ``id_bytes`` each) and its ``parts`` (doc_id, piece, start, length,
offset), gapless from 0. Nothing is dropped or padded. NULL text is empty and gives the end id alone; NULL ids stay NULL; repeated rows are packed as often as they
come; the same rows give the same sequences however they are ordered. Empty tables give no sequences.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import shared
from panelwright.llm.bytelevel import Model, byte_letters
from panelwright.llm.idtable import IdTable
from panelwright.llm.tokencount import PATTERN
from panelwright.llm.words import Words, fold_table, mix, pieces, text_buffers
from panelwright.llm.workercache import held

PART = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, offset: bigint>"
_PART = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("offset", pa.int64())])
_SPACE, _LINE = 32, 10


def _code(model: Model) -> str:
    """Array type of an id."""
    return "H" if model.tokenizer.get_vocab_size() <= 1 << 16 else "I"


class TextEncoder:
    """Ids of whole texts by a byte-level tokenizer, as bytes (little-endian, 16 bits where the vocabulary allows).

    The pre-token pattern never joins text across two places: before a run of white space, and before that run's last character
    if a word follows (a last space goes with the word). So in a text whose words are parted by one space, one line break or
    two line breaks, a word with the space before it, or alone, has ids of its own; words are hashed on the column's bytes and
    looked up in a table of a fixed size, and only new ones become strings and go through the model. Other texts are cut by
    the same rule and go through the model; texts with special strings or unusual characters go through the library whole.
    """

    _WORDS = fold_table(lower=False)

    def __init__(self, path: str, most: int):
        import regex

        with open(path) as f:
            told = json.load(f)
        cut = told["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or told["normalizer"] or told["model"].get("ignore_merges"):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is needed")
        self.model = Model(path)
        self.tokenize, self.space = self.model.tokenizer.model.tokenize, byte_letters()[32]
        self.code, self.tokens = _code(self.model), regex.compile(PATTERN).findall
        self.other_space = regex.compile(r"[^\S \n]").search
        self.marks = {c: self._ids(c) for c in ".,;:!?"}
        self.line = self._ids("\n")
        self.table = IdTable(most, np.uint16 if self.code == "H" else np.uint32, [self.line])
        self.ends = {_SPACE: self._bytes(self._ids(" ")), _LINE: self._bytes(self.line)}

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _ids(self, pre_token: str) -> list[int]:
        word = pre_token[1:] if pre_token[0] == " " else pre_token
        if word.isascii() and word.isalnum():  # such letters stand for themselves; only the space has another
            return [t.id for t in self.tokenize(pre_token if word is pre_token else self.space + word)]
        return self.model.ids(pre_token)

    def chunk(self, chunk: str) -> list[int]:
        """Ids of a word, with the space before it if it has one."""
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():  # one pre-token
            return self._ids(chunk)
        if word[-1] in self.marks and word[:-1].isalpha():  # letters and one mark after them
            return self._ids(chunk[:-1]) + self.marks[word[-1]]
        return list(chain.from_iterable(map(self._ids, self.tokens(chunk))))

    def text(self, text: str) -> bytes:
        """Any text, without the table."""
        if not self.model.usual(text):
            return self._bytes(self.model.whole(text))
        return self._bytes(list(chain.from_iterable(map(self._ids, self.tokens(text)))))

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text."""
        data, offsets = text_buffers(texts)
        for a, b, w in pieces(texts, self._WORDS):
            strings = texts.slice(a, b - a).to_pylist()
            at = offsets[a:b] - offsets[a]
            yield from self._run(strings, data[offsets[a] : offsets[b]], at, np.diff(offsets[a : b + 1]), w)

    def _run(self, strings: list, data: np.ndarray, at: np.ndarray, length: np.ndarray, w: Words) -> Iterator[bytes]:
        rows = len(strings)
        usual = [x is not None and self.model.usual(x) and (x.isascii() or not self.other_space(x)) for x in strings]
        row = w.row_of()
        start, end = w.start + at[row], w.end + at[row]
        before = np.concatenate([[0], end[:-1]])[: len(end)]
        has = np.diff(w.first) > 0
        before[w.first[:-1][has]] = at[has]
        gap = start - before
        last, first = (data[np.minimum(x, len(data) - 1)] if len(data) else data for x in (np.maximum(start - 1, 0), before))
        spaced, lines = (gap == 1) & (last == _SPACE), (last == _LINE) & (first == _LINE) & (gap >= 1) & (gap <= 2)
        plain = np.array(usual, bool) & (has | (length == 0))
        plain[row[~(spaced | lines | (gap == 0))]] = False
        tail = np.zeros(rows, np.int64)
        stop = w.first[1:][has] - 1
        tail[has] = at[has] + length[has] - end[stop]
        closing = data[np.minimum(at + length - 1, len(data) - 1)] if len(data) else np.zeros(rows, np.uint8)
        plain &= (tail == 0) | (tail == 1) & ((closing == _SPACE) | (closing == _LINE))
        taken = plain[row]
        row, start, end, spaced, breaks = row[taken], start[taken], end[taken], spaced[taken], np.where(lines, gap, 0)[taken]
        h = np.where(spaced, mix(w.hash[taken], 991), w.hash[taken])
        table, index = self.table.look_up(h, data.tobytes(), start - spaced, end, self.chunk)
        where = np.cumsum(1 + breaks) - 1
        entries = np.zeros(int(where[-1]) + 1 if len(where) else 0, np.int64)  # entry 0: a line break
        entries[where] = index
        upto = np.concatenate([[0], np.cumsum(table.sizes(entries))])
        ids = table.take(entries)
        after = np.concatenate([[0], where + 1])[np.searchsorted(row, np.arange(rows + 1))]  # entries before each row
        cut = upto[after]
        for k in range(rows):
            if not plain[k]:
                yield self.text(strings[k] or "")
                continue
            own = ids[cut[k] : cut[k + 1]].tobytes()
            yield own + self.ends[int(closing[k])] if tail[k] else own


def id_bytes(path: str) -> int:
    """Bytes of an id in sequences of this tokenizer."""
    return array(_code(Model(path))).itemsize


def token_pieces(docs: DataFrame, path: str, size: int, end: int, table_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, see ``id_bytes``): documents cut only if they are longer than ``size`` tokens."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("packing", path, table_bytes), lambda: TextEncoder(path, table_bytes))
        last, wide = array(encoder.code, [end]).tobytes(), array(encoder.code).itemsize
        rows: list[tuple] = []

        def flush():
            out = list(zip(*rows))
            rows.clear()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "piece", "start", "length", "ids"])

        size_held = 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text"))):
                ids += last
                n = len(ids) // wide
                ends = [n - size * k for k in range(-(-n // size))][::-1]  # the first piece takes what whole ones leave
                start = 0
                for piece, stop in enumerate(ends):
                    rows.append((doc, piece, start, stop - start, ids[wide * start : wide * stop]))
                    start = stop
                size_held += len(ids)
                if size_held > 4 << 20:
                    yield flush()
                    size_held = 0
        if rows:
            yield flush()

    return d.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


class Bins:
    """Open bins by free space: a bitset of the spaces that have one, and a stack for each."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.bits = size, most, 0, 0
        self.by_space: dict[int, list] = {}

    def _put(self, space: int, content: list) -> None:
        self.by_space.setdefault(space, []).append(content)
        self.bits |= 1 << space
        self.open += 1

    def _take(self, space: int) -> list:
        stack = self.by_space[space]
        content = stack.pop()
        if not stack:
            self.bits ^= 1 << space
        self.open -= 1
        return content

    def place(self, length: int, item) -> list | None:
        """Put the item into its best bin; a bin that closes is returned."""
        fits = self.bits >> length
        space = length + (fits & -fits).bit_length() - 1 if fits else self.size
        content = self._take(space) if fits else []
        content.append(item)
        if space == length:
            return content
        self._put(space - length, content)
        if self.open > self.most:
            return self._take((self.bits & -self.bits).bit_length() - 1)
        return None

    def rest(self) -> Iterator[list]:
        while self.bits:
            yield self._take((self.bits & -self.bits).bit_length() - 1)


def pack(pieces: DataFrame, size: int, tasks: int, open_bins: int = 4096) -> DataFrame:
    """sequence_id, ids (binary), parts: pieces packed into sequences of at most ``size`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins, base, count = Bins(size, open_bins), TaskContext.get().partitionId() << 32, 0
        done: list[list] = []

        def flush():
            nonlocal count
            parts, ids = [], []
            for content in done:
                offset, told = 0, []
                for doc, piece, start, length, _ in content:
                    told.append({"doc_id": doc, "piece": piece, "start": start, "length": length, "offset": offset})
                    offset += length
                parts.append(told)
                ids.append(b"".join(x[4] for x in content))
            numbers = range(base + count, base + count + len(done))
            count += len(done)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, pa.binary()), pa.array(parts, pa.list_(_PART))], names=["sequence_id", "ids", "parts"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids")]):
                if closed := bins.place(row[3], row):
                    done.append(closed)
                    if len(done) == 512:
                        yield flush()
        for closed in bins.rest():
            done.append(closed)
            if len(done) == 512:
                yield flush()
        if done:
            yield flush()

    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids")).sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids")
    return dealt.mapInArrow(run, f"sequence_id long, ids binary, parts array<{PART}>")


def pack_documents(docs: DataFrame, path: str, size: int = 2048, end: int = 0, open_bins: int = 4096, task_bytes: int = 32 << 20) -> DataFrame:
    """The packed sequences of all documents, as a stored table."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(shared.whole_text())), F.lit(0)).alias("n")).first()["n"]
    return shared.written(pack(token_pieces(docs, path, size, end), size, max(1, -(-int(total) // task_bytes)), open_bins), "sequences")


def placements(sequences: DataFrame, wide: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row for each part; the checksum of its ids as 32-bit numbers,
    taken from the sequence. ``wide``: bytes of an id (see ``id_bytes``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            owner, flat = pc.list_parent_indices(parts).to_numpy(), parts.flatten()
            columns = {c: flat.field(c) for c in ("doc_id", "piece", "start", "length", "offset")}
            crc, at, ids = [], -1, memoryview(b"")
            for k, a, n in zip(owner.tolist(), columns["offset"].to_pylist(), columns["length"].to_pylist()):
                if k != at:
                    at, ids = k, memoryview(np.frombuffer(batch.column("ids")[k].as_buffer(), f"<u{wide}").astype("<u4").tobytes())
                crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [columns["doc_id"], columns["piece"], columns["start"], columns["length"], pa.array(crc, pa.int64()), batch.column("sequence_id").take(pa.array(owner)), columns["offset"]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return sequences.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
