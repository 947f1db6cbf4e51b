"""Exact n-gram Jaccard self-join with signature trees; the links' connected components.

Documents become sets of distinct word shingles; two link when ``den * |intersection| >= num * |union|`` (similarity
``num / den``). Documents without words have an empty set and link with nothing.

1. *Classes*: equal sets are one class (128-bit set fingerprint), so exact copies cost one row per task.
2. *Partitioning of the trees*: a set of size up to r differs from a linked one in at most
   D = 2r(den - num) / (den + num) shingles. Split by hash into m > D slices, two linked sets agree on m - D of them; by the
   prefix principle the first D + 1 slices of each, in any order of slice contents, then have one in common. The order is
   fewest common shingles first (counted over all documents in runs, the most frequent kept), so that a passage that many
   documents share does not bring them together; it decides the cost, never the result. Slice signatures are ordered over the cluster by (signature, class), so even a signature that a third of all documents
   share is cut over tasks; equal neighbours are chained, and the chains' components are the *candidate groups*.
3. *Signature trees*: the members of a group (or blocks of a large one, each pair of blocks a task) form a tree whose nodes
   hold the OR of their members' shingle bitmaps and their size range. A dual traversal drops node pairs whose largest
   possible overlap cannot reach the threshold, and pairs that are already one component. What is left is verified on
   the sets. Verified links span the components.

Nulls and repeats: NULL text is empty, NULL doc_id is kept as a row, repeated rows are copies. Empty tables give no rows.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from panelwright.llm import shared
from panelwright.llm.words import U, distinct_in_rows, fold_table, mix, pieces, shingles, sums_in_rows

#: Growth of the size classes that fix the number of slices.
_STEP = 1.3
#: Signatures that linked sets must have in common, at most (a signature's low bits hold one less); longest run of equal ones dealt as pairs.
_SHARED, _PAIRED = 8, 8
#: Arrow batches of signatures taken at once, and pairs that a task sums before it hands them on.
_BATCHES, _HELD_PAIRS = 32, 1 << 18
#: Tree: bits of a bitmap per shingle of a mean set, most 64-bit words of one, children of a node, words of bitmaps compared at once.
_BITS, _BITMAP_WORDS, _FAN, _AT_ONCE = 32, 1024, 4, 1 << 20


def size_levels(largest: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of the size classes, and the differences a linked pair can have whose larger set is in each."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, int(low[-1] * _STEP)))
    low = np.array(low, np.int64)
    return low, 2 * (np.append(low[1:], int(low[-1] * _STEP) + 1) - 1) * (den - num) // (den + num)


def slices_of(most: int) -> tuple[int, int]:
    """Slices of sets that differ in ``most`` shingles, and how many of the first signatures linked ones have in common."""
    m = -(-(most + 1) * 13 // 10)  # some to spare: thin slices, which unlike sets share by chance, come last
    return m, 1 + min(_SHARED - 1, (m - most - 1) // 8)


def slice_signatures(s: np.ndarray, num: int, den: int, common: np.ndarray) -> np.ndarray:
    """Signatures of one sorted set: its own size class, and larger classes that a linked larger set can be in.

    A signature's low bits hold how many of its class linked sets have in common, less one.
    """
    n = len(s)
    low, differ = size_levels(n * den // num + 1, num, den)
    own, last = np.searchsorted(low, n, "right") - 1, np.searchsorted(low, n * den // num, "right") - 1
    rare = np.ones(n, bool)
    if len(common):
        rare = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] != s
    rares = np.concatenate([[0], np.cumsum(rare)])
    out = []
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, U), np.cumsum(mix(s, 11), dtype=U)])
        for level in range(own, last + 1):
            most = int(differ[level])
            if not most:
                continue  # only equal sets link at this size: they are one class
            m, need = slices_of(most)
            edges = (np.arange(1, m, dtype=np.float64) * (2.0**64 / m)).astype(U)
            cut = np.concatenate([[0], np.searchsorted(s, edges), [n]])
            sig = mix(run[cut[1:]] - run[cut[:-1]] + mix(np.arange(m, dtype=U), level + 100), 13)
            order = np.lexsort((sig, cut[:-1] - cut[1:], rares[cut[:-1]] - rares[cut[1:]]))
            out.append(sig[order[: most + need]] & ~U(_SHARED - 1) | U(need - 1))
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(texts, size: int):
    """For each run of rows: sorted distinct shingles and each row's first."""
    table = fold_table()
    for a, b, w in pieces(texts, table):
        yield a, b, *distinct_in_rows(*shingles(w, size))


def _fingerprints(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sums_in_rows(mix(s, 1), first).view(np.int64), sums_in_rows(mix(s, 2), first).view(np.int64)


#: Shingles in at least so many distinct sets of a run of about so many shingles are reported as common.
_OFTEN, _RUN = 4, 1 << 20


def _common(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (and counts) in ``_OFTEN`` or more distinct sets of a run of (shingles, firsts, fingerprints)."""
    seen, parts = set(), []
    for s, first, a in runs:
        for r, x in enumerate(a.tolist()):
            if x not in seen:
                seen.add(x)
                parts.append(s[first[r] : first[r + 1]])
    values, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, U), np.zeros(0, np.int64))
    return values[n >= _OFTEN], n[n >= _OFTEN]


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, key, n (set size) and the two halves a, b of the set's fingerprint; one row per document.

    ``common``: on some rows, shingles that came often in a run of documents, with their counts.
    """
    pair = pa.struct([("s", pa.int64()), ("n", pa.int64())])

    def told(rows: int, values: np.ndarray, n: np.ndarray) -> pa.Array:
        """The pairs on the first row, nothing on the others."""
        flat = pa.StructArray.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], fields=list(pair))
        return pa.ListArray.from_arrays(pa.array([0] + [len(values)] * rows, pa.int32()), flat)

    def run(batches):
        held, size_held = [], 0
        for batch in batches:
            n, a, b, often = [], [], [], []
            for _, _, s, first in _sets(batch.column("text"), size):
                x, y = _fingerprints(s, first)
                n.append(np.diff(first)), a.append(x), b.append(y)
                held.append((s, first, x))
                size_held += len(s)
                if size_held >= _RUN:
                    often.append(_common(held))
                    held, size_held = [], 0
            if n:
                cols = [np.concatenate(x).astype(np.int64) for x in (n, a, b)]
                values, counts = (np.concatenate(x) for x in zip(*often)) if often else (np.zeros(0, U), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("key"), *map(pa.array, cols), told(batch.num_rows, values, counts)],
                    names=["doc_id", "key", "n", "a", "b", "common"])
        if held:  # the last run: a row of its own, which is no document
            values, counts = _common(held)
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([-1]), none, none, told(1, values, counts)], names=["doc_id", "key", "n", "a", "b", "common"])

    return _input(docs).mapInArrow(run, "doc_id long, key long, n long, a long, b long, common array<struct<s:long,n:long>>")


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text")).withColumn("key", shared.row_key("doc_id", "text"))


def _signatures(docs: DataFrame, size: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        seen: set[int] = set()  # classes of this task: copies add nothing
        for batch in batches:
            for _, _, s, first in _sets(batch.column("text"), size):
                a, _ = _fingerprints(s, first)
                sig, node = [], []
                for r, x in enumerate(a.tolist()):
                    if x in seen or first[r] == first[r + 1]:
                        continue
                    seen.add(x)
                    sig.append(slice_signatures(s[first[r] : first[r + 1]], num, den, held.value))
                    node.append(np.full(len(sig[-1]), x, np.int64))
                if sig:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(node))], names=["sig", "node"])

    return _input(docs).select("text").mapInArrow(run, "sig long, node long")


def _run_links(sig: np.ndarray, node: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (sig, node): edges to the first of each run that is long or in ``whole`` (a flag for each row), and the pairs of the others.

    Edges are rows of (u, v), pairs of (u, v, c, n): n signatures of which linked sets have c in common.
    """
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]][: len(sig)])
    length = np.diff(np.r_[start, len(sig)]).astype(np.int64)
    chained = whole | np.repeat(length > _PAIRED, length)
    head = np.repeat(node[start], length)
    at = chained & (node != head)
    left, right = [], []
    for d in range(1, min(_PAIRED, int(length.max(initial=1)))):
        i = np.flatnonzero((sig[d:] == sig[:-d]) & ~chained[d:])
        left.append(i), right.append(i + d)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    pairs = np.stack([node[i], node[j], (sig[i] & (_SHARED - 1)) + 1, np.ones(len(i), np.int64)], axis=1)
    return np.unique(np.stack([node[at], head[at]], axis=1), axis=0), _summed(pairs)


def _summed(pairs: np.ndarray) -> np.ndarray:
    """One row for each (u, v, c) with the sum of n."""
    pairs = pairs[np.lexsort(pairs.T[2::-1])]
    first = np.flatnonzero(np.r_[True, (pairs[1:, :3] != pairs[:-1, :3]).any(axis=1)][: len(pairs)])
    return np.column_stack([pairs[first, :3], np.add.reduceat(pairs[:, 3], first)]) if len(pairs) else pairs


def _chains(signatures: DataFrame) -> DataFrame:
    """Edges between classes that can link: pairs with as many signatures in common as linked sets have, and the chains of long runs.

    Runs cut by tasks are chained, and joined again. Rows written are (u, v, c, n), c NULL for edges, and per task one row of its
    ends: (part, first sig, first node, last sig, last head).
    """
    names = ["u", "v", "c", "n", "part", "s0", "n0", "s1", "n1"]

    def told(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        cols = [pa.array(np.ascontiguousarray(x)) for x in rows.T]
        return pa.RecordBatch.from_arrays([*cols, *[none] * (len(names) - len(cols))], names=names)

    def run(batches):
        from pyspark import TaskContext

        start, chained = None, True  # whether the run at hand is chained whatever its length: the task's first and last ones, and long ones
        sig, node, pairs = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        batches = ((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows)
        while part := list(islice(batches, _BATCHES)):
            if start is None:
                start = (int(part[0][0][0]), int(part[0][1][0]))
            sig, node = (np.concatenate([x, *y]) for x, y in zip((sig, node), zip(*part)))
            once = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]  # copies in several tasks
            sig, node = sig[once], node[once]
            last = int(np.searchsorted(sig, sig[-1]))  # the last run may go on
            open_long = len(sig) - last > _PAIRED or last == 0 and chained
            end = len(sig) if open_long else last
            edges, more = _run_links(sig[:end], node[:end], chained & (sig[:end] == sig[0]) | (np.arange(end) >= last))
            if len(edges):
                yield told(edges)
            pairs.append(more)
            if sum(map(len, pairs)) > _HELD_PAIRS:
                pairs = [_summed(np.concatenate(pairs))]
                if len(pairs[0]) > _HELD_PAIRS // 2:
                    yield told(pairs.pop())
            sig, node = (x[last : last + 1] if open_long else x[last:] for x in (sig, node))
            chained = open_long
        if start is not None:
            edges, _ = _run_links(sig, node, np.ones(len(sig), bool))
            if len(edges):
                yield told(edges)
            if len(rows := _summed(np.concatenate(pairs))):
                yield told(rows)
            ends = [None, None, None, None, TaskContext.get().partitionId(), *start, int(sig[0]), int(node[0])]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in ends], names=names)

    ordered = signatures.repartitionByRange("sig", "node").sortWithinPartitions("sig", "node")
    rows = shared.written(ordered.mapInArrow(run, ", ".join(f"{x} long" for x in names)), "chains")
    edges = rows.filter("part IS NULL AND c IS NULL").select("u", "v")
    pairs = rows.filter("c IS NOT NULL").groupBy("u", "v", "c").agg(F.sum("n").alias("n")).filter("n >= c").select("u", "v")
    # one row per task: the window's single partition is bounded by the number of tasks
    ends = rows.filter("part IS NOT NULL").selectExpr("s0", "n0", "lag(s1) OVER (ORDER BY part) AS s1", "lag(n1) OVER (ORDER BY part) AS n1")
    return edges.union(pairs).union(ends.filter("s0 = s1 AND n0 != n1").select(F.col("n0").alias("u"), F.col("n1").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): smallest node of each connected component of (u, v) edges, by alternating star contractions.

    Neighbours are never collected: each step joins the edges with one minimum per node.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        pairs = e.union(e.select("v", "u")) if large else e
        low = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        moved = pairs.join(low, "u").select("u", "v", "low")
        if large:
            return moved.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        up = moved.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        return up.filter("u != v").distinct()

    def print_of(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = shared.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    before = print_of(e)
    while before[0]:
        e = shared.written(star(star(e, True), False), "edges")
        now = print_of(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class _Forest:
    """Disjoint sets of the members at hand."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if np.array_equal(r, s):
                self.up[x] = r
                return r
            r = s

    def join(self, x: int, y: int) -> bool:
        a, b = self.roots(np.array([x, y]))
        self.up[max(a, b)] = min(a, b)
        return a != b


def _bitmaps(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One bitmap per set, wide enough that a node of a few unlike sets still leaves most bits empty."""
    n = len(first) - 1
    words = int(min(_BITMAP_WORDS, _BITS * first[-1] // n // 64 + 1))
    bit = mix(ids.astype(U), 5) % U(words * 64)
    out = np.zeros((n, words), U)
    row = np.repeat(np.arange(n), np.diff(first))
    np.bitwise_or.at(out, (row, (bit >> U(6)).astype(np.int64)), U(1) << (bit & U(63)))
    return out


class SignatureTree:
    """Bitmaps OR-ed upwards in runs of ``_FAN`` nodes, with each node's size range and most shingles lost to shared bits."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        lost = size - np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [(bits, size, size, lost)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, x = self.levels[-1]
            cut = np.arange(0, len(b), _FAN)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(x, cut)))

    def possible(self, level: int, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
        """Whether some pair below the nodes p, q can still link: size ranges first, then the overlap bound of what they leave."""
        b, lo, hi, lost = self.levels[level]
        ok = (den * hi[p] >= num * lo[q]) & (den * hi[q] >= num * lo[p])
        at = np.flatnonzero(ok)
        p, q = p[at], q[at]
        overlap = np.bitwise_count(b[p] & b[q]).sum(1, dtype=np.int64) + np.minimum(lost[p], lost[q])
        overlap = np.minimum(overlap, np.minimum(hi[p], hi[q]))
        ok[at] = (num + den) * overlap >= num * (lo[p] + lo[q])
        return ok


def tree_links(ids: np.ndarray, first: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """Spanning links (rows of two member numbers) among sets of dense shingle ids, by a dual traversal of their tree.

    ``side``: only pairs between different sides are asked for when given (two blocks; pairs within one are another task's).
    """
    n = len(first) - 1
    size = np.diff(first)
    links: list[tuple[int, int]] = []
    if n < 2:
        return np.zeros((0, 2), np.int64)
    # neighbours in the order of (size class, smallest id) are likely alike: narrow sizes above, tight bitmaps in the leaves
    lead = np.array([ids[a] if a < b else -1 for a, b in zip(first[:-1], first[1:])])
    order = np.lexsort((size, lead, np.log(np.maximum(size, 1)) // np.log(den / num)))
    bits = _bitmaps(ids, first)[order]
    tree = SignatureTree(bits, size[order])
    forest = _Forest(n)
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        by = np.argsort(x, kind="stable")
        x, y = x[by], y[by]
        cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True])
        for a, b in zip(cut[:-1], cut[1:]):
            i, js = x[a], y[a:b]
            js = js[forest.roots(js) != forest.roots(np.array([i]))[0]]
            if not len(js):
                continue
            own = ids[first[i] : first[i + 1]]
            mark[own] = True
            lens = size[js]
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            flat = np.arange(lens.sum()) - np.repeat(starts, lens) + np.repeat(first[js], lens)
            both = np.add.reduceat(mark[ids[flat]].astype(np.int64), starts)
            mark[own] = False
            for j in js[den * both >= num * (size[i] + lens - both)].tolist():
                if forest.join(int(i), j):
                    links.append((int(i), j))

    def down(level: int, p: np.ndarray, q: np.ndarray) -> None:
        """Node pairs p <= q of a level; depth first in runs, so that the pairs at hand stay few and unions prune early."""
        run = max(256, _AT_ONCE // tree.levels[0][0].shape[1])
        for k in range(0, len(p), run):
            a, b = p[k : k + run], q[k : k + run]
            if level == 0:
                x, y = order[a], order[b]
                ok = (a < b) & (forest.roots(x) != forest.roots(y))
                if side is not None:
                    ok &= side[x] != side[y]
                a, b = a[ok], b[ok]
                ok = tree.possible(0, a, b, num, den)
                if ok.any():
                    verify(order[a[ok]], order[b[ok]])
                continue
            ok = tree.possible(level, a, b, num, den)
            a, b = a[ok], b[ok]
            fan = _FAN
            below = len(tree.levels[level - 1][0])
            i, j = np.divmod(np.arange(fan * fan), fan)
            c, d = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
            ok = (c < below) & (d < below) & (c <= d)
            # near pairs first: they merge most
            c, d = c[ok], d[ok]
            near = np.argsort(d - c, kind="stable")
            down(level - 1, c[near], d[near])

    top = len(tree.levels) - 1
    down(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return np.array(links, np.int64).reshape(-1, 2)


def _group_links(size: int, num: int, den: int):
    """Per task group: texts of members of whole candidate groups, or of two blocks of a large one."""

    def run(table: pa.Table) -> pa.Table:
        group, side = table.column("grp").to_numpy(), table.column("block").to_numpy()
        sets, firsts = [], [np.zeros(1, np.int64)]
        for _, _, s, first in _sets(table.column("text"), size):
            sets.append(s), firsts.append(first[1:] + firsts[-1][-1])
        s, first = np.concatenate(sets) if sets else np.zeros(0, U), np.concatenate(firsts)
        a, b = _fingerprints(s, first)
        out = []
        order = np.lexsort((b, a, group))
        cut = np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1], True])
        for x, y in zip(cut[:-1], cut[1:]):
            rows = order[x:y]
            keep = np.r_[True, (a[rows][1:] != a[rows][:-1]) | (b[rows][1:] != b[rows][:-1])]
            rows = rows[keep]
            n = first[rows + 1] - first[rows]
            flat = np.concatenate([s[first[r] : first[r + 1]] for r in rows])
            _, ids = np.unique(flat, return_inverse=True)
            mine = np.concatenate([[0], np.cumsum(n)])
            sorted_ids = np.concatenate([np.sort(ids[i:j]) for i, j in zip(mine[:-1], mine[1:])]) if len(rows) else ids
            sides = side[rows]
            two = len(np.unique(sides)) > 1
            for i, j in tree_links(sorted_ids, mine, num, den, sides if two else None):
                out.append((a[rows[i]], b[rows[i]], a[rows[j]], b[rows[j]]))
        cols = np.array(out, np.int64).reshape(-1, 4).T
        return pa.table([pa.array(c) for c in cols], names=["a", "b", "a2", "b2"])

    return run


def _present(keys: DataFrame, most_bits: int) -> tuple[bytes, int]:
    """A bitmap of the keys' hashes, at most ``most_bits`` long: rows without their bit are surely not among the keys."""
    n = keys.count()
    size = 1 << min(most_bits.bit_length() - 1, max(16, (64 * n).bit_length()))
    word = keys.select(F.pmod("key", F.lit(size)).alias("x")).selectExpr("x DIV 64 AS w", "shiftleft(1L, CAST(x % 64 AS INT)) AS m")
    rows = word.groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(size // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return out.tobytes(), size


def _only_present(docs: DataFrame, keys: DataFrame, most_bits: int) -> DataFrame:
    """Rows whose key's bit is set: what the join with ``keys`` has to move; its size bound makes the broadcast safe."""
    bits, size = _present(keys, most_bits)
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        bitmap = np.frombuffer(held.value, U)
        for batch in batches:
            x = np.mod(batch.column("key").to_numpy(), size)
            ok = (bitmap[x >> 6] >> (x & 63).astype(U)) & U(1) == 1
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)


def link_components(
    docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, block: int = 1_000_000, bitmap_bits: int = 1 << 24,
    most_common: int = 200_000,
) -> DataFrame:
    """doc_id, key, n_shingles, component (a, b of the smallest class), component_id: one row per document.

    ``component_id`` is the smallest doc_id of the component. ``block``: shingles that one task's tree holds; a larger
    candidate group is dealt to tasks by pairs of blocks. ``bitmap_bits`` bounds the broadcast prefilter (2 MB by default),
    ``most_common`` the broadcast common shingles (1.6 MB).
    """
    seen = shared.written(features(docs, size), "features")
    often = seen.select(F.explode("common").alias("c")).groupBy("c.s").agg(F.sum("c.n").alias("n")).orderBy(F.desc("n"), "s").limit(most_common)
    common = np.sort(often.select("s").toPandas()["s"].to_numpy(np.int64).view(U))
    feats = seen.filter("n >= 0").drop("common")
    classes = feats.filter("n > 0").groupBy("a", "b").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    groups = components(_chains(_signatures(docs, size, num, den, common)))
    members = shared.written(classes.join(groups, F.col("a") == F.col("node")).select("a", "b", "key", "n", "root"), "members")
    weight = members.groupBy("root").agg(F.sum("n").alias("weight"))
    total = weight.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("t")).first()["t"]
    packs = max(1, -(-int(total) // block))
    cut = F.greatest(F.lit(1), F.ceil(F.col("weight") / F.lit(block))).cast("int")
    dealt = members.join(weight.select("root", cut.alias("blocks")), "root").withColumn("block", F.pmod(F.xxhash64("a", "b"), "blocks").cast("long"))
    # a member of a group of k blocks goes to the k tasks of its block's pairs; small groups are packed together
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "block", F.col("root").alias("grp"),
        F.when(F.col("blocks") > 1, F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other")))
        .otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))).alias("task"),
        (F.col("blocks") > 1).alias("large"),
    )
    texts = _only_present(_input(docs).select("key", "text"), members.select("key"), bitmap_bits)
    work = texts.join(dealt, "key").groupBy("large", "task")
    links = work.applyInArrow(_group_links(size, num, den), "a long, b long, a2 long, b2 long")
    name = lambda a, b: F.concat(F.hex(F.col(a)).alias("x"), F.lit(":"), F.hex(F.col(b)))
    edges = shared.written(links, "links").select(name("a", "b").alias("u"), name("a2", "b2").alias("v"))
    roots = components(edges).withColumnRenamed("root", "component")
    named = feats.withColumn("node", F.when(F.col("n") > 0, name("a", "b")))
    of_class = named.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    of_class = of_class.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = of_class.groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = of_class.join(lowest, "component").select("node", "component", "component_id")
    out = named.join(of_class, "node", "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group of near copies (smallest doc_id, then text hash); all columns kept, clashing names too.

    Documents without words have no near copies and stay; rows equal in doc_id and text are one document.
    """
    found = shared.written(link_components(docs, size, num, den), "components").select("doc_id", "key", "component")
    best = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    keys = best.select(F.col("best.key").alias("__keep")).union(found.filter("component IS NULL").select(F.col("key").alias("__keep"))).distinct()
    key = F.xxhash64(F.col("doc_id").cast("long"), shared.whole_text())
    kept = docs.withColumn("__keep", key).join(keys, "__keep", "left_semi")
    if found.groupBy("key").count().filter("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["__keep"])
    return kept.drop("__keep")
