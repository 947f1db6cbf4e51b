"""Mix overlapping sources to target weights by a min-cost flow over membership patterns.

1. A document's size is its number of words; documents with the same set of sources form one *membership pattern*. Only
   the patterns' totals reach the driver (their number is checked against ``max_patterns``).
2. Targets share the wanted total by weight; a source stops at ``max_repeats`` times its size and the excess is shared
   again by weight until none is above.
3. Flow: pattern p offers its words once for each repetition, the k-th at cost k - 1 (convex), and feeds the quotas of
   its sources. Costs sit on the offers alone, so filling repetition by repetition with maximum flows is a minimum-cost flow.
4. Selection: a pattern repeats all documents as often as its flow fills, and the rest goes to its first documents in the order of a
   seeded hash. Word totals of 65,536 hash ranges find the range where the rest ends; only that range is put in order,
   so no task ever holds a whole pattern. One more document, the one whose size is nearest to what is left, closes the gap.

NULL texts have size 0 and are never taken; a NULL source is a source of its own, last in order; repeated rows are separate documents.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Window, functions as F

from panelwright.llm import shared

_RANGES = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but space and \\x09-\\x0D."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[ \x09-\x0D]+"))).cast("long")


def targets(sizes: dict, weights: dict, total: float, max_repeats: int) -> dict:
    """Shares of ``total`` by weight, none above ``max_repeats`` times its source's size."""
    out, open_, left = {}, dict(weights), float(total)
    while open_:
        whole = sum(open_.values())
        above = [s for s in open_ if left * open_[s] / whole > max_repeats * sizes[s]]
        if not above:
            return out | {s: left * w / whole for s, w in open_.items()}
        for s in above:
            out[s] = float(max_repeats * sizes[s])
            del open_[s]
        left = float(total) - sum(out.values())
    return out


def flow(offers: dict, members: dict, quotas: dict, max_repeats: int) -> dict:
    """Words from each pattern to each source: {(pattern, source): words}, least repetition first.

    Augments along shortest residual paths offer -> pattern -> source (-> pattern -> source ...) -> quota.
    """
    sent: dict = {}
    room = dict(quotas)
    for _ in range(max_repeats):
        offer = dict(offers)  # the next repetition of every pattern
        while True:
            came: dict = {("p", p): None for p, left in offer.items() if left > 0}
            queue, end = deque(came), None
            while queue and end is None:
                kind, x = queue.popleft()
                if kind == "p":
                    for s in members[x]:
                        if ("s", s) not in came:
                            came["s", s] = ("p", x)
                            if room[s] > 0:
                                end = ("s", s)
                                break
                            queue.append(("s", s))
                else:
                    for (p, s), amount in sent.items():
                        if s == x and amount > 0 and ("p", p) not in came:
                            came["p", p] = ("s", x)
                            queue.append(("p", p))
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            path.reverse()
            steps = list(zip(path[:-1], path[1:]))
            amount = min([offer[path[0][1]], room[end[1]], *(sent[b[1], a[1]] for a, b in steps if a[0] == "s")])
            for a, b in steps:
                edge = (a[1], b[1]) if a[0] == "p" else (b[1], a[1])
                sent[edge] = sent.get(edge, 0) + (amount if a[0] == "p" else -amount)
            offer[path[0][1]] -= amount
            room[end[1]] -= amount
    return sent


def mix(
    docs: DataFrame, sources: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2,
    seed: int = 7, max_patterns: int = 10_000, row: Column | None = None,
) -> tuple[DataFrame, dict]:
    """(row, doc_id, size, pattern, taken) per document, and the plan: sizes, targets, flow and members (sources) by source and pattern.

    ``sources``: array of a document's sources (default: the column ``source`` alone). ``weights`` repeat over the sources in order.
    ``row``: a number of its own for each row of a stored table; otherwise one is given here.
    """
    names = F.array_sort(F.array_distinct(sources if sources is not None else F.array(F.col("source").cast("string"))))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.whole_text().alias("text"), F.to_json(names).alias("pattern"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    sized = shared.written(base.select(
        "row", "doc_id", word_count(F.col("text")).alias("size"), "pattern",
        F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"),
    ), "sized")
    found = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns: raise max_patterns or merge sources")
    offers = {r["pattern"]: int(r["size"]) for r in found}
    members = {p: json.loads(p) for p in offers}
    order = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    sizes = {s: sum(n for p, n in offers.items() if s in members[p]) for s in order}
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share * sum(offers.values()), max_repeats)
    sent = flow(offers, members, {s: round(t) for s, t in goal.items()}, max_repeats)
    total = {p: sum(v for (q, _), v in sent.items() if q == p) for p in offers}
    plan = {"sizes": sizes, "targets": goal, "flow": sent, "offers": offers, "members": members}
    rows = [(p, total[p] // n if n else 0, total[p] % n if n else 0) for p, n in offers.items()]
    wanted = F.broadcast(docs.sparkSession.createDataFrame(rows, "pattern string, whole long, rest long"))  # at most max_patterns rows
    at = sized.join(wanted, "pattern").withColumn("range", F.shiftrightunsigned("h", 48).cast("int"))
    sums = at.filter("rest > 0").groupBy("pattern", "range", "rest").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("pattern").orderBy("range")  # at most 65,536 rows of a pattern
    ends = sums.withColumn("upto", F.sum("words").over(run)).filter("upto > rest").groupBy("pattern").agg(
        F.min(F.struct("range", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    edge = {r["pattern"]: (r["e"]["range"], r["e"]["before"]) for r in ends.collect()}
    edges = F.broadcast(docs.sparkSession.createDataFrame([(p, *e) for p, e in edge.items()], "pattern string, edge int, before long"))
    at = at.join(edges, "pattern", "left")
    inside = at.filter("range = edge")
    upto = F.sum("size").over(Window.partitionBy("pattern").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("extra", F.col("before") + upto <= F.col("rest")).unionByName(
        at.filter("edge IS NULL OR range != edge").withColumn("extra", (F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("range") < F.col("edge")))))
    placed = shared.written(placed.select("row", "doc_id", "h", "size", "pattern", "whole", "rest", "extra"), "placed")
    got = placed.filter("rest > 0").groupBy("pattern").agg((F.first("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("gap"))
    left = placed.filter("NOT extra AND size > 0 AND rest > 0").join(F.broadcast(got), "pattern")
    near = left.filter("abs(size - gap) < gap").groupBy("pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "h", "doc_id", "row")).alias("b"))
    closing = F.broadcast(near.select(F.col("b.row").alias("row"), F.lit(True).alias("closes")))  # one row per pattern: of equal rows, one
    last = F.coalesce(F.col("closes"), F.lit(False)) & ~F.col("extra")
    taken = F.col("size") * (F.col("whole") + (F.col("extra") | last).cast("long"))
    return placed.join(closing, "row", "left").select("row", "doc_id", "size", "pattern", taken.alias("taken")), plan


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with all its columns (clashing names too).

    The rows are numbered and stored first, so that equal rows stay apart.
    """
    numbered = shared.written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    picked, _ = mix(numbered, row=F.col("__row"), **options)
    copies = picked.filter("taken > 0").select(F.col("row").alias("__row"), (F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    return numbered.join(copies, "__row").withColumn("__copies", F.explode(F.sequence(F.lit(1), "__copies"))).drop("__row", "__copies")
