"""Jaccard join, decontamination, mixing against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import decontaminate, jaccard, mixing
from tests.llm import brute


def found(docs, **options):
    rows = jaccard.link_components(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("size,num", [(3, 90), (5, 80)])
def test_components_of_odd_rows(odd_docs, odd_rows, size, num):
    want = brute.jaccard_components([(i, t) for i, t, _ in odd_rows], size, num, 100)
    assert found(odd_docs, size=size, num=num, den=100) == sorted(want, key=str)


def near_copies(n=160, seed=5):
    """Chains of near copies with one to eight edits, so that components are larger than any document's links."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(400)}" for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rows.append((i, " ".join(w)))
        if rng.random() < 0.1:
            base = w
    return rows


@pytest.mark.parametrize("block", [1_000_000, 900])
@pytest.mark.parametrize("size,num", [(3, 90), (2, 80), (5, 80)])
def test_near_copies_in_one_tree_and_in_blocks(spark, size, num, block):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, size=size, num=num, den=100, block=block) == sorted(brute.jaccard_components(rows, size, num, 100), key=str)


def chained(signatures):
    """Sets of classes that the edges join."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in jaccard._chains(signatures).collect():
        up[root(r["u"])] = root(r["v"])
    groups = {}
    for x in list(up):
        groups.setdefault(root(x), set()).add(x)
    return list(groups.values())


def test_unlike_long_sets_do_not_grow_together(spark):
    """Sixty long texts of nine words share slices by chance; only the one near copy makes a group."""
    rng = random.Random(8)
    texts = [[f"w{rng.randrange(9)}" for _ in range(1000)] for _ in range(60)]
    texts.append(["other", *texts[0][1:]])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    groups = chained(jaccard._signatures(docs, 5, 80, 100, np.zeros(0, np.uint64)))
    assert sum(len(g) for g in groups) <= 10 and any(len(g) >= 2 for g in groups)
    kept = {r["doc_id"] for r in jaccard.keep_one(docs).select("doc_id").collect()}
    assert kept == set(range(60))


def test_classes_with_enough_common_signatures_are_joined(spark):
    """Runs short and long, whole and cut by tasks, with repeated rows: c common signatures put two classes into one group."""
    rng = random.Random(3)
    rows = {(16 * s + c - 1, node) for node in range(200) for c in (1, 3) for s in [rng.randrange(40, 700) for _ in range(6)]}
    rows |= {(2, node) for node in range(0, 60, 3)} | {(16 * s + 2, node) for s in range(1, 30) for node in (500, 501)}
    of = {node: {s for s, n in rows if n == node} for _, node in rows}
    signatures = spark.createDataFrame(sorted(rows) + sorted(rows)[::7], "sig long, node long").repartition(3)
    group = {x: i for i, g in enumerate(chained(signatures)) for x in g}
    for u, v in ((u, v) for u in of for v in of if u < v):
        both = of[u] & of[v]
        if any(sum(s % 8 + 1 == c for s in both) >= c for c in (1, 3)):
            assert group[u] == group[v]
    assert group[500] == group[501] and group[500] not in {group.get(x) for x in range(200)}


def test_tree_links_span_all_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 30)) for _ in range(90)]
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    links = jaccard.tree_links(np.concatenate(sets), first, 45, 100)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links.tolist():
        up[root(a)] = root(b)
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 45 * (len(sets[a]) + len(sets[b]) - both):
                assert root(a) == root(b)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "u long, v long")
    got = {r["node"]: r["root"] for r in jaccard.components(edges).collect()}
    assert got == {k: 0 for k in range(201)} | {500: 500, 501: 500}


def test_keep_one_of_each_group(odd_docs, no_docs):
    kept = jaccard.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # 1, 2, 2, the NULL copy and 10 / 11 are exact copies; 3 differs by one word in 40 (similarity 0.76 at five words)
    assert ids == sorted([1, 3, 4, 5, 6, 7, 9, 10, 12, 13, None], key=str)
    assert jaccard.keep_one(no_docs).count() == 0 and found(no_docs) == []


def test_leaks_with_edits(spark):
    rng = random.Random(1)
    items = [(k, " ".join(f"{'abcdefgh'[rng.randrange(8)]}{rng.randrange(300)}" for _ in range(rng.randrange(12, 56)))) for k in range(40)]
    docs, hit = [], 0
    for k, text in items:
        w = text.split()
        for _ in range(int(0.15 * len(w))):
            w[rng.randrange(len(w))] = f"q{rng.randrange(99)}"
        docs.append((k, " ".join([f"n{rng.randrange(300)}" for _ in range(rng.randrange(60))] + w + ["tail"] * 9)))
    docs += [(100 + k, " ".join(f"n{rng.randrange(300)}" for _ in range(200))) for k in range(40)]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts, benchmark = dict(docs), dict(items)
    for r in found:  # every reported pair is right, and its distance exact
        a, b = benchmark[r["item_id"]].split(), texts[r["doc_id"]].split()
        assert brute.edit_distance_inside(a, b) == r["distance"] <= 0.2 * len(a)
    assert all(r["doc_id"] == r["item_id"] for r in found)
    assert len({r["doc_id"] for r in found}) >= 0.9 * len(items)  # the stated recall


def test_leaks_at_every_length(spark):
    """One fifth of the words edited, all kinds of edits: each copy is found, however long the item; short items as they are."""
    rng = random.Random(21)
    items, docs = [], []
    for n in (2, 3, 4, 5, 6, 10, 15, 23, 47, 55, 95, 191, 383):
        for kinds in ("s", "i", "d", "sid"):
            for _ in range(3):
                w = [f"v{rng.randrange(10**6)}" for _ in range(n)]
                items.append((len(items), " ".join(w)))
                for at in sorted(rng.sample(range(n), n // 5), reverse=True):
                    kind = rng.choice(kinds)
                    w[at : at + (kind != "i")] = [] if kind == "d" else [f"q{rng.randrange(10**6)}"]
                docs.append((len(docs), " ".join([f"n{k}" for k in range(rng.randrange(9))] + w + ["tail"] * rng.randrange(3))))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(k, k) for k in range(len(items))}


def test_windows_fit_into_what_edits_leave():
    for least in (0.5, 0.7, 0.8, 0.9, 1.0):
        for n in range(1, 600):
            k, w = decontaminate.most_edits(n, least), decontaminate.window_size(n, least)
            assert w >= 1
            assert (w - 1) * (k + 1) < n - k  # k + 1 runs without a whole window hold fewer words than the edits leave


def test_leaks_of_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(5, 30))), (2, None), (3, ""), (4, "one"), (None, "no id here at all but some words")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(odd_docs, items).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 1, 0), (2, 1, 0), (3, 1, 1), (None, 1, 0), (None, None, 0), (10, 4, 0), (11, 4, 0)], key=str)
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.find_leaks(odd_docs, items.limit(0)).count() == 0
    left = decontaminate.drop_leaked(odd_docs, items)
    assert left.columns == odd_docs.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5, 6, 7, 8, 9, 12, 13]


def test_edit_place_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        want = brute.edit_distance_inside(a, b)
        assert decontaminate.edit_place(np.array(a), np.array(b), 20)[0] == want


def test_targets_share_the_excess():
    goal = mixing.targets({"a": 10, "b": 100, "c": 1000}, {"a": 3, "b": 1, "c": 2}, 1500, 2)
    assert goal["a"] == 20 and goal["b"] == 200 and goal["c"] == pytest.approx(1280)


def test_flow_meets_quotas_at_least_repetition():
    offers, members = {"x": 100, "y": 50, "xy": 60}, {"x": ["x"], "y": ["y"], "xy": ["x", "y"]}
    sent = mixing.flow(offers, members, {"x": 150, "y": 110}, 2)
    assert sent["x", "x"] + sent["xy", "x"] == 150 and sent["y", "y"] + sent["xy", "y"] == 110
    repeated = sum(max(0, sum(v for (p, _), v in sent.items() if p == q) - offers[q]) for q in offers)
    assert repeated == 260 - 210  # no more repetition than the quotas need


def test_mix_of_odd_rows(odd_docs, no_docs):
    got, plan = mixing.mix(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and set(plan["sizes"]) == {"a", "b", "c", None}
    assert list(plan["sizes"]) == ["a", "b", "c", None]
    for r in rows:
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 2 * r["size"] if r["size"] else r["taken"] == 0
    again = mixing.mix(odd_docs.repartition(3))[0].drop("row")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.drop("row").collect()))
    assert mixing.mix(no_docs)[0].count() == 0 and mixing.mix_rows(no_docs).count() == 0
    assert mixing.mix_rows(odd_docs).columns == odd_docs.columns


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(["w"] * rng.randrange(1, 300)), f"s{rng.choice([0, 0, 0, 1, 2, 3])}") for k in range(3000)], "doc_id long, text string, source string")
    got, plan = mixing.mix(docs)
    taken = {r["pattern"]: r["t"] for r in got.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()}
    for source, target in plan["targets"].items():
        assert abs(taken[f'["{source}"]'] - target) <= 0.01 * target


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(k, " ".join(["w"] * 10), ["a"] if k % 3 else ["a", "b"]) for k in range(300)], "doc_id long, text string, of array<string>")
    got, plan = mixing.mix(docs, F.col("of"), weights=(1, 1), share=1.0)
    assert plan["sizes"] == {"a": 3000, "b": 1000} and plan["targets"] == {"a": 1500.0, "b": 1500.0}
    total = got.groupBy("pattern").agg(F.sum("taken").alias("t")).collect()
    assert {r["pattern"]: r["t"] for r in total} == {'["a"]': 1500, '["a","b"]': 1500}
