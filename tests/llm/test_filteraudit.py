"""The filter audit against filters applied one after the other, order by order."""

import collections
import itertools
import re

import numpy as np

from panelwright.llm import filteraudit, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """docs: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    told = collections.defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            told[i] = [max(told[i][0], int(q == 1)), max(told[i][1], int(t == 1))]
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = collections.defaultdict(list)
    for i, text, lang in docs:
        text = text or ""
        w = WORD.findall(text)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text],
        }
        parts[lang or ""].append((fails, *(told[i] if i in told else (0, 0))))
    out = []
    for part, rows in parts.items():
        shapley, steps = collections.Counter(), []
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                shapley[f] += len(gone)
                failing = sum(r[0][f] for r in rows)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                steps.append((part, "".join(order), step, len(left), len(gone), failing - len(gone), only, sum(r[1] for r in gone), sum(r[2] for r in gone)))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def audited(docs, labels):
    return sorted(map(tuple, filteraudit.audit(filteraudit.masked(docs, labels)).select(*COLUMNS).collect()))


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(map(tuple, queries.op12_filter_audit(spark, sf).select(*COLUMNS).collect())) == brute(docs, labels)


def test_odd_rows(spark, odd_rows):
    docs = [(i, t, ("en", None, "de")[k % 3]) for k, (i, t, _) in enumerate(odd_rows)]
    docs += [(None, "the very same", "en"), (None, "the very same", "fr"), (50, "THE #1 " * 300, "en"), (51, "THE #1 " * 300, "de"), (51, "THE #1 " * 300, "de"), (49, "a b", "")]
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (None, 1, 1), (51, 1, None), (50, 1, 1), (77, 1, 1)]
    d = spark.createDataFrame([(*r, "x", 1, "y") for r in docs], "doc_id long, text string, lang string, part string, n int, hash string")
    l = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    assert audited(d, l) == brute(docs, labels)


def test_empty_tables(spark, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(no_docs, empty) == []
    docs = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert audited(docs, empty) == brute([(1, None, None)], [])


def test_gray_walk_leaves_what_each_subset_leaves():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, 9, (3, 16, 2))
    states = filteraudit.gray_walk(cells, 4)
    for subset in range(16):
        assert (states[:, subset] == cells[:, [m for m in range(16) if not m & subset]].sum(1)).all()
