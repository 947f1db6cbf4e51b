"""Mixing: every document told, repeated rows apart, targets met, flows against enumeration."""

import itertools
import random

import pytest

from panelwright.llm import mixing, queries

OPTIONS = dict(weights=(3, 1, 2), share=1.5, max_repeats=2)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "k", 1) for i, t, s in rows], "doc_id long, text string, source string, key string, size int")


def by_source(rows):
    out = {}
    for r in rows:
        out.setdefault(r["pattern"], []).append(r)
    return out


@pytest.mark.parametrize("name", ["a\x0b", 'q"\\', "\x1f\u2028é", ""])
def test_odd_source_names_keep_their_documents(spark, tmp_path, name):
    rows = [(k, f"some words {k}", name if k % 2 else "b") for k in range(40)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(40)) and all(r["target"] > 0 and r["source_size"] == 60 for r in got)


@pytest.mark.parametrize("seed", [7, 1, 2, 3])
def test_repeated_rows_are_documents_of_their_own(spark, seed):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.randint(5, 30)), "ab"[k % 2]) for k in range(29)]
    rows += [rows[0]] * 6 + [rows[1]] * 3  # repeats
    rows += [(2, rows[2][1], "b"), (4, rows[4][1], "b")]  # the same id and text under another source
    docs = documents(spark, rows)
    mixed, plan = mixing.mix(docs, seed=seed, **OPTIONS)
    parts = by_source(mixed.collect())
    for pattern, (source,) in plan["members"].items():
        largest = max(r["size"] for r in parts[pattern])
        assert abs(sum(r["taken"] for r in parts[pattern]) - plan["targets"][source]) <= largest
        assert all(r["taken"] <= 2 * r["size"] and r["taken"] % r["size"] == 0 for r in parts[pattern])
    assert sum(map(len, parts.values())) == len(rows)
    again = mixing.mix(docs.repartition(5), seed=seed, **OPTIONS)[0]
    told = lambda df: sorted((r["doc_id"], r["pattern"], r["taken"]) for r in df.collect())
    assert told(again) == told(mixed)
    whole = mixing.mix_rows(docs, seed=seed, **OPTIONS)
    assert whole.columns == docs.columns
    words = lambda s: sum(len(r["text"].split()) for r in whole.filter(f"source = '{s}'").collect())
    assert [words("a"), words("b")] == [sum(r["taken"] for r in parts[f'["{s}"]']) for s in "ab"]


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    mixed, plan = mixing.mix(odd_docs, **OPTIONS)
    rows = mixed.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _, _ in odd_rows)
    assert mixing.mix(no_docs, **OPTIONS)[0].count() == 0 and mixing.mix_rows(no_docs, **OPTIONS).count() == 0


def cost_of(totals, offers):
    """Words of the k-th repetition cost k - 1 each."""
    return sum(sum(max(0, total - k * offers[p]) for k in range(1, 4)) for p, total in totals.items())


def least_cost(offers, members, quotas, repeats):
    """(most words, least cost) by trying every flow."""
    edges = [(p, s) for p in offers for s in members[p]]
    best = (0, 0)
    for amounts in itertools.product(*[range(min(repeats * offers[p], quotas[s]) + 1) for p, s in edges]):
        into, out = dict.fromkeys(quotas, 0), dict.fromkeys(offers, 0)
        for (p, s), n in zip(edges, amounts):
            into[s] += n
            out[p] += n
        if all(into[s] <= quotas[s] for s in quotas) and all(out[p] <= repeats * offers[p] for p in offers):
            best = max(best, (sum(amounts), -cost_of(out, offers)))
    return best[0], -best[1]


def test_flow_costs_least():
    rng = random.Random(3)
    for _ in range(60):
        offers = {p: rng.randint(1, 3) for p in "xyz"}
        members = {p: rng.sample("ab", rng.randint(1, 2)) for p in "xyz"}
        quotas = {s: rng.randint(0, 5) for s in "ab"}
        sent = mixing.flow(offers, members, quotas, 2)
        totals = {p: sum(n for (q, _), n in sent.items() if q == p) for p in offers}
        into = {s: sum(n for (_, t), n in sent.items() if t == s) for s in quotas}
        assert all(n >= 0 for n in sent.values()) and all(into[s] <= quotas[s] for s in quotas)
        assert all(totals[p] <= 2 * offers[p] for p in offers)
        assert (sum(totals.values()), cost_of(totals, offers)) == least_cost(offers, members, quotas, 2)
