"""The registered text queries on driver tables, the pipeline's stages, and the removable part."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from panelwright.llm import queries, shared
from tests.llm import brute

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_stages_keep_the_documents_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "mixing", "token files"]
    at, counts = docs, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = shared.written(stage(spark, at, sf), "stage")
        assert at.dtypes == docs.dtypes
        counts.append(at.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    # the mix takes each document at most twice, and only documents that came so far
    assert at.groupBy("doc_id").count().filter("count > 2").count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, at, sf).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in at.orderBy("doc_id").collect()]
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, rows))


def test_near_copies_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept == {low if n else i for i, n, low in brute.jaccard_components(rows, 5, 80, 100)}


def test_leaks_against_exact_search(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if len(r["text"].split()) >= 5]
    left = {r["doc_id"] for r in corpus_pipeline.drop_leaks(spark, docs, sf).collect()}
    assert not any(item in r["text"] for r in docs.collect() if r["doc_id"] in left for item in items)


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES if n[2:4] not in ("11", "12", "13")))  # those have tests of their own
def test_query_runs_with_a_row_for_each(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf)
    table = "pages" if name.startswith("op8") else "documents"
    whole = spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert rows.count() > 0 if name.startswith("op1_") else rows.count() == whole


def test_entry_imports_without_the_text_operators(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("panelwright.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not any(n.startswith("op") and n[2:3].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
