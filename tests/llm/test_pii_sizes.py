"""The same text gets the same spans however many candidates its table has, and odd tables are handled."""

import pytest

from panelwright.llm import pii, secrets

TEXT = "write to me at john.smith (at) gmail (dot) com or mail"


def found(spark, rows, find, kinds=pii.KINDS):
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int, votes int")
    return {r["doc_id"]: r["spans"] for r in pii.digest(find(df), kinds).collect()}


@pytest.mark.parametrize("text", [TEXT, "email: jane_doe[at]example.org today", "call 0049 170 1234567 phone", "no candidate"])
def test_spans_do_not_depend_on_the_number_of_candidates(spark, text):
    got = [found(spark, [(k, text, "x", 1, 1) for k in range(n)], pii.find_pii)[0] for n in (1, 19, 20, 21, 60)]
    assert len(set(got)) == 1


@pytest.mark.parametrize("find,kinds", [(pii.find_pii, pii.KINDS), (secrets.find_secrets, secrets.KINDS)])
def test_empty_tables_and_clashing_columns(spark, find, kinds):
    assert found(spark, [], find, kinds) == {}
    got = found(spark, [(1, None, None, None, None), (None, "", "y", 2, 3), (3, "mail a@b.org password = abcdefgh1", "z", 0, 0), (3, "mail a@b.org password = abcdefgh1", "z", 0, 0)], find, kinds)
    assert got[1] == got[None] == "" and got[3]
