"""Secrets in whole texts: fixed patterns, and strings that a character Markov model calls random (DataFrame functions only).

Two first-order character models are counted over all documents: the values of the base spans are the random strings, the
words of the texts the ordinary identifiers (words are counted first, so a word's pairs are made once and weighted). A candidate is a run
of 20 or more token characters with letters and digits; it is added when the log-likelihood ratio of the two models is above ``cut``.

NULL text is empty; empty text has no spans; without base spans the random model is the uniform prior alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm import shared, spans

KINDS = ("assign", "access", "hex", "random")
#: The contract's patterns, with possessive repeats.
BASE = {
    "assign": r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{32,}+",
}
RANDOM = r"(?<![A-Za-z0-9+/_-])(?=[^0-9]{0,60}[0-9])(?=[^A-Za-z]{0,60}[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}"
_VALUE = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_N = len(ALPHABET) + 1  # one place for any other character


def _test(kind: str, text: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_replace(text, _VALUE, "")) >= 8
    return F.length(text) >= 16 if kind == "access" else F.lit(True)



def _bigrams(text: Column) -> Column:
    n = F.length(text)
    code = lambda i: F.instr(F.lit(ALPHABET), F.substr(text, i, F.lit(1)))
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: code(i) * F.lit(_N) + code(i + 1))).otherwise(F.array().cast("array<int>"))


def _candidates(text: Column) -> Column:
    kind_of = "array<struct<kind:int,start:int,end:int,base:boolean,grams:array<int>>>"
    none = F.array().cast(kind_of)

    def described(found: Column, kind: str, base: bool) -> Column:
        value = (lambda t: F.regexp_replace(t, _VALUE, "")) if kind == "assign" else (lambda t: t)
        return F.transform(found, lambda s: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), _bigrams(value(s["text"])).alias("grams"))).cast(kind_of)

    sure = F.concat(*[described(spans.keep(spans.match_spans(text, p), lambda t, k=k: _test(k, t)), k, True) for k, p in BASE.items()])
    maybe = described(spans.match_spans(text, RANDOM), "random", False)
    maybe = F.when(text.rlike("[A-Za-z0-9+/_-]{20}"), maybe).otherwise(none)
    apart = lambda b: F.filter(maybe, lambda m: ~F.exists(b, lambda x: (m["start"] < x["end"]) & (x["start"] < m["end"])))
    return F.transform(F.array(sure), lambda b: F.concat(b, apart(b)))[0]


def _transitions(counts: dict[int, int], strength: float = 5.0) -> np.ndarray:
    """P(next | character), drawn towards the next character's own frequency with ``strength`` virtual pairs."""
    table = np.zeros((_N, _N))
    for code, n in counts.items():
        table[divmod(code, _N)] += n
    own = (table.sum(0) + 0.1) / (table.sum() + 0.1 * _N)
    return (table + strength * own) / (table.sum(1, keepdims=True) + strength)


def train(found: DataFrame, docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each character pair (at most 67 * 67 counts reach the driver)."""
    pairs = found.select(F.explode(F.filter("spans", lambda s: s["base"])).alias("s")).select(F.explode("s.grams").alias("g"), F.lit(1).alias("n"))
    words = docs.select(F.explode(F.split(shared.whole_text(), r"[^\p{L}_]+")).alias("w")).filter(F.length("w") >= 4)
    plain = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).select(F.explode(_bigrams(F.col("w"))).alias("g"), "n")
    count = lambda d: {r["g"]: r["n"] for r in d.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    # half uniform: random strings of alphabets that the samples do not have
    random = 0.5 * _transitions(count(pairs)) + 0.5 / _N
    return np.log(random / _transitions(count(plain)))


def find_secrets(docs: DataFrame, cut: float = 5.0) -> DataFrame:
    """doc_id and spans of each document: array<struct<kind, start, end, base>> in the order of start and kind."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans.clean_marks(shared.whole_text()).alias("text"))
    found = shared.written(d.select("doc_id", _candidates(F.col("text")).alias("spans")), "spans")
    ratio = F.array(*[F.lit(round(float(x), 4)) for x in train(found, docs).ravel()])
    score = lambda s: F.aggregate(s["grams"], F.lit(0.0), lambda a, g: a + F.get(ratio, g))
    kept = F.filter("spans", lambda s: s["base"] | (score(s) > cut))
    ordered = F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))
    return found.select("doc_id", ordered.alias("spans"))
