"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the base spans (always kept) and looser shapes of the same kinds. Four labelers vote on each: strict
shape (regex), gazetteer, context words in front, and format. Vote patterns are counted over all documents; expectation-
maximisation with two classes on these counts (at most 64 per kind, so the driver sees no document) estimates each
labeler's reliability. A logistic span classifier is then trained on the posteriors, and it decides the looser candidates. A kind
without candidates keeps the prior classifier, the labelers' majority; few candidates move it little.

NULL text is empty; empty text has no spans; repeated rows give equal rows. Span texts are never written anywhere.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm import shared, spans

KINDS = ("email", "ip", "card", "phone")
#: The contracts' patterns, with possessive repeats and look-behind (same leftmost matches, linear time).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\(\[]at[\)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[\(\[]dot[\)\]] ?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9A-Za-z.,])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,14}+(?![ -]?[0-9])",
    "phone": r"(?<![0-9A-Za-z+.,(-])(?<![0-9] )(?:00[1-9]|0[1-9]|\(0?[0-9]{2,4}\) ?)(?:[0-9][ ./-]?){6,11}[0-9](?![0-9A-Za-z]|[.,][0-9])",
}
#: Texts without this cannot hold the kind: they skip its pattern.
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Context words of the four languages at hand, top-level domains, calling codes, issuer prefixes.
CONTEXT = {
    "email": "mail|contact|kontakt|correo|courriel|write to|reach",
    "ip": r"\bip\b|server|host|addr|adres|dirección",
    "card": "card|visa|master|amex|karte|carte|tarjeta|kredit",
    "phone": "tel|phone|call|fon|mobil|móvil|appel|llama|fax|ruf",
}
DOMAINS = "com|org|net|edu|gov|int|info|io|de|fr|es|it|uk|eu|us|ca|ch|at|mx|ar|co"
CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91"
ISSUERS = "4|5[1-5]|2[2-7]|34|37|36|30|38|35|6011|64|65|62"
_LEAD = 24
_VOTES, _SHAPES = 4, 2


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def base_test(kind: str, text: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda part: F.ltrim(part, F.lit("0"))
        return F.forall(F.split(text, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(bare(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.call_function("luhn_check", _digits(text))
    return F.length(_digits(text)).between(8, 15)


def votes(kind: str, text: Column, lead: Column) -> list[Column]:
    """Four labelers, then two shape features of the final classifier."""
    digits = _digits(text)
    near = F.lower(lead).rlike(CONTEXT[kind])
    if kind == "email":
        out = [text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"), text.rlike(rf"(?i)[.\])] ?({DOMAINS})$"), near, text.rlike("[A-Za-z]{2}.*[@(\\[]")]
        shape = [F.length(text) > 16, text.contains("@")]
    elif kind == "ip":
        out = [text.rlike(r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*)){3}$|::|[0-9A-Fa-f]{4}:"), ~text.rlike(r"^(0|10|127|2[4-9][0-9]|22[4-9]|23[0-9])\."), near, ~F.lower(lead).rlike(r"(version|section|release|v|§) ?$")]
        shape = [F.length(text) > 10, text.contains(":")]
    elif kind == "card":
        out = [F.call_function("luhn_check", digits), digits.rlike(f"^({ISSUERS})"), near, text.rlike("^([0-9]{4}[ -]){3}|^[0-9]{15,16}$|^3[0-9]{3}[ -][0-9]{6}[ -]")]
        shape = [F.length(digits) >= 15, text.rlike("[ -]")]
    else:
        out = [text.rlike(r"^\+[0-9]{1,3}[ (.-]*[0-9]"), text.rlike(rf"^(\+|00)({CODES})"), near, F.length(digits).between(9, 13)]
        shape = [text.rlike("[ ().-]"), text.startswith("+")]
    return [*out, *shape]


def _candidates(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, base, votes>>; looser spans that touch a base span are left out."""
    index = KINDS.index(kind)

    def described(found: Column, base: bool) -> Column:
        def one(s: Column) -> Column:
            bits = sum((F.when(v, F.lit(1 << k)).otherwise(0) for k, v in enumerate(votes(kind, s["text"], s["lead"]))), F.lit(0))
            return F.struct(F.lit(index).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), bits.cast("int").alias("votes"))
        return F.transform(found, one)

    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,votes:int>>")
    sure = described(spans.keep(spans.match_spans(text, BASE[kind], _LEAD), lambda t: base_test(kind, t)), True)
    need = _NEEDS[kind]
    sure = F.when(text.contains(need), sure).otherwise(none) if need else sure
    maybe = described(spans.match_spans(text, LOOSE[kind], _LEAD), False)
    guard = text.rlike(r"[\(\[]at[\)\]]") if kind == "email" else text.contains(":") if kind == "ip" else text.rlike("[0-9]{2}")
    maybe = F.when(guard, maybe).otherwise(none)
    apart = lambda b: F.filter(maybe, lambda m: ~F.exists(b, lambda x: (m["start"] < x["end"]) & (x["start"] < m["end"])))
    return F.transform(F.array(sure), lambda b: F.concat(b, apart(b)))[0]


def reliabilities(pattern: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Two-class EM over vote patterns (rows of 0/1): posterior of each pattern, P(vote | class), prior."""
    count = count.astype(float)
    post = np.clip(pattern.mean(1), 0.05, 0.95)
    for _ in range(rounds):
        weight = np.stack([count * (1 - post), count * post])
        # a labeler is taken to be better than chance before it is seen: two of three virtual votes right
        rate = (weight @ pattern + np.array([[1.0], [2.0]])) / (weight.sum(1, keepdims=True) + 3)
        prior = (weight[1].sum() + 1) / (count.sum() + 2)
        log = [np.log(p) + pattern @ np.log(r) + (1 - pattern) @ np.log(1 - r) for p, r in ((1 - prior, rate[0]), (prior, rate[1]))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    return post, rate, prior


#: Weights before any candidate is seen (intercept, votes, shapes): three of the four labelers make a span, two do not.
_PRIOR = np.array([-6.0, 3, 3, 3, 3, 0, 0])


def fit_logistic(x: np.ndarray, y: np.ndarray, count: np.ndarray, start: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights (intercept first) of a logistic model on soft labels, drawn towards ``start``; Newton steps over counted patterns."""
    z = np.c_[np.ones(len(x)), x]
    w = start.astype(float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (count * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (count * (y - p)) - ridge * (w - start))
    return w


def train(found: DataFrame) -> dict[int, np.ndarray]:
    """Classifier weights of each kind from the counted vote patterns of all candidates."""
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    out = {}
    for k in range(len(KINDS)):
        rows = [(r["votes"], r["n"]) for r in counts if r["kind"] == k]
        bits = np.array([[v >> i & 1 for i in range(_VOTES + _SHAPES)] for v, _ in rows], float).reshape(-1, _VOTES + _SHAPES)
        n = np.array([n for _, n in rows], float)
        weights = fit_logistic(bits, reliabilities(bits[:, :_VOTES], n)[0], n, _PRIOR) if rows else _PRIOR
        out[k] = weights
    return out


def find_pii(docs: DataFrame, least: float = 0.9) -> DataFrame:
    """doc_id, base and added spans of each document: array<struct<kind, start, end, base>> in the order of kind and start.

    An added span needs probability ``least`` and two votes besides its shape, so that numbers alone never make one.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans.clean_marks(shared.whole_text()).alias("text"))
    found = shared.written(d.select("doc_id", F.concat(*[_candidates(k, F.col("text")) for k in KINDS]).alias("spans")), "spans")
    weights = train(found)

    def score(s: Column) -> Column:
        total = F.lit(0.0)
        for k, w in weights.items():
            terms = F.lit(float(w[0]))
            for i in range(_VOTES + _SHAPES):
                terms = terms + F.lit(float(w[i + 1])) * s["votes"].bitwiseAND(1 << i).cast("boolean").cast("double")
            total = F.when(s["kind"] == k, terms).otherwise(total)
        return total

    cut = float(np.log(least / (1 - least)))
    enough = lambda s: F.bit_count(s["votes"].bitwiseAND((1 << _VOTES) - 2)) >= 2
    kept = F.filter("spans", lambda s: s["base"] | ((score(s) > cut) & enough(s)))
    ordered = F.sort_array(F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))))
    return found.select("doc_id", ordered.alias("spans"))


def digest(found: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Counts, hash and text of the spans."""
    name = F.array(*[F.lit(k) for k in kinds])
    named = F.transform("spans", lambda s: F.struct(F.get(name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    base = lambda c: F.filter(c, lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return found.withColumn("named", named).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(kinds) if k in ("email", "ip", "card", "phone", "assign", "access", "hex")],
        F.sha2(spans.as_text(base(F.col("named"))).cast("binary"), 256).alias("base_sha256"), spans.as_text(F.col("named")).alias("spans"))
