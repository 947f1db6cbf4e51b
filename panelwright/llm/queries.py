"""Registered queries of the text operators: production parameters, whole tables, full results."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import decontaminate, filteraudit, hardneg, jaccard, mixing, packing, pii, quality, secrets, shared, tokenbin, tokencount, toxicity, warc


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and benchmark item that match, over all documents and items."""
    found = decontaminate.find_leaks(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "similarity", "first_word")


def op2_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    mixed, plan = mixing.mix(_table(spark, sf, "documents"), weights=(3, 1, 2), share=1.5, max_repeats=2)
    sizes, goal = plan["sizes"], plan["targets"]
    per_source = [(pattern, int(sizes[s]), float(goal[s])) for pattern, (s,) in plan["members"].items()]
    told = spark.createDataFrame(per_source, "pattern string, source_size long, target double")
    return mixed.join(F.broadcast(told), "pattern", "left").select("doc_id", "size", "source_size", "target", "taken")  # one row per source


def op3_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(pii.find_pii(_table(spark, sf, "documents")), pii.KINDS)


def op4_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard.link_components(_table(spark, sf, "documents"), size=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


def op5_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return pii.digest(secrets.find_secrets(_table(spark, sf, "documents")), secrets.KINDS)


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    scored = toxicity.score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


def op8_warc_segments(spark: SparkSession, sf: str) -> DataFrame:
    folder = shared.fresh_folder(spark, "warc")
    warc.write_archives(_table(spark, sf, "pages"), folder)
    return warc.read_pages(spark, folder)


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(_table(spark, sf, "documents"))


def op10_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return tokenbin.token_files(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hardneg.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return filteraudit.audit(filteraudit.masked(_table(spark, sf, "documents"), _table(spark, sf, "labels")))


def op13_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.placements(packing.pack_documents(_table(spark, sf, "documents"), path), packing.id_bytes(path))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mix_sources": op2_mix_sources,
    "op3_pii": op3_pii,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_secrets": op5_secrets,
    "op6_token_counts": op6_token_counts,
    "op7_toxicity": op7_toxicity,
    "op8_warc_segments": op8_warc_segments,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_files": op10_token_files,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_filter_audit": op12_filter_audit,
    "op13_best_fit_packing": op13_best_fit_packing,
}
#: DuckDB SQL where it can express the query on whole tables.
SQL: dict[str, str] = {
    "op8_warc_segments": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, html FROM p),
l AS (SELECT html, max(page_id) AS last FROM s WHERE payload_bytes >= 1000 GROUP BY html)
SELECT s.page_id, s.payload_bytes, s.payload_digest,
       CASE WHEN l.last IS NOT NULL AND l.last <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN l.last IS NOT NULL AND l.last <> s.page_id THEN l.last END AS refers_to
FROM s LEFT JOIN l ON s.html = l.html AND s.payload_bytes >= 1000""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (
  SELECT ar, anchor_id, br AS pr, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.other AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.ar = s.ar AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_filter_audit": """
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(range(5)) AS k),
o AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM f a JOIN f b ON b.k <> a.k JOIN f c ON c.k NOT IN (a.k, b.k) JOIN f d ON d.k NOT IN (a.k, b.k, c.k) JOIN f e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
s AS (
  SELECT array_to_string(list_transform(ks, lambda k: chr((65 + k)::INT)), '') AS filter_order, f.k + 1 AS step,
         ks[f.k + 1] AS own, list_sum(list_transform(ks[1:f.k], lambda k: (1 << k)::INT))::INT AS before FROM o, f),
r AS (
  SELECT c.part, s.filter_order, s.step, s.own,
         sum(CASE WHEN mask & (coalesce(before, 0) | (1 << own)::INT) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND (mask >> own) & 1 = 1 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & coalesce(before, 0) <> 0 AND (mask >> own) & 1 = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = (1 << own)::INT THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND (mask >> own) & 1 = 1 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & coalesce(before, 0) = 0 AND (mask >> own) & 1 = 1 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY c.part, s.filter_order, s.step, s.own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r""",
}
