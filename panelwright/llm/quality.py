"""Quality rules over whole documents and lines that recur across a host's documents (DataFrame functions only).

Cross-document line frequency: a line is lower-cased, its digits become 0 and its white space single spaces; its hash is
counted once per distinct text of a host (exact copies are one document, so copied documents are not punished). Lines
in more than ``limit`` distinct documents of the host are removed, however large the host is; a document that
keeps less than ``least`` of its word characters is depleted and rejected.

Counts are combined map-side; the frequent lines are joined back by (host, hash) with no broadcast of unchecked size.
NULL text has no words (n_words 0: fails the base rules); a NULL host is a host of its own; repeated rows are equal documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm import shared

WHITE = r"[ \x09-\x0D]"


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, WHITE + "+"))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows of ``window`` words found twice or more in the text.

    Window hashes with their places are put in order; a place counts when its neighbour has the same hash. Covered
    words are the places' gaps, at most a window each.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(pairs: Column) -> Column:
        """Over (hash, place) in order: neighbours with one hash give their places."""
        both = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        places = F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-window).cast("int").alias("at"))
        step = lambda acc, i: F.struct((acc["sum"] + F.least(F.lit(window), i - acc["at"])).cast("long").alias("sum"), i.cast("int").alias("at"))
        return F.aggregate(places, zero, step, lambda acc: acc["sum"])

    def found(h: Column) -> Column:
        # only texts that repeat a window pay for the ordering; a one-element transform evaluates its argument once
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), F.transform(F.array(pairs), covered)[0]).otherwise(F.lit(0))

    return F.when(n >= window, F.transform(F.array(hashes), found)[0]).otherwise(F.lit(0)).cast("long")


def base_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, key, text_key, lines (distinct, with a word) and the base counts of each document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), shared.whole_text().alias("text"))
    d = d.withColumn("words", _words(F.col("text")))
    full = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return d.withColumn("full", full).select(
        "doc_id", "host", F.xxhash64("doc_id", "host", "text").alias("key"), F.xxhash64("text").alias("text_key"), "full",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.btrim(line, F.lit(" \t\x0b\x0c\r")), WHITE + "+", " "), "[0-9]", "0"))


def quality(docs: DataFrame, host: str = "source", limit: int = 50, least: float = 0.3) -> DataFrame:
    """Base counts, base_failed, removed share of characters and the verdict ``kept`` of each document."""
    base = base_rules(docs, host)
    lines = F.transform("full", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.length(x).alias("n")))
    facts = shared.written(base.select(
        "doc_id", "host", "key", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", lines.alias("lines")), "facts")
    texts = facts.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))  # one row per distinct text of a host
    spread = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    seen = spread.groupBy("host", "h").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") > limit)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    often = seen.select(F.col("host").alias("host3"), F.col("h").alias("h3"))
    one = facts.groupBy("key").agg(F.first("host").alias("host"), F.first("lines").alias("lines"))
    per_line = one.select("key", "host", F.explode("lines").alias("x")).select("key", "host", F.col("x.h").alias("h"), F.col("x.n").alias("n"))
    gone = per_line.join(often, same("host", "host3") & (F.col("h") == F.col("h3"))).groupBy("key").agg(F.sum("n").alias("removed"))
    total = F.aggregate(F.col("lines"), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    out = facts.join(gone, "key", "left").withColumn("removed_share", F.coalesce(F.col("removed"), F.lit(0)) / F.greatest(total, F.lit(1)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("removed_share") <= 1 - least)).alias("kept"), "removed_share")
