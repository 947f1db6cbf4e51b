"""Places of pattern matches as native expressions.

``regexp_replace`` puts a mark on both sides of every match, ``split`` cuts there, and running lengths give the places in
code points. Patterns are written with possessive repeats and look-behind, which give the same leftmost matches in linear time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: A private-use character that no pattern matches; where a text holds it, another one takes its place (same length).
MARK, OTHER = "\ue000", "\ue001"


def clean_marks(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(OTHER))


def match_spans(text: Column, pattern: str, before: int = 0) -> Column:
    """array<struct<start, end, text[, lead]>> of all matches; ``before``: code points of context in front to keep as ``lead``."""
    marked = F.split(F.regexp_replace(text, pattern, MARK + "$0" + MARK), MARK)

    def places(parts: Column) -> Column:
        kind = "array<struct<start:int,end:int,text:string,lead:string>>"
        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.lit("").alias("lead"), F.array().cast(kind).alias("out"))

        def step(acc: Column, part: Column) -> Column:
            end = acc["at"] + F.length(part)
            hit = F.struct(acc["at"].alias("start"), end.alias("end"), part.alias("text"), acc["lead"].alias("lead"))
            lead = F.when(acc["hit"], F.lit("")).otherwise(F.right(part, F.lit(before))) if before else F.lit("")
            return F.struct(end.alias("at"), (~acc["hit"]).alias("hit"), lead.alias("lead"), F.when(acc["hit"], F.concat(acc["out"], F.array(hit))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(parts, zero, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<start:int,end:int,text:string,lead:string>>")
    return F.transform(F.array(marked), lambda parts: F.when(F.size(parts) > 1, places(parts)).otherwise(none))[0]


def keep(spans: Column, test: Callable[[Column], Column]) -> Column:
    return F.filter(spans, lambda s: test(s["text"]))


def as_text(spans: Column, kind: str | None = None) -> Column:
    """kind:start:end of each span, in the array's order, comma-joined."""
    name = lambda s: F.lit(kind) if kind else s["kind"]
    return F.array_join(F.transform(spans, lambda s: F.concat(name(s), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
