"""CSV scan with whole-file encoding validation.

Spark never fails on a wrong charset, it substitutes characters, so the bytes
are checked before the parse. Only a file that is not valid UTF-8 pays for the
second check.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.sources.splits import read_records

# The encodings tried, in order, and those of them that the CSV reader does not know.
ENCODINGS = ("utf-8", "utf-8-sig", "cp932", "shift_jis")
LEGACY = ("cp932", "shift_jis")


def _decodes(line: bytes, encoding: str) -> bool:
    try:
        line.decode(encoding)
        return True
    except UnicodeDecodeError:
        return False


def undecodable_lines(spark: SparkSession, path: str, encodings: Sequence[str]) -> dict[str, int]:
    """Lines of the file that each encoding cannot decode."""
    lines = spark.read.text(path).select("value")
    out: dict[str, int] = {}
    if any(e.startswith("utf-8") for e in encodings):
        bad = lines.agg(F.count_if(~F.is_valid_utf8("value"))).first()[0]
        out.update({e: bad for e in encodings if e.startswith("utf-8")})
        if bad == 0:
            return out
    legacy = [e for e in encodings if not e.startswith("utf-8")]
    if not legacy:
        return out

    def bad_in(lines: list[bytes], enc: str) -> int:
        """The batch is decoded at once; only when that fails, line by line."""
        try:
            b"\n".join(lines).decode(enc)
            return 0
        except UnicodeDecodeError:
            return sum(not _decodes(x, enc) for x in lines)

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bad = dict.fromkeys(legacy, 0)
        for batch in batches:
            raw = [bytes(x) for x in batch["raw"]]
            for enc in legacy:
                bad[enc] += bad_in(raw, enc)
        yield pd.DataFrame({"encoding": list(bad), "bad": list(bad.values())})

    raw = lines.select(F.col("value").cast("binary").alias("raw"))
    counts = raw.mapInPandas(check, "encoding string, bad bigint").groupBy("encoding").agg(F.sum("bad").alias("bad"))
    out.update({r["encoding"]: r["bad"] for r in counts.collect()})
    return out


def detect_encoding(spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS) -> str:
    bad = undecodable_lines(spark, path, encodings)
    return next((e for e in encodings if bad.get(e) == 0), "default")


def read_csv_any_encoding(
    spark: SparkSession, path: str, encodings: Sequence[str] = ENCODINGS, encoding: str | None = None, multi_line: bool = True
) -> tuple[DataFrame, str]:
    """All columns as text, plus the encoding used. Pass ``encoding`` to skip detection.

    Files are split over tasks whatever their charset. ``multi_line`` keeps records whose quoted fields hold line breaks, for one more
    scan of the quotes; without it, UTF-8 files go to Spark's reader directly.
    """
    found = encoding or detect_encoding(spark, path, encodings)
    if found not in LEGACY and not multi_line:
        return spark.read.option("header", True).option("escape", '"').csv(path), found
    charset = found if found in LEGACY else "utf-8"
    return read_records(spark, path, charset, "replace" if found == "default" else "strict"), found
