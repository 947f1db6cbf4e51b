"""Row keys, shared folders and small helpers of the text operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelwright.session import cut_lineage, ensure_checkpoint_dir

__all__ = ["cut_lineage", "fresh_folder", "partitions_for", "remove_folder", "row_key", "whole_text", "written"]


def row_key(*names: str) -> Column:
    """64-bit key of a row's content: equal rows get equal keys, NULL has its own place."""
    return F.xxhash64(*[F.col(f"`{n}`") for n in names])


def whole_text(name: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    p, fs = _filesystem(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder (smaller than a checkpoint, read by column).

    Rows cross to Python in small batches meanwhile: texts can be long, and a task's memory is bounded.
    """
    path, setting, conf = fresh_folder(df.sparkSession, what), "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    before = conf.get(setting)
    conf.set(setting, "2000")
    try:
        df.write.parquet(path)
    finally:
        conf.set(setting, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions_for(df: DataFrame, units: int, per_partition: int) -> int:
    """Partitions that hold about ``per_partition`` units each, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-units // per_partition))


