"""Writers for panel snapshots and small result tables, and results that come back as they were."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from panelwright.functions.codes import quoted


def write_snapshot(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Row-level output; keeps the partitioning of the frame."""
    _write(df, path, fmt)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result table (rows per model or group) as one file, also when it is empty."""
    _distinct_names(df)
    _write(df.repartition(1), path, fmt)  # the work before it keeps its tasks


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def _distinct_names(df: DataFrame) -> None:
    names = [c.lower() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("result columns must have distinct names")


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_CSV = {"header": "true", "escape": '"', "multiLine": "true", "nullValue": ""}
_EMPTY = "\ue000"  # a quoted empty field while it is read: only an unquoted one is NULL


def commit_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A result table as the one file ``path``, with its schema in ``path``.schema.json; empty tables have both.

    It is written to a staging folder beside it and renamed when it is whole, so a reader never meets half a table and a job that
    fails leaves the earlier one. The schema comes first: what is there can always be read.
    """
    _distinct_names(df)
    spark, staging = df.sparkSession, f"{path}.staging-{uuid.uuid4().hex}"
    target, fs = _place(spark, path)
    if target.getParent() is not None:
        fs.mkdirs(target.getParent())
    try:
        df.repartition(1).write.options(**({**_CSV, "emptyValue": '""'} if fmt == "csv" else {})).format(fmt).save(staging)
        parts = [f.getPath() for f in fs.listStatus(_place(spark, staging)[0]) if f.getPath().getName().startswith("part-")]
        if len(parts) != 1:
            raise RuntimeError(f"{len(parts)} files instead of one")
        told = _place(spark, f"{staging}/schema.json")[0]
        out = fs.create(told, True)
        out.write(bytearray(json.dumps({"format": fmt, "schema": df.schema.jsonValue()}).encode()))
        out.close()
        for source, name in ((told, f"{path}.schema.json"), (parts[0], path)):
            goal = _place(spark, name)[0]
            if fs.exists(goal):
                fs.delete(goal, False)
            if not fs.rename(source, goal):
                raise OSError(f"{name} could not be put in place")
    finally:
        fs.delete(_place(spark, staging)[0], True)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A committed result with the columns and types that it was written with."""
    told = json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}.schema.json").collect()))
    schema = StructType.fromJson(told["schema"])
    if told["format"] != "csv":
        return spark.read.schema(schema).format(told["format"]).load(path)
    df = spark.read.schema(schema).options(**_CSV, emptyValue=_EMPTY).csv(path)
    texts = [f.name for f in schema if f.dataType.typeName() == "string"]
    return df.select(*[F.when(F.col(quoted(c)) == _EMPTY, "").otherwise(F.col(quoted(c))).alias(c) if c in texts else F.col(quoted(c)) for c in df.columns])
