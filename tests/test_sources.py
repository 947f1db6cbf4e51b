import pytest
from pyspark.sql import functions as F

from panelwright.sources.columns import numeric, observed, require_columns, resolve, unique_key
from panelwright.sources.sinks import commit_result, read_result, write_result, write_snapshot
from panelwright.sources.text import detect_encoding, read_csv_any_encoding

TEXT = "USER_ID,Q7.1,name\n1,2,健康\n2,x,無関心ソ\n"


@pytest.mark.parametrize("encoding,found", [("utf-8", "utf-8"), ("utf-8-sig", "utf-8"), ("cp932", "cp932")])
def test_encodings_are_told_apart(spark, tmp_path, encoding, found):
    path = tmp_path / f"{encoding}.csv"
    path.write_bytes(TEXT.encode(encoding))
    df, used = read_csv_any_encoding(spark, str(path))
    assert used == found
    assert df.columns == ["USER_ID", "Q7.1", "name"]
    assert [r["name"] for r in df.orderBy("USER_ID").collect()] == ["健康", "無関心ソ"]
    assert [r[0] for r in df.orderBy("USER_ID").select(numeric(df, "Q7_1", "Q7.1")).collect()] == [2.0, None]


@pytest.mark.parametrize("encoding", ["utf-8", "cp932", "shift_jis"])
def test_quoted_line_breaks_stay_in_their_record(spark, tmp_path, encoding):
    path = tmp_path / "notes.csv"
    path.write_bytes('USER_ID,note,x\n1,"健康\nソ ""q""",5\n2,"b\r\nc",6\n'.encode(encoding))
    df, _ = read_csv_any_encoding(spark, str(path))
    assert [tuple(r) for r in df.orderBy("USER_ID").collect()] == [("1", '健康\nソ "q"', "5"), ("2", "b\r\nc", "6")]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_a_bad_byte_deep_in_the_file_is_seen(spark, tmp_path):
    path = tmp_path / "late.csv"
    body = "a,b\n" + "".join(f"{i},text\n" for i in range(20000))
    path.write_bytes(body.encode() + "1,健康\n".encode("cp932"))
    assert detect_encoding(spark, str(path)) == "cp932"


def test_nothing_decodes_falls_back_to_default(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_bytes(b"a,b\n1,\xff\xfe\x80\x81\xff\n")
    assert read_csv_any_encoding(spark, str(path))[1] == "default"


def test_column_resolution_and_contract(spark):
    df = spark.createDataFrame([(1, 2)], "SEX int, age int")
    assert resolve(df, "Sex", "SEX") == "SEX"
    assert resolve(df, "nope") is None and numeric(df, "nope") is None
    with pytest.raises(KeyError):
        require_columns(df, ["USER_ID"], "wave")


def test_unique_key_reports_repeats_and_missing(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int")
    assert {r["k"]: r["n_rows"] for r in unique_key(df, ["k"]).collect()} == {1: 2, None: 1}


def test_result_sink_writes_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "Outcome string, RR double")
    write_result(empty, str(tmp_path / "empty"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "empty"))
    assert back.count() == 0
    write_result(empty, str(tmp_path / "emptyp"), "parquet")
    assert spark.read.parquet(str(tmp_path / "emptyp")).columns == ["Outcome", "RR"]


def test_result_sink_refuses_duplicate_names(spark, tmp_path):
    df = spark.range(1).select(F.lit(1).alias("ci"), F.lit(2).alias("CI"))
    with pytest.raises(ValueError):
        write_result(df, str(tmp_path / "dup"))


def test_snapshot_round_trip(spark, tmp_path):
    write_snapshot(spark.range(10), str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 10


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_committed_results_come_back_as_they_were(spark, tmp_path, fmt):
    rows = [("a\n,\"b\"", 0.1 + 0.2, 2**53 + 1, None), ("", None, None, True), (None, float("inf"), -1, False), ("健康", 1e-300, 0, None)]
    df = spark.createDataFrame(rows, "t string, x double, n long, b boolean")
    path = str(tmp_path / "deep" / "table")
    commit_result(df, path, fmt)
    back = read_result(spark, path)
    assert back.dtypes == df.dtypes and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    commit_result(df.limit(0), path, fmt)  # in place of the earlier one
    back = read_result(spark, path)
    assert back.dtypes == df.dtypes and back.count() == 0
    assert sorted(p.name for p in (tmp_path / "deep").iterdir() if not p.name.startswith(".")) == ["table", "table.schema.json"]


def test_a_failed_result_leaves_the_earlier_one(spark, tmp_path):
    path = str(tmp_path / "table")
    commit_result(spark.range(3), path)
    with pytest.raises(Exception):
        commit_result(spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id")), path)
    assert read_result(spark, path).count() == 3
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_contract_is_counted_with_the_write(spark, tmp_path):
    df = spark.createDataFrame([(k % 100 if k % 10 else None, "x" if k % 4 else None) for k in range(1000)], "k int, t string")
    contract = observed(df, ["k"], ["t", "gone"])
    write_snapshot(contract.df, str(tmp_path / "snap"))
    told = contract.violations()
    assert (told["rows"], told["null_keys"], told["missing_t"], told["missing_gone"]) == (1000, 100, 250, 1000)
    assert told["repeated_keys"] == pytest.approx(900 - 90, abs=5)
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 1000
