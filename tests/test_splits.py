"""CSV read by byte splits: quote states, pieces across splits, charsets, against one parse of the whole file."""

import csv
import io
import random

import pytest

from panelwright.sources import splits
from panelwright.sources.text import read_csv_any_encoding


@pytest.fixture
def small_splits(spark):
    """Many splits a file: a few hundred bytes each."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(rows, encoding, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue().encode(encoding)


def some_rows(n, seed=5):
    rng = random.Random(seed)
    parts = ["健康", "無関心ソ", "a", "b c", ",", '"', '""', "\n", "\r\n", "\n\n", "表能", " ", "x" * 40]
    return [[str(k), "".join(rng.choices(parts, k=rng.randint(0, 9))), rng.choice(["", "7", "q\n" * rng.randint(0, 60)])] for k in range(n)]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp932", "shift_jis"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_many_splits_read_as_one_file(spark, tmp_path, small_splits, encoding, end):
    rows = some_rows(300)
    path = tmp_path / "rows.csv"
    path.write_bytes(written([["USER_ID", "note\n健康", "Q7.1"], *rows], encoding, end))
    assert splits.split_lines(spark, str(path)).select("start").distinct().count() > 20
    df, found = read_csv_any_encoding(spark, str(path))
    assert df.rdd.getNumPartitions() > 1
    assert found == {"utf-8-sig": "utf-8", "shift_jis": "cp932"}.get(encoding, encoding)
    assert df.columns == ["USER_ID", "note\n健康", "Q7.1"]
    want = sorted((int(a), b or None, c or None) for a, b, c in rows)
    assert sorted((int(r[0]), r[1], r[2]) for r in df.collect()) == want


def test_several_files_each_with_a_header(spark, tmp_path, small_splits):
    rows = some_rows(200, 9)
    for k in range(4):
        (tmp_path / f"part-{k}.csv").write_bytes(written([["a", "b", "c"], *rows[k::4]], "cp932"))
    df, found = read_csv_any_encoding(spark, str(tmp_path))
    assert found == "cp932" and df.columns == ["a", "b", "c"]
    assert sorted(int(r["a"]) for r in df.collect()) == list(range(200))


def test_a_header_longer_than_a_split(spark, tmp_path, small_splits):
    names = ["k", *[f"column {i}\n" + "y" * 50 for i in range(20)]]
    path = tmp_path / "wide.csv"
    path.write_bytes(written([names, *[[str(k)] * 21 for k in range(9)]], "utf-8"))
    df, _ = read_csv_any_encoding(spark, str(path))
    assert df.columns == names and sorted(r["k"] for r in df.collect()) == [str(k) for k in range(9)]


def test_short_long_blank_and_stray_quotes(spark, tmp_path):
    data = b'a,b,c\n1,2\n\n1,5" pipe,x\n2,"",y\n3,"q"z,w\n4,"last\n'
    (tmp_path / "odd.csv").write_bytes(data)
    (tmp_path / "blank.csv").write_bytes(b"\n  \n" + data)
    whole = spark.read.options(header=True, escape='"', multiLine=True, lineSep="\n").csv(str(tmp_path / "odd.csv"))
    for name in ("odd", "blank"):
        df, _ = read_csv_any_encoding(spark, str(tmp_path / f"{name}.csv"))
        got = [tuple(r) for r in df.collect()]
        assert got[:3] == [("1", "2", None), ("1", '5" pipe', "x"), ("2", None, "y")]
        assert got[:4] == [tuple(r) for r in whole.collect()][:4] and len(got) == 5


def test_empty_file_and_header_alone(spark, tmp_path):
    (tmp_path / "none.csv").write_bytes(b"")
    df, found = read_csv_any_encoding(spark, str(tmp_path / "none.csv"))
    assert (df.columns, df.count(), found) == ([], 0, "utf-8")
    (tmp_path / "head.csv").write_bytes(b"a,b")
    df, _ = read_csv_any_encoding(spark, str(tmp_path / "head.csv"))
    assert (df.columns, df.count()) == (["a", "b"], 0)


def test_other_splits_than_scanned_are_refused(spark, tmp_path, small_splits):
    path = tmp_path / "rows.csv"
    path.write_bytes(written([["a", "b", "c"], *some_rows(100)], "utf-8"))
    df, _ = read_csv_any_encoding(spark, str(path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "470")
    assert read_csv_any_encoding(spark, str(path))[0].count() == 100  # a new scan is fine
    with pytest.raises(Exception, match="split in another way"):
        df.withColumn("n", df["a"]).collect()


def test_line_states_against_a_parser():
    """A quoted field is open after a text if one more line changes its last record."""
    rng = random.Random(1)
    for _ in range(5000):
        line = "".join(rng.choices(['"', '""', ",", "a", " "], k=rng.randint(0, 10)))
        at, state = 0, "start"
        for c in line:  # a plain state machine, character by character
            if state == "start":
                state = {'"': "quoted", ",": "start"}.get(c, "bare")
            elif state == "bare":
                state = "start" if c == "," else "bare"
            elif state == "quoted":
                state = "closing" if c == '"' else "quoted"
            elif state == "closing":
                state = {'"': "quoted", ",": "start"}.get(c, "bare")
        assert splits.ends_inside(line.encode(), False) == (state == "quoted"), line
        assert splits.ends_inside(("x" + line).encode(), True) == splits.ends_inside(('"x' + line).encode(), False)


def test_states_compose_over_splits(spark, tmp_path, small_splits):
    data = written([["a", "b", "c"], *some_rows(120, 3)], "utf-8")
    path = tmp_path / "rows.csv"
    path.write_bytes(data)
    lines = splits.split_lines(spark, str(path))
    got = {r["start"]: r["inside"] for r in splits.split_states(lines).collect()}
    first = {r["start"]: bytes(r["raw"]) for r in lines.groupBy("start").agg({"raw": "count"}).join(lines.dropDuplicates(["start"]), "start").collect()}
    assert set(got) == set(first) and any(got.values()) and not got[0]
    inside, starts, at = False, {}, 0
    for line in data.split(b"\n"):
        starts[at] = inside
        inside = splits.ends_inside(line, inside)
        at += len(line) + 1
    # a split's first line starts at or after the split's own place
    assert all(got[s] == next(starts[x] for x in sorted(starts) if x > s or x == s == 0) for s in got)
