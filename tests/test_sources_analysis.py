"""Delimited input, its checks, the sink, and the whole analysis."""

import json
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import skimlark as sk
from skimlark.functions.exprs import json_safe
from skimlark.sources.delimited import header_scores, normalize_names, read_lines
from skimlark.sources.errors import HeaderNotConfirmed, InputEmpty, InputMissing, UnsupportedSuffix, WrongEncoding


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_text(text, encoding=encoding)
    return str(path)


def test_names():
    assert normalize_names([" a ", "", None, "Unnamed: 3", "a", "a", "b"]) == ["a", "X2", "X3", "X4", "a__2", "a__3", "b"]
    assert normalize_names(["a__2", "a", "a"]) == ["a__2", "a", "a__3"]


def test_normalize_columns(spark):
    df, mapping = sk.normalize_columns(spark.createDataFrame([(1, 2, 3)], "x int, y int, z int"), ["k", "k", " "])
    assert df.columns == ["k", "k__2", "X3"]
    assert [tuple(r) for r in mapping.collect()] == [(0, "k", "k"), (1, "k", "k__2"), (2, " ", "X3")]


def test_header_auto_and_types(spark, tmp_path):
    path = write(tmp_path, "h.csv", "name,age,score,member\nann,3,1.5,True\nbob,4,NA,False\n\"cy, jr\",5,2.5,True\n")
    df = sk.csv_scan(spark, path)
    assert dict(df.dtypes) == {"name": "string", "age": "bigint", "score": "double", "member": "boolean"}
    assert sorted(map(tuple, df.collect())) == [("ann", 3, 1.5, True), ("bob", 4, None, False), ("cy, jr", 5, 2.5, True)]


def test_no_header(spark, tmp_path):
    path = write(tmp_path, "n.csv", "1,2\n3,4\n5,6\n")
    df = sk.csv_scan(spark, path, header="none")
    assert df.columns == ["X1", "X2"] and df.count() == 3


def test_preamble_in_every_file(spark, tmp_path):
    for i in range(5):
        rows = "".join(f"{i},{j},t{j}\n" for j in range(200))
        write(tmp_path, f"p{i}.csv", f"Report {i}\nmade today, by hand\nid,n,id\n{rows}")
    df = sk.csv_scan(spark, str(tmp_path), header=2)
    assert df.columns == ["id", "n", "id__2"] and df.count() == 1000
    assert df.agg(F.sum("n")).first()[0] == 5 * sum(range(200))


def test_preamble_across_splits(spark, tmp_path):
    """A file cut into many splits has its preamble in the first one only."""
    write(tmp_path, "big.csv", "junk\nk,v\n" + "".join(f"{j},{j % 7}\n" for j in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
        df = sk.csv_scan(spark, str(tmp_path), header=1)
        assert df.count() == 20_000 and df.agg(F.sum("k")).first()[0] == sum(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_header_only_malformed_and_encoding(spark, tmp_path):
    assert sk.csv_scan(spark, write(tmp_path, "e.csv", "alpha,beta\n"), header=0).count() == 0
    df = sk.csv_scan(spark, write(tmp_path, "m.csv", "a;b;c\n1;2;3\n4;5\n6;7;8;9\n"), header=0, sep=";")
    assert df.columns == ["a", "b", "c", "X4"]  # a line with more cells widens the table, nothing is lost
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, 3, None), (4, 5, None, None), (6, 7, 8, 9)]
    latin = sk.csv_scan(spark, write(tmp_path, "l.csv", "stadt,n\nKöln,1\nMünchen,2\n", "latin-1"), header=0, encoding="ISO-8859-1")
    assert {r["stadt"] for r in latin.collect()} == {"Köln", "München"}


def test_delimiter_is_found(spark, tmp_path):
    for sep in ";\t|,":
        df = sk.csv_scan(spark, write(tmp_path, f"s{ord(sep)}.csv", f"name{sep}value\nann{sep}1\n\"x{sep}y\"{sep}2\n"), sep="auto")
        assert sorted(map(tuple, df.collect())) == [("ann", 1), (f"x{sep}y", 2)]


def test_blank_lines_in_the_preamble(spark, tmp_path):
    for i in range(3):
        write(tmp_path, f"b{i}.csv", f"Report\n\n  \na,b\n\n{i},2\n")
    df = sk.csv_scan(spark, str(tmp_path), header=1)
    assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect())) == [(0, 2), (1, 2), (2, 2)]


def test_cells_with_line_breaks(spark, tmp_path):
    path = write(tmp_path, "ml.csv", 'n,t\n1,"two\nlines, and ""more"""\n2,x,extra\n3\n')
    df = sk.csv_scan(spark, path, header=0, multi_line=True)
    assert sorted(map(tuple, df.collect())) == [(1, 'two\nlines, and "more"', None), (2, "x", "extra"), (3, None, None)]
    with pytest.raises(ValueError):
        sk.csv_scan(spark, write(tmp_path, "pre.csv", "Report\nn,t\n1,x\n"), header=1, multi_line=True)


def test_malformed_lines_are_reported(spark, tmp_path):
    path = write(tmp_path, "bad.csv", 'Report\nn,t\n1,"a,b"\n2\n\n3,x,"y,z"\n4,w\n')
    got = sorted((r["line"], r["cells"], r["expected"]) for r in sk.malformed_lines(spark, path, header=1).collect())
    assert got == [("2", 1, 2), ('3,x,"y,z"', 3, 2)]


def test_mapping_and_wrong_encoding(spark, tmp_path):
    df, mapping = sk.csv_scan(spark, write(tmp_path, "map.csv", "k,k, ,z\n1,2,3,4,5\n"), header=0, with_mapping=True)
    assert df.columns == ["k", "k__2", "X3", "z", "X5"]
    assert [tuple(r) for r in mapping.orderBy("position").collect()] == [(0, "k", "k"), (1, "k", "k__2"), (2, " ", "X3"), (3, "z", "z"), (4, None, "X5")]
    with pytest.raises(WrongEncoding):
        sk.csv_scan(spark, write(tmp_path, "w.csv", "stadt,n\nKöln,1\n", "latin-1"), header=0)


def test_bad_inputs(spark, tmp_path):
    with pytest.raises(InputMissing):
        sk.csv_scan(spark, str(tmp_path / "none.csv"))
    with pytest.raises(InputEmpty):
        sk.csv_scan(spark, write(tmp_path, "zero.csv", ""))
    with pytest.raises(UnsupportedSuffix):
        sk.csv_scan(spark, write(tmp_path, "book.xlsx", "x"))
    unsure = write(tmp_path, "u.csv", "a,1\nb,2\nc,3\nd,4\n")
    with pytest.raises(HeaderNotConfirmed):
        sk.csv_scan(spark, unsure)
    with pytest.raises(ValueError):
        sk.csv_scan(spark, unsure, header=30)


def test_header_score_formula(spark):
    rows = [["name", "age"], ["ann", "3"], ["bob", "4"]]
    cells = spark.createDataFrame([("f", r, c, v) for r, line in enumerate(rows) for c, v in enumerate(line)],
                                  "file string, row int, col int, cell string")
    got = {r["row"]: r["score"] for r in header_scores(cells).collect()}
    assert got[0] == round(0.30 + 0.25 + 0.20 + 0.25 * 0.5, 4)
    assert got[1] == round(0.30 * 0.5 + 0.25 + 0.20 - 0.15 * 0.5, 4)
    found = sk.header_score(cells).first()
    assert (found["header_row"], found["needs_confirmation"]) == (0, False)


def test_cell_kinds(spark):
    cells = [None, "  ", "1,234.5", "-inf", "nan", "2026-01-31", "12:30", "2026-02-31", "1e5", "1d", "x-y", "2026年1月2日"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, cell string")
    got = [r["k"] for r in df.select("i", sk.cell_kind(F.col("cell")).alias("k")).orderBy("i").collect()]
    assert got == ["empty", "empty", "numeric", "numeric", "numeric", "datetime", "datetime", "text", "numeric", "text", "text", "datetime"]


def test_delimiters(spark):
    lines = [("a", "x;y;z"), ("a", "1;2;3,5"), ("b", "p\tq"), ("b", "r\ts"), ("c", "plain"), ("c", "")]
    got = {r["file"]: r["delimiter"] for r in sk.delimiter_profile(spark.createDataFrame(lines, "file string, line string")).collect()}
    assert got == {"a": ";", "b": "\t", "c": ","}


def test_encoding_check(spark, tmp_path):
    write(tmp_path, "good.txt", "Köln\nplain\n")
    write(tmp_path, "bad.txt", "Köln\nplain\nMünchen\n", "latin-1")
    lines = read_lines(spark, str(tmp_path)).withColumn("file", F.element_at(F.split("file", "/"), -1))
    got = {r["file"]: (r["lines"], r["valid_utf8"], r["bom"]) for r in sk.encoding_check(lines).collect()}
    assert got == {"good.txt": (2, 2, False), "bad.txt": (3, 1, False)}
    raw = spark.createDataFrame([("f", bytearray("\ufeffa".encode())), ("f", bytearray(b"b"))], "file string, line binary")
    assert sk.encoding_check(raw).first()["bom"] is True


def test_nested_values_are_json_safe(spark):
    odd = spark.sql("select array(double('nan'), 1.0d, null) as a, named_struct('x', double('inf'), 'y', array(named_struct('z', float('nan')))) as s, "
                    "map('k', double('-inf')) as m, cast(null as struct<x: double>) as n, array('t') as t")
    row = json_safe(odd).first()
    assert row["a"] == [None, 1.0, None] and row["s"]["x"] is None and row["s"]["y"][0]["z"] is None
    assert row["m"] == {"k": None} and row["n"] is None and row["t"] == ["t"]


def test_results_are_json_safe(spark, tmp_path):
    df = spark.sql("SELECT double('NaN') AS a, double('Infinity') AS b, 1.5D AS c, timestamp_ntz'2026-01-02 03:04:05' AS t")
    folder = sk.write_results({"r": df}, str(tmp_path / "out"))["r"]
    lines = [json.loads(x) for p in Path(folder).glob("*.json") for x in p.read_text().splitlines()]
    assert lines == [{"c": 1.5, "t": "2026-01-02T03:04:05.000000"}]
    with pytest.raises(Exception, match="(?i)exist"):
        sk.write_results({"r": df}, str(tmp_path / "out"))


@pytest.fixture(scope="module")
def standard(spark):
    """Fifty daily readings: two columns that rise together and a label of two values."""
    rows = [(f"2024-03-{1 + k % 28:02d} {6 + k // 28:02d}:00:00", 3.0 * k + 1, 700 + 5.0 * k + (k * 7 % 5), "north" if k % 2 else "south") for k in range(50)]
    return spark.createDataFrame(rows, "time string, temperature double, pressure double, category string")


def test_analysis_of_the_standard_table(spark, standard, tmp_path):
    a = sk.analyze(standard, order_by=["time"])
    assert a.types == {"time": "datetime", "temperature": "numeric", "pressure": "numeric", "category": "categorical"}
    assert a.default_pair == ("temperature", "pressure") and a.time_axis == "time"
    assert a["dataset"].first()["rows"] == 50 and a["series"].count() == 50
    matrix = {(r["feature_a"], r["feature_b"]): r["r"] for r in a["pearson_matrix"].collect()}
    assert len(matrix) == 4 and matrix["temperature", "pressure"] > 0.9
    assert a["datetime_profile"].first()["monotonic_increasing"] is True
    assert a["warnings"].count() == 0
    assert {r["level"] for r in a["findings"].collect()} == {"Fact", "Limitation"}
    assert [r["degree"] for r in a["network_nodes"].collect()] == [1, 1]
    folders = a.write(str(tmp_path / "result"))
    assert set(folders) == set(a.tables)
    assert spark.read.json(folders["schema"]).count() == 4


def test_analysis_with_overrides_and_pairs(spark, standard):
    a = sk.analyze(standard, overrides={"temperature": "categorical", "time": "ignore"}, pairs=[("x", "y"), ("pressure", "category")])
    assert a.types == {"temperature": "categorical", "pressure": "numeric", "category": "categorical"}
    assert a.default_pair == ("pressure", "category") and a.time_axis is None
    assert "datetime_profile" not in a.tables
    with pytest.raises(ValueError):
        sk.analyze(standard, threshold=2.0)


def test_thousands_are_numbers_in_the_profile(spark):
    df = spark.createDataFrame([(f"{i},{i:03d}",) for i in range(1, 60)], "price string")
    a = sk.analyze(df)
    assert a.types == {"price": "numeric"} and a["numeric_profile"].first()["max"] == 59059.0


def test_analysis_of_degenerate_tables(spark):
    one = sk.analyze(spark.createDataFrame([("only",)], "c string"))
    assert one.default_pair is None and one.usable == ["c"] and "pearson_matrix" not in one.tables
    empty = sk.analyze(spark.createDataFrame([], "a double, b string"))
    assert empty["dataset"].first()["rows"] == 0 and empty.usable == ["a", "b"]
    for t in empty.tables.values():
        t.collect()


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_csv_scan_keeps_late_cells_other_column_orders_and_long_integers(spark, tmp_path):
    from skimlark.sources.delimited import csv_scan

    (tmp_path / "a.csv").write_text("name,amount\n" + "".join(f"n{i},{i}\n" for i in range(40)) + "late,7,extra\n")
    (tmp_path / "b b.csv").write_text("amount,name,id\n" + "".join(f"{i},m{i},{1234567890123456789 + i}\n" for i in range(40)))
    got = csv_scan(spark, str(tmp_path), header=0)
    rows = {r["name"]: r for r in got.collect()}
    assert rows["m5"]["amount"] == 5 and rows["m5"]["id"] == 1234567890123456794 and dict(got.dtypes)["id"] == "bigint"
    assert "extra" in rows["late"].asDict().values() and len(rows) == 81
    (tmp_path / "c.csv").write_text("id\n" + "12345678901234567890\n12345678901234567891\n")
    assert csv_scan(spark, str(tmp_path / "c.csv"), header=0).distinct().count() == 2
