"""Type inference, conversions and quality rules on small hand-made tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import skimlark as sk
from skimlark.operators.types import date_hint, id_hint


def types_of(spark, pdf, **how):
    return sk.type_map(spark.createDataFrame(pdf), **how)


def test_cascade(spark):
    n = 200
    pdf = pd.DataFrame({
        "empty": pd.Series([None] * n, dtype=object), "same": ["x"] * n, "flag": ["Yes", " no "] * (n // 2),
        "order_id": range(n), "amount": np.linspace(0, 1, n), "typed": [f"{i},{i:03d}" for i in range(n)],
        "zip": [f"0{i:04d}" for i in range(n)], "day": [f"2026-{i % 12 + 1}-{i % 28 + 1:02d}" for i in range(n)],
        "code": [f"C{i}" for i in range(n)], "city": ["a", "b", "c", "d"] * (n // 4),
        "note": [f"remark number {i}" for i in range(n)], "half": [f"v{i // 3}" for i in range(n)]})
    pdf["empty"] = pdf["empty"].astype("string")
    got = types_of(spark, pdf)
    assert got == {
        "empty": "unknown", "same": "constant", "flag": "boolean", "order_id": "id_like", "amount": "numeric",
        "typed": "numeric", "zip": "text", "day": "datetime", "code": "id_like", "city": "categorical",
        "note": "text", "half": "categorical"}


def test_name_hints():
    assert id_hint("user_id") and id_hint("编号") and id_hint("Serial") and not id_hint("l_orderkey") and not id_hint("valid")
    assert date_hint("LastUpdateTime") and date_hint("日期") and not date_hint("value")


def test_override_and_bad_override(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, s string")
    assert sk.type_map(df, overrides={"n": "categorical"})["n"] == "categorical"
    with pytest.raises(ValueError):
        sk.infer_types(df, overrides={"n": "number"})


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([(1.5, "a"), (2.5, "b"), (4.5, "a")], "`a.b` double, `c d` string")
    assert sk.type_map(df) == {"a.b": "numeric", "c d": "categorical"}
    assert sk.numeric_profile(df, ["a.b"]).first()["median"] == 2.5
    assert sk.categorical_profile(df, ["c d"]).first()["top_value"] == "a"


def test_large_integers_are_not_constant(spark):
    df = spark.createDataFrame([(2**60,), (2**60 + 1,)], "big long")
    assert sk.type_map(df)["big"] == "numeric"


def test_coerce(spark):
    df = spark.createDataFrame([("1,234", 0), ("x", 86400000), ("1,2,3", None), (None, 5)], "s string, t long")
    got = sk.coerce_override(df, {"s": "numeric", "t": "datetime"}).collect()
    assert [r["s"] for r in got] == [1234.0, None, None, None]  # only the first comma is dropped
    assert str(got[1]["t"]) == "1970-01-02 00:00:00"
    assert sk.coerce_override(df, {"t": "ignore"}).columns == ["s"]


def stray_table(spark):
    """100 rows: two clean columns, a few headings, a detached block of numbers."""
    rows = [(float(i), float(100 - i), "Heading of a worksheet section" + str(i) if i < 4 else None,
             float(i) if i >= 91 else None) for i in range(100)]
    return spark.createDataFrame(rows, "a double, b double, X8 string, X9 double")


def test_stray_content(spark):
    facts = sk.column_facts(stray_table(spark))
    flags = {(r["column"], r["flag"]): r["severity"] for r in sk.quality_flags(facts).collect()}
    assert flags["X8", "stray_content_candidate"] == flags["X9", "stray_content_candidate"] == "critical"
    assert flags["X8", "high_missing"] == "critical"
    summary = sk.quality_summary(facts).first()
    assert summary["critical"] >= 2 and summary["clean_columns"] == 2
    usable = {r["column"]: r["usable"] for r in sk.usable_columns(facts).collect()}
    assert usable == {"a": True, "b": True, "X8": False, "X9": False}


def test_infinity_and_nan(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,), (3.0,)], "v double")
    p = sk.numeric_profile(df, ["v"]).first()
    assert (p["count"], p["missing_count"], p["finite_count"]) == (4, 2, 2)
    assert (p["positive_infinity_count"], p["negative_infinity_count"]) == (1, 1)
    assert (p["mean"], p["min"], p["max"], p["skewness"]) == (2.0, 1.0, 3.0, None)
    assert [r["flag"] for r in sk.quality_flags(sk.column_facts(df)).collect()] == ["has_missing", "infinity"]


def test_profile_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.lognormal(0, 2, 2000), "b": 1e9 + rng.normal(0, 1, 2000)})
    got = sk.numeric_profile(spark.createDataFrame(pdf), ["a", "b"]).toPandas().set_index("column")
    for c in pdf:
        s = pdf[c]
        want = [s.mean(), s.median(), s.std(), s.var(), s.skew(), s.kurt(), s.quantile(0.25), s.quantile(0.75)]
        have = got.loc[c, ["mean", "median", "std", "variance", "skewness", "kurtosis", "q1", "q3"]].astype(float)
        # near 1e9 the reference mean is itself rounded to 1e-7, which shows in the third moment
        np.testing.assert_allclose(have, want, rtol=1e-9, atol=2e-7)
        low, high = sk.operators.profile.fences(s.quantile(0.25), s.quantile(0.75))
        assert got.loc[c, "outlier_count"] == ((s < low) | (s > high)).sum()


def test_constant_column_profile(spark):
    p = sk.numeric_profile(spark.createDataFrame([(2.0,)] * 5, "v double"), ["v"]).first()
    assert (p["std"], p["variance"], p["outlier_count"], p["skewness"]) == (0.0, 0.0, 0, None)


@pytest.mark.parametrize("values", [
    "array(1, null), array(null, 1), array(1), cast(null as array<int>), array(), array(1)",
    "array(array(1), array(2)), array(array(1, 2)), array(array(1), array(2)), array(array(1, 2), array()), array(), null",
    "struct(null, 1), struct(1, null), struct(1, 1), struct(null, null), null, struct(1, 1)",
    "map('a', 1), map('a', 2), map('b', 1, 'a', 2), map('a', 2, 'b', 1), map(), map('a', null)"])
def test_nested_values_that_differ_are_no_duplicates(spark, values):
    assert sk.duplicate_rows(spark.sql(f"select explode(array({values})) as v")).first()["duplicate_rows"] == 1


def test_duplicates_are_null_safe(spark):
    rows = [(1, None, 0.0), (1, None, -0.0), (None, 1, 0.0), (1, None, float("nan")), (1, None, float("nan"))]
    got = sk.duplicate_rows(spark.createDataFrame(rows, "a int, b int, c double")).first()
    assert (got["rows"], got["distinct_rows"], got["duplicate_rows"]) == (5, 3, 2)


@pytest.mark.parametrize("bits", [64, 2, 0])
@pytest.mark.parametrize("limit", [100_000, 3, 0])
def test_colliding_fingerprints_are_told_apart(spark, bits, limit):
    """Two bits a hash make nearly all rows collide; a third of the rows are one row."""
    rng = np.random.default_rng(4)
    rows = [(1, "hot", [1.0]) if i % 3 == 0 else (int(rng.integers(0, 40)), "x" * int(rng.integers(0, 3)), [float(rng.integers(0, 2))]) for i in range(900)]
    rows += [(None, None, None), (None, None, None), (None, "", [])]
    df = spark.createDataFrame(rows, "a int, b string, c array<double>")
    got = sk.duplicate_rows(df, proof=True, bits=bits, config=sk.Config(broadcast_rows=limit)).first()
    distinct = len({(a, b, None if c is None else tuple(c)) for a, b, c in rows})
    assert (got["rows"], got["distinct_rows"], got["duplicate_rows"]) == (903, distinct, 903 - distinct)


@pytest.mark.parametrize("values", ["map('a', 1, 'b', 2), map('b', 2, 'a', 1), map('a', 1), null", "struct(null, 1), struct(1, null), struct(1, null), null"])
def test_proof_of_nested_rows(spark, values):
    df = spark.sql(f"select explode(array({values})) as v")
    assert [sk.duplicate_rows(df, proof=True, bits=b).first()["duplicate_rows"] for b in (64, 0)] == [1, 1]


def test_proof_of_an_empty_table(spark):
    got = sk.duplicate_rows(spark.createDataFrame([], "a int"), proof=True).first()
    assert (got["rows"], got["distinct_rows"], got["duplicate_rate"]) == (0, 0, 0.0)


def test_dataset_profile_counts(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("nan"), None), (1.0, None)], "a double, b string")
    p = sk.dataset_profile(df).first()
    assert (p["rows"], p["columns"], p["missing_cells"], p["fully_empty_rows"], p["fully_empty_columns"]) == (4, 2, 6, 2, 1)
    assert (p["duplicate_rows"], p["missing_rate"]) == (2, 0.75)


def test_top_values_of_long_texts(spark):
    long_a, long_b = "same forty character beginning of a text: " + "a" * 50, "same forty character beginning of a text: " + "b" * 50
    df = spark.createDataFrame([(long_a,), (long_b,), (long_b,), ("short",), (None,)], "t string")
    p = sk.categorical_profile(df, ["t"]).first()
    assert (p["unique_count"], p["top_value"], p["top_count"], p["missing_count"]) == (3, long_b, 2, 1)
    assert {t["value"] for t in p["top_values"]} == {long_a, long_b, "short"}


def test_datetime_order_needs_order_by(spark):
    rows = [(1, "2026-01-01"), (2, "2026-01-02"), (2, "2026-01-03"), (3, "2026-01-03"), (4, None)]
    df = spark.createDataFrame(rows, "i int, d string").withColumn("d", F.to_timestamp_ntz("d"))
    p = sk.datetime_profile(df, ["d"]).first()
    assert (p["monotonic_increasing"], p["duplicate_timestamp_count"], p["missing_count"]) == (None, 1, 1)
    assert p["median_interval_us"] == 86400e6
    assert sk.datetime_profile(df, ["d"], order_by=["i"]).first()["monotonic_increasing"] is True
    down = df.withColumn("i", -F.col("i"))
    assert sk.datetime_profile(down, ["d"], order_by=["i"]).first()["monotonic_increasing"] is False


def test_datetime_profile_range_parts(spark):
    rng = np.random.default_rng(2)
    stamps = pd.Series(pd.to_datetime("2026-01-01") + pd.to_timedelta(rng.integers(0, 400, 500), unit="min"))
    df = spark.createDataFrame(pd.DataFrame({"i": range(500), "t": stamps}))
    p = sk.datetime_profile(df, ["t"], order_by=["i"], config=sk.Config(single_task_rows=40)).first()
    ordered = stamps.sort_values()
    assert p["median_interval_us"] == ordered.diff().dropna().median().total_seconds() * 1e6
    assert p["duplicate_timestamp_count"] == stamps.duplicated().sum()
    assert p["monotonic_increasing"] is False


@pytest.mark.parametrize("config", [sk.Config(), sk.Config(single_task_rows=40)])
def test_datetime_columns_together(spark, config):
    """Kinds of time, nulls, a constant and an empty column in one call equal pandas, column by column."""
    rng = np.random.default_rng(8)
    days = pd.Series(pd.to_datetime("2025-01-01") + pd.to_timedelta(rng.integers(0, 90, 300), unit="D"))
    pdf = pd.DataFrame({"i": range(300), "day": days.dt.date, "up": pd.to_datetime("2025-06-01") + pd.to_timedelta(np.arange(300) // 2, unit="h"),
                        "gappy": days.where(rng.random(300) < 0.4), "same": pd.Timestamp("2025-03-03 04:05:06"), "none": pd.NaT, "one": pd.NaT})
    pdf.loc[7, "one"] = pd.Timestamp("2025-02-02")
    df = spark.createDataFrame(pdf, "i long, day date, up timestamp, gappy timestamp_ntz, same timestamp, none timestamp, one timestamp_ntz").repartition(5)
    names = ["day", "up", "gappy", "same", "none", "one"]
    got = sk.datetime_profile(df, names, order_by=["i"], config=config).collect()
    assert [r["column"] for r in got] == names
    for r in got:
        v = pd.to_datetime(pdf[r["column"]]).dropna()
        gaps = v.sort_values().diff().dropna()
        assert (r["count"], r["missing_count"], r["duplicate_timestamp_count"]) == (len(v), 300 - len(v), v.duplicated().sum())
        assert r["median_interval_us"] == (gaps.median().total_seconds() * 1e6 if len(gaps) else None)
        assert r["span_us"] == ((v.max() - v.min()).total_seconds() * 1e6 if len(v) > 1 else None)
        assert r["earliest"] == (v.min().strftime("%Y-%m-%dT%H:%M:%S.%f") if len(v) else None)
        assert r["monotonic_increasing"] == (bool(v.is_monotonic_increasing) if len(v) else None)


def test_datetime_jobs_do_not_grow_with_the_columns(spark):
    df = spark.range(200).select("id", *[F.timestamp_micros(F.col("id") * 1000 * k).alias(f"t{k}") for k in range(1, 13)])
    context, jobs = spark.sparkContext, []
    for k in (2, 12):
        context.setJobGroup(f"dates-{k}", "")
        sk.datetime_profile(df, [f"t{i}" for i in range(1, k + 1)], order_by=["id"]).collect()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"dates-{k}")))
    context.setJobGroup("", "")
    assert jobs[1] <= jobs[0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "a double, s string, t timestamp_ntz")
    assert set(sk.type_map(df).values()) == {"unknown"}
    assert sk.numeric_profile(df, ["a"]).first()["count"] == 0
    assert sk.categorical_profile(df, ["s"]).first()["unique_count"] == 0
    assert sk.datetime_profile(df, ["t"]).first()["earliest"] is None
    assert sk.dataset_profile(df).first()["missing_rate"] == 0.0
    assert {r["flag"] for r in sk.quality_flags(sk.column_facts(df)).collect()} == {"all_missing"}


def test_nested_and_wide(spark):
    df = spark.createDataFrame([([1.0], {"k": 1})], "v array<double>, m map<string,int>")
    assert set(sk.type_map(df).values()) == {"unknown"}
    wide = spark.range(20).select(*[(F.col("id") * i).cast("double").alias(f"c{i}") for i in range(1, 151)])
    assert set(sk.type_map(wide).values()) == {"numeric"}
    assert sk.numeric_profile(wide, wide.columns).count() == 150
