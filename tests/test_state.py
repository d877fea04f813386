"""Profile states: merged parts equal the whole, and both equal pandas."""

from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import skimlark as sk

EXACT = ["rows", "count", "missing_count", "finite_count", "positive_infinity_count", "negative_infinity_count", "zero_count", "min", "max", "earliest",
         "latest", "avg_len"]
CLOSE = ["mean", "std", "variance", "skewness", "kurtosis", "q1_estimate", "median_estimate", "q3_estimate"]


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(2)
    n = 4000
    out = pd.DataFrame({"far": rng.normal(1e9, 1, n), "skewed": rng.exponential(3, n), "whole": rng.integers(-5, 5, n), "one": np.ones(n),
                        "word": rng.choice(["a", "bb", "ccc"], n), "t": pd.Timestamp("2026-01-01") + pd.to_timedelta(rng.integers(0, 10**6, n), unit="s")})
    out.loc[rng.random(n) < 0.2, "skewed"] = np.nan
    out.loc[3, "skewed"] = np.inf
    out["gone"] = np.nan
    return out


def table(state):
    return {r["column"]: r.asDict() for r in sk.profile_of_state(state).collect()}


def test_merged_parts_are_the_whole(spark, pdf):
    df = spark.createDataFrame(pdf)
    whole = table(sk.profile_state(df))
    parts = [df.where("whole < -2"), df.where("whole >= -2 AND whole < 4"), df.where("whole >= 4"), df.where("false")]
    merged = table(sk.merge_states(*[sk.profile_state(p) for p in parts]))
    again = table(sk.merge_states(sk.merge_states(*[sk.profile_state(p) for p in parts[:2]]), sk.profile_state(parts[2])))
    for other in (merged, again):
        assert other.keys() == whole.keys()
        for c, row in whole.items():
            assert {k: row[k] for k in EXACT} == {k: other[c][k] for k in EXACT}, c
            # a merged sketch estimates without its history: near, not the same
            assert other[c]["distinct_estimate"] == pytest.approx(row["distinct_estimate"], rel=0.02)
            for k in CLOSE:
                assert other[c][k] == (None if row[k] is None else pytest.approx(row[k], rel=1e-6, abs=1e-6)), (c, k)


def test_state_equals_pandas(spark, pdf):
    got = table(sk.profile_state(spark.createDataFrame(pdf)))
    clean = pdf.replace([np.inf, -np.inf], np.nan)
    for c in ("far", "skewed", "whole"):
        assert got[c]["std"] == pytest.approx(clean[c].std(), rel=1e-9)
        assert got[c]["skewness"] == pytest.approx(clean[c].skew(), abs=1e-9)
        assert got[c]["kurtosis"] == pytest.approx(clean[c].kurt(), abs=1e-9)
        assert abs((clean[c] <= got[c]["median_estimate"]).sum() / clean[c].count() - 0.5) < 0.15 if c == "whole" else True
    assert got["skewed"]["positive_infinity_count"] == 1 and got["one"]["std"] == 0 and got["gone"]["mean"] is None
    assert (got["word"]["distinct_estimate"], got["t"]["earliest"][:10]) == (3, "2026-01-01")


def test_distinct_estimates_stay_within_their_bound(spark):
    df = spark.range(200_000).select(F.col("id"), (F.col("id") % 30_000).alias("few"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    got = {r["column"]: r["distinct_estimate"] for r in sk.approximate_distinct(df).collect()}
    for c, want in (("id", 200_000), ("few", 30_000), ("text", 200_000)):
        assert abs(got[c] - want) / want < 4 * 0.0082


def test_columns_that_a_batch_lacks(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2.5,)], "n double")
    got = table(sk.merge_states(sk.profile_state(a), sk.profile_state(b)))
    assert (got["n"]["mean"], got["n"]["rows"], got["s"]["rows"]) == (1.75, 2, 1)


def test_batches_of_a_stream_update_a_written_state(spark, tmp_path):
    """Each batch is folded into the state beside the data, as a job or ``foreachBatch`` would."""
    df = spark.range(900).select((F.col("id") * 0.5).alias("v"))
    path = str(tmp_path / "state-0")
    sk.profile_state(df.where("v < 100")).write.parquet(path)
    for k, part in enumerate(("v >= 100 AND v < 300", "v >= 300"), 1):
        new = sk.merge_states(spark.read.parquet(path), sk.profile_state(df.where(part)))
        path = str(tmp_path / f"state-{k}")
        new.write.parquet(path)
    got, want = table(spark.read.parquet(path))["v"], table(sk.profile_state(df))["v"]
    assert (got["rows"], got["max"], got["mean"]) == (900, want["max"], pytest.approx(want["mean"]))
    assert got["variance"] == pytest.approx(want["variance"])


def test_moments_far_from_zero_keep_their_digits(spark, pdf):
    """Against exact fractions: pandas' own skewness of ``far`` is off by 4e-8."""
    x = [Fraction(float(v)) for v in pdf["far"]]
    n, mean = len(x), sum(x) / len(x)
    m2, m3, m4 = (float(sum((v - mean) ** k for v in x) / n) for k in (2, 3, 4))
    got = table(sk.profile_state(spark.createDataFrame(pdf)))["far"]
    assert got["std"] == pytest.approx((m2 * n / (n - 1)) ** 0.5, rel=1e-12) and got["mean"] == pytest.approx(float(mean), rel=1e-15)
    assert got["skewness"] == pytest.approx(m3 / m2**1.5 * (n * (n - 1)) ** 0.5 / (n - 2), abs=1e-12)
    assert got["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / m2**2 - 3) + 6), abs=1e-11)
