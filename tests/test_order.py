"""Global order primitives: the distributed form must equal the plain one."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skimlark.config import Config
from skimlark.functions.exprs import finite
from skimlark.functions.order import attach_groups, exact_quantiles, previous_value, running_total

TINY = Config(single_task_rows=50, broadcast_rows=1000, sketch_k=64, sketch_slack=0.05)
PROBS = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)


def skewed(n=3000, seed=1):
    """A third of all rows hold one value and one group."""
    rng = np.random.default_rng(seed)
    v = np.where(rng.random(n) < 0.34, 7.0, rng.lognormal(2, 3, n))
    w = np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, 5, n).astype(float))
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abc"), n))
    return pd.DataFrame({"g": g, "v": v, "w": w})


@pytest.mark.parametrize("config", [Config(), TINY, Config(single_task_rows=50, sketch_k=8, sketch_slack=0.0)])
def test_quantiles_equal_numpy(spark, config):
    """Also with brackets that miss their target: slack 0 and a coarse sketch."""
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = {r["column"]: r for r in exact_quantiles(
        df, {c: finite(df, c) for c in ("v", "w")}, PROBS, config=config).collect()}
    for c in ("v", "w"):
        values = pdf[c].dropna()
        assert got[c]["n"] == len(values)
        np.testing.assert_allclose(got[c]["q"], np.quantile(values, PROBS), rtol=1e-12)


@pytest.mark.parametrize("config", [Config(), TINY])
def test_grouped_quantiles(spark, config):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, {c: finite(df, c) for c in ("v", "w")}, PROBS, by=["g"], config=config).collect()
    assert len(got) == 8
    for r in got:
        values = pdf[pdf.g == r["g"]][r["column"]].dropna()
        assert r["n"] == len(values)
        np.testing.assert_allclose(r["q"], np.quantile(values, PROBS), rtol=1e-12)


def many_groups():
    """300 groups, of which one has a third of the rows."""
    rng = np.random.default_rng(12)
    g = np.where(rng.random(4000) < 0.34, 0, rng.integers(1, 300, 4000))
    return pd.DataFrame({"g": g, "h": g % 7, "v": np.where(rng.random(4000) < 0.05, np.nan, rng.lognormal(1, 2, 4000))})


@pytest.mark.parametrize("limit", [0, 1, 20, 1000])
def test_quantiles_of_more_groups_than_are_broadcast(spark, limit):
    pdf = many_groups()
    config = Config(single_task_rows=50, broadcast_rows=limit, sketch_k=64, sketch_slack=0.05)
    df = spark.createDataFrame(pdf)
    got = exact_quantiles(df, {"v": finite(df, "v")}, PROBS, by=["g", "h"], config=config).collect()
    assert len(got) == pdf.dropna().g.nunique()
    for r in got:
        values = pdf[pdf.g == r["g"]].v.dropna()
        assert r["n"] == len(values)
        np.testing.assert_allclose(r["q"], np.quantile(values, PROBS), rtol=1e-12)


def test_hot_group_is_no_single_task(spark):
    pdf = many_groups()
    base = spark.createDataFrame(pdf).repartition(8)
    table = base.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"))
    joined = attach_groups(base, table, ["g"], "n", Config(broadcast_rows=20))
    assert joined.count() == len(pdf)
    hot = joined.where("g = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(hot) == 8 and max(r["count"] for r in hot) < (pdf.g == 0).sum() / 4


def test_column_without_values_is_left_out(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)] * 40, "a double, b double")
    for config in (Config(), TINY):
        got = exact_quantiles(df, {c: finite(df, c) for c in "ab"}, config=config).collect()
        assert [r["column"] for r in got] == ["a"]


@pytest.mark.parametrize("rows", [10, 10_000])
def test_running_total_and_previous(spark, rows):
    """``rows`` only steers the plan: below the limit one window, above it range parts."""
    pdf = pd.DataFrame({"k": ["x", "y"] * 300, "o": np.random.default_rng(3).permutation(600), "c": np.arange(600)})
    df = spark.createDataFrame(pdf)
    ordered = pdf.sort_values(["k", "o"])
    total = running_total(df, ["k"], ["o"], "c", rows, TINY).toPandas().sort_values(["k", "o"])
    want = ordered.groupby("k").c.cumsum() - ordered.c
    assert total.before.tolist() == want.tolist()
    before = previous_value(df, ["k"], ["o"], "c", rows, TINY).toPandas().sort_values(["k", "o"])
    want = ordered.groupby("k").c.shift()
    np.testing.assert_array_equal(before.previous.to_numpy(float), want.to_numpy(float))


def test_large_plans_have_no_single_task_window(spark):
    df = spark.range(10_000).select(F.lit(0).alias("_one"), F.col("id").alias("o"), F.lit(1).alias("c"))
    plan = running_total(df, ["_one"], ["o"], "c", 10_000, TINY)._jdf.queryExecution().executedPlan().toString()
    window = [line for line in plan.splitlines() if "Window" in line]
    assert window and all("_part" in line for line in window)
    assert "SinglePartition" not in plan


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=120), st.integers(1, 7))
def test_quantiles_do_not_depend_on_partitioning(spark, values, parts):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
    got = exact_quantiles(df, {"v": F.col("v")}, PROBS, config=TINY).first()["q"]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-9, atol=1e-9)
