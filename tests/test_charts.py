"""Chart numbers against brute force."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import skimlark as sk
from skimlark.config import Config
from skimlark.operators import sampling

TINY = Config(single_task_rows=50)


@pytest.fixture(scope="module")
def runs(spark):
    """Values in order, a third of all rows in one long run of equal rows."""
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 1, 200), np.full(200, 3.0), rng.integers(0, 3, 200).astype(float)])
    t = np.concatenate([np.arange(200), np.full(200, 200), np.arange(201, 401)])
    return pd.DataFrame({"t": t, "v": v})


def brute_acf(v, lags):
    d = v - v.mean()
    return {k: (d[:len(d) - k] * d[k:]).sum() / (d * d).sum() for k in lags}


@pytest.mark.parametrize("config", [Config(), TINY])
def test_acf(spark, runs, config):
    got = {r["lag"]: r["acf"] for r in sk.acf(spark.createDataFrame(runs), "v", order_by=["t"], config=config).collect()}
    want = brute_acf(runs.sort_values(["t", "v"]).v.to_numpy(), (0, 2, 4, 6, 8))
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in want], list(want.values()), atol=1e-10)


def test_acf_edges(spark):
    few = spark.createDataFrame([(i, 1.0) for i in range(7)], "t int, v double")
    assert sk.acf(few, "v", order_by=["t"]).count() == 0
    flat = spark.createDataFrame([(i, 1.0) for i in range(9)], "t int, v double")
    assert {r["lag"]: r["acf"] for r in sk.acf(flat, "v", order_by=["t"]).collect()} == {0: 1.0, 2: 0.0}


@pytest.mark.parametrize("config", [Config(), TINY])
def test_qq(spark, runs, config):
    got = sk.qq_points(spark.createDataFrame(runs), "v", points=100, config=config).toPandas().sort_values("i")
    ordered = np.sort(runs.v.to_numpy())
    n, step = len(ordered), len(ordered) // 100
    assert got.i.tolist() == list(range(0, n, step))
    np.testing.assert_array_equal(got.value, ordered[::step])
    from statistics import NormalDist
    z = [NormalDist().inv_cdf((i + 0.5) / n) for i in range(0, n, step)]
    np.testing.assert_allclose(got.z, z, atol=1e-8)
    assert sk.qq_points(spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double"), "v").count() == 0


def test_histogram(spark, runs):
    df = spark.createDataFrame(runs)
    bins = sk.histogram(df, "v").toPandas().sort_values("bin")
    assert len(bins) == 24 and bins["count"].sum() == 600
    counts, edges = np.histogram(runs.v, bins=24)
    np.testing.assert_allclose(bins.x0, edges[:-1])
    assert bins["count"].tolist() == counts.tolist()
    flat = sk.histogram(spark.createDataFrame([(2.0,)] * 4, "v double"), "v").toPandas()
    assert len(flat) == 5 and flat.x0.min() == 1.5 and flat["count"].sum() == 4
    assert sk.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_kde(spark, runs):
    curve = sk.kde(spark.createDataFrame(runs), "v").toPandas().sort_values("point")
    v = runs.v
    h = 1.06 * min(v.std(), (v.quantile(0.75) - v.quantile(0.25)) / 1.34) * len(v) ** -0.2
    x = np.linspace(v.min(), v.max(), 121)
    want = np.exp(-0.5 * ((x[:, None] - v.to_numpy()) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(curve.density, want, rtol=1e-9)
    assert sk.kde(spark.createDataFrame([(2.0,)] * 4, "v double"), "v").count() == 0


@pytest.mark.parametrize("config", [Config(), TINY])
def test_boxes(spark, config):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": np.where(rng.random(900) < 0.4, "hot", rng.choice(list("abcdefghijklmnop"), 900)),
                        "c": rng.choice(["x", "y", None], 900), "y": rng.standard_cauchy(900)})
    pdf.loc[len(pdf)] = ["rare", "x", 1.0]
    df = spark.createDataFrame(pdf)
    got = sk.group_box(df, "y", "g", config=config).toPandas().set_index("category")
    top = pdf.groupby("g").size().reset_index(name="n").sort_values(["n", "g"], ascending=[False, True]).head(12)
    assert set(got.index) == set(top.g)
    for g, r in got.iterrows():
        y = pdf[pdf.g == g].y
        q1, q3 = y.quantile(0.25), y.quantile(0.75)
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        np.testing.assert_allclose([r["n"], r["q1"], r["median"], r["q3"], r["outliers"]],
                                   [len(y), q1, y.median(), q3, ((y < low) | (y > high)).sum()])
    facets = sk.facet_box(df, "y", "g", "c", config=config).toPandas()
    assert set(facets.x) <= set(sorted(pdf.g.unique())[:9]) and set(facets.colour) == {"x", "y"}


def test_category_pairs_drop_nulls(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), ("b", "y"), (None, "x"), ("b", "y")], "p string, q string")
    got = {(r["a"], r["b"]): r["count"] for r in sk.contingency(df, "p", "q").collect()}
    assert got == {("a", "x"): 1, ("a", "y"): 0, ("b", "x"): 0, ("b", "y"): 2}
    with_null = {(r["a"], r["b"]): r["count"] for r in sk.contingency(df, "p", "q", include_null=True).collect()}
    assert with_null["a", "nan"] == 1 and sum(with_null.values()) == 5


def test_other_is_the_true_remainder(spark):
    rows = [(f"v{i:02d}",) for i in range(20) for _ in range(20 - i)]
    df = spark.createDataFrame(rows, "c string")
    full = {r["value"]: r["count"] for r in sk.top5_with_other(df, "c").collect()}
    assert full["Other"] == sum(range(1, 16)) and full["v00"] == 20
    capped = {r["value"]: r["count"] for r in sk.top5_with_other(df, "c", cap=10).collect()}
    assert capped["Other"] == 15 + 14 + 13 + 12 + 11


def test_sample_is_exact_seeded_and_partition_free(spark):
    df = spark.range(5000).withColumn("x", F.col("id") % 7)
    ids = lambda d: sorted(r["id"] for r in d.collect())
    first = ids(sk.sample_rows(df, 100, seed=1, key=["id"]))
    assert len(set(first)) == 100
    assert first == ids(sk.sample_rows(df.repartition(13), 100, seed=1, key=["id"]))
    assert first != ids(sk.sample_rows(df, 100, seed=2, key=["id"]))
    assert ids(sk.sample_rows(df, 5000)) == list(range(5000))
    assert sk.sample_rows(df.select("x"), 123).count() == 123  # equal rows draw apart
    facts = sk.sample_facts(df, 100).first()
    assert (facts["original_count"], facts["plotted_count"], facts["sampled"]) == (5000, 100, True)
    ordered = [r["id"] for r in sk.sample_rows(df, 50, key=["id"], order_by=["id"]).collect()]
    assert ordered == sorted(ordered)


def test_scatter_keeps_colour_with_its_row(spark):
    df = spark.createDataFrame([(1.0, 2.0, "r"), (None, 3.0, "g"), (4.0, float("inf"), "g"), (5.0, 6.0, "b")],
                               "x double, y double, c string")
    got = {(r["x"], r["y"], r["colour"]) for r in sk.scatter(df, "x", "y", colour="c").collect()}
    assert got == {(1.0, 2.0, "r"), (5.0, 6.0, "b")}


def test_relationship_choice(spark):
    df = spark.createDataFrame([(1.0, "a", "u", 1), (2.0, "b", "u", 2), (3.0, "a", "v", 3), (4.0, "a", "v", 4)],
                               "n double, c string, d string, m int")
    types = {"n": "numeric", "m": "numeric", "c": "categorical", "d": "categorical", "t": "text"}
    pick = lambda a, b, **k: sk.relationship(df, a, b, types, **k)[0]
    assert pick("n", "m") == "scatter" and pick("c", "n") == "group_box" and pick("c", "d") == "contingency"
    assert pick("n", "c", colour="d") == "grouped_box" and pick("c", "d", colour="c") == "stacked_bar"
    assert sk.relationship(df, "n", "t", types) == ("unsupported", None)


def test_large_samples_are_exact_without_one_task(spark, monkeypatch):
    """The n-th draw is found by counting, also when ranges are coarse and many rows draw alike."""
    monkeypatch.setattr(sampling, "RANGES", 3)
    monkeypatch.setattr(sampling, "LAST_ROWS", 5)
    df = spark.range(4000).withColumn("same", F.lit(1)).repartition(7)
    want = sorted(range(4000), key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
    for n in (1, 37, 2500, 3999):
        got = sorted(r["id"] for r in sk.sample_rows(df, n, seed=9, key=["id"]).collect())
        assert got == sorted(want[:n])
        assert got == sorted(r["id"] for r in sk.sample_rows(df, n, seed=9, key=["id"], config=Config(broadcast_rows=0)).collect())
        assert sk.sample_rows(df, n, seed=9).distinct().count() == n
    same = sk.sample_rows(df, 1234, key=["same"], config=Config(broadcast_rows=0))
    assert same.select("id").distinct().count() == 1234  # all rows draw the same number


def pixels(points, lo, hi, low, high, width=40, height=30):
    """Pixels that the line through the points covers, column by column."""
    xy = [((x - lo) / (hi - lo) * width, (y - low) / ((high - low) or 1) * (height - 1)) for x, y in points]
    out = set()
    for (x0, y0), (x1, y1) in zip(xy, xy[1:]):
        for c in range(min(int(x0), width - 1), min(int(x1), width - 1) + 1):
            a, b = max(x0, c), min(x1, c + 1)
            ends = [y0 + (y1 - y0) * ((x - x0) / (x1 - x0) if x1 > x0 else k) for k, x in enumerate((a, b))]
            out |= {(c, r) for r in range(int(min(ends) + 1e-9), int(max(ends) - 1e-9) + 1)}
    return out


def test_points_draw_the_same_line(spark):
    rng = np.random.default_rng(8)
    t = np.sort(rng.integers(0, 10**9, 3000))
    v = np.round(np.cumsum(rng.normal(0, 1, 3000)), 2)
    base = pd.Timestamp("2026-01-01")
    df = spark.createDataFrame(pd.DataFrame({"t": base + pd.to_timedelta(t, unit="us"), "v": v}))
    got = sk.time_series(df, "t", "v", points=40).toPandas()
    assert len(got) <= 160
    x = (pd.to_datetime(got["t"]) - base) // pd.Timedelta(microseconds=1)
    kept, every = list(zip(x, got["value"])), sorted(zip(t.tolist(), v.tolist()))
    bounds = int(t.min()), int(t.max()), v.min(), v.max()
    assert set(kept) <= set(every)
    assert pixels(kept, *bounds) == pixels(every, *bounds)
    lines = sk.line_series(df, "v", order_by=["t", "v"], points=10)
    assert lines.count() <= 40 and lines.agg(F.max("value")).first()[0] == v.max()
    assert sk.time_series(df.limit(0), "t", "v", points=5).count() == 0
