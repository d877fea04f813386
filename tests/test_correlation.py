"""Correlations against pandas, on gaps, ties and skew, on every physical path."""

import os
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

import skimlark as sk
from skimlark.config import Config
from skimlark.functions import cube, order

PATHS = {
    "rows_expressions": Config(pairs_per_pass=300),
    "rows_products": Config(pairs_per_pass=1),
    "values_broadcast": Config(single_task_rows=100, pairs_per_pass=1),
    "values_hot_and_cold": Config(single_task_rows=100, broadcast_rows=40, pairs_per_pass=300),
    "cube": Config(columns_per_pass=2, pairs_per_pass=1),
    "cube_in_parts": Config(columns_per_pass=2, single_task_rows=300),
}


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 1500
    a = rng.normal(0, 1, n)
    out = pd.DataFrame({
        "a": a, "b": a + rng.normal(0, 1, n),
        "hot": np.where(rng.random(n) < 0.35, 0.0, rng.normal(5, 1, n)),  # a third of the rows tied
        "few": rng.integers(0, 4, n).astype(float), "c": np.exp(-a) + rng.normal(0, 0.1, n)})
    out["b_gap"] = out.b.where(rng.random(n) > 0.3)
    out["b_twin"] = (-out.b).where(out.b_gap.notna())  # same gaps as b_gap
    out["b_inner"] = out.c.where(out.b_gap.notna() & (rng.random(n) > 0.3))  # gaps contain those of b_gap
    out["other"] = out.c.where(rng.random(n) > 0.4)
    return out


@pytest.mark.parametrize("path", list(PATHS))
@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_matrix_equals_pandas(spark, pdf, method, path):
    df = spark.createDataFrame(pdf)
    got = sk.correlation_matrix(df, list(pdf), method, config=PATHS[path]).toPandas()
    want = pdf.corr(method=method)
    assert len(got) == len(pdf.columns) ** 2
    for r in got.itertuples():
        assert r.r == pytest.approx(want.loc[r.feature_a, r.feature_b], abs=1e-9), (r.feature_a, r.feature_b)
        assert r.n == (pdf[r.feature_a].notna() & pdf[r.feature_b].notna()).sum()


@pytest.mark.parametrize("path", list(PATHS))
def test_no_spread_and_infinities(spark, path):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 3.0, 4.0, np.inf] * 60, "one": [5.0] * 300, "y": [2.0, 4.0, 6.0, 9.0, 1.0] * 60,
                        "gone": [np.nan] * 300})
    df = spark.createDataFrame(pdf)
    for method in ("pearson", "spearman"):
        got = {(r["feature_a"], r["feature_b"]): (r["n"], r["r"]) for r in
               sk.correlation_matrix(df, list(pdf), method, config=PATHS[path]).collect()}
        assert got["x", "one"] == (240, None) and got["x", "gone"] == (0, None)
        clean = pdf.replace(np.inf, np.nan)
        assert got["x", "y"][1] == pytest.approx(clean.corr(method=method).loc["x", "y"], abs=1e-12)


@pytest.mark.parametrize("held", [2_000_000, 400])
def test_forty_columns_of_random_gaps(spark, monkeypatch, held):
    """1560 (column, mask) rankings in a fixed number of jobs; ``held`` decides which values count as frequent."""
    monkeypatch.setattr(cube, "HELD", held)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({f"c{i}": np.round(rng.normal(0, 1, 800) + i * (i % 3) * rng.random(800), 1 + i % 2) for i in range(40)})
    pdf = pdf.where(rng.random(pdf.shape) > 0.3 * rng.random(40))
    got = sk.spearman_matrix(spark.createDataFrame(pdf), list(pdf)).toPandas()
    want = pdf.corr(method="spearman")
    assert len(got) == 1600
    assert max(abs(r.r - want.loc[r.feature_a, r.feature_b]) for r in got.itertuples()) < 1e-9


def on_disk(spark) -> int:
    """Bytes of the session's shuffles and checkpoints."""
    order.shared_folder(spark)
    tops = [f.getPath() for f in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    tops.append(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sum(os.path.getsize(os.path.join(d, f)) for top in tops for d, _, files in os.walk(top) for f in files)


@pytest.mark.parametrize("gaps, config", [(0.2, Config(columns_per_pass=2)), (0, Config(single_task_rows=1000, broadcast_rows=100))])
def test_ranks_leave_no_copy_of_the_rows(spark, gaps, config):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({f"c{i}": rng.normal(0, 1, 30_000) for i in range(8)})
    df = spark.createDataFrame(pdf.where(rng.random(pdf.shape) >= gaps))
    before = on_disk(spark)
    sk.spearman_matrix(df, list(pdf), config=config).collect()
    assert on_disk(spark) - before < 100_000  # 30000 rows of 8 doubles are 1.9 MB


def test_ranks_pass_as_small_differences():
    """16 ranks of a cell take about a byte each instead of eight."""
    rng = np.random.default_rng(2)
    ranks = np.cumsum(rng.random((5000, 1, 1)) * 40 + rng.random((5000, 1, 16)) < 20, axis=0)[:, 0] * 2 + 2**33
    ranks = np.concatenate([ranks, ranks[-1:], ranks[-1:] + 2**40])  # equal rows, and a wide step
    for some in (ranks, ranks[:1], ranks[:2], ranks[:5000]):
        head, body = cube._packed(some)
        assert (cube._unpacked(head, body, len(some)) == some).all()
    assert len(body) <= 16 * 5000


def test_ranks_of_zeros_and_of_all_signs(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.choice([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300], 400)} | {f"y{i}": rng.normal(0, 1, 400) for i in range(2)})
    pdf["x"] = pdf["x"].replace(-np.inf, np.nan)
    pdf["y0"] += pdf["x"].rank().fillna(0) / 100
    got = sk.spearman_matrix(spark.createDataFrame(pdf), list(pdf), config=Config(columns_per_pass=1, single_task_rows=50)).toPandas()
    want = pdf.corr(method="spearman")
    assert max(abs(r.r - want.loc[r.feature_a, r.feature_b]) for r in got.itertuples()) < 1e-12


def test_avg_rank(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, None, 2.0, 3.0]], "v double")
    got = {r["value"]: (r["count"], r["avg_rank"]) for r in sk.avg_rank(df, "v").collect()}
    assert got == {1.0: (1, 1.0), 2.0: (1, 2.0), 3.0: (3, 4.0)}
    split = {r["value"]: r["avg_rank"] for r in sk.avg_rank(df, "v", config=Config(single_task_rows=2)).collect()}
    assert split == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


def test_pair_stats_needs_three_rows(spark):
    two = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (None, 3.0)], "x double, y double")
    got = sk.pair_stats(two, "x", "y").first()
    assert (got["n"], got["pearson"], got["spearman"]) == (2, None, None)
    three = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 0.0)], "x double, y double")
    got = sk.pair_stats(three, "x", "y").first()
    assert got["pearson"] == pytest.approx(-1) and got["spearman"] == pytest.approx(-1)


def test_network(spark, pdf):
    df = spark.createDataFrame(pdf[["a", "b", "c", "few"]])
    features = ["a", "b", "c", "few"]
    matrix = sk.pearson_matrix(df, features)
    known = pdf[features].corr()
    edge = abs(known.loc["a", "b"])  # a threshold met exactly is met
    edges = {(r["a"], r["b"]): r["r"] for r in sk.network_edges(matrix, features, edge - 1e-12).collect()}
    assert edges.keys() == {(x, y) for x, y in combinations(features, 2) if abs(known.loc[x, y]) >= edge}
    assert all(r == pytest.approx(known.loc[p]) for p, r in edges.items())
    negative = {(r["a"], r["b"]): r["r"] for r in sk.network_edges(matrix, features, 0.3).collect()}
    assert negative["a", "c"] < 0
    degree = {r["feature"]: r["degree"] for r in sk.network_nodes(sk.network_edges(matrix, features, 0.3), features).collect()}
    assert degree == {"a": 2, "b": 2, "c": 2, "few": 0}
    with pytest.raises(ValueError):
        sk.network_edges(matrix, features, 1.5)


def test_feature_lists():
    names = [f"f{i}" for i in range(130)]
    assert sk.feature_selection(names) == names[:10]
    assert sk.feature_selection(names, names[3:5]) == names[3:5]
    with pytest.raises(ValueError):
        sk.feature_selection(names, names[:21])
    with pytest.raises(ValueError):
        sk.feature_selection(names, ["zz"])
    assert sk.bounded_features(names) == (names, False)
    assert sk.bounded_features(names, Config(correlation_max_features=100)) == (names[:100], True)
    drawn = sk.random_features(names)
    assert len(drawn) == 10 and drawn == sk.random_features(names) != sk.random_features(names, seed=7)


def test_completion_keeps_known_values(spark, pdf):
    df = spark.createDataFrame(pdf[["a", "b"]]).selectExpr("a", "b", "string(a * 2) AS text")
    known = spark.createDataFrame([("a", "b", 0.123), ("b", "a", 0.123), ("a", "a", 1.0)], "feature_a string, feature_b string, r double")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in
           sk.matrix_completion(df, known, ["a", "b", "text"], overrides={"text": "numeric"}).collect()}
    assert got["a", "b"] == got["b", "a"] == 0.123 and got["text", "text"] == 1.0
    assert got["a", "text"] == pytest.approx(1.0) and len(got) == 9


def test_usable_numeric(spark):
    df = spark.createDataFrame([(1.0, 1.0, None, 1.0), (2.0, 1.0, 1.0, 2.0), (3.0, 1.0, 2.0, float("inf"))],
                               "ok double, flat double, short double, wild double")
    types = {c: "numeric" for c in df.columns}
    got = {r["column"]: r["usable"] for r in sk.usable_numeric(df, types).collect()}
    assert got == {"ok": True, "flat": False, "short": False, "wild": False}


def test_pearson_is_the_same_beside_other_features(spark):
    """An outlier outside the pair's shared rows must not spoil it, however many features there are."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 200)
    frame = pd.DataFrame({"x": x, "y": x + rng.normal(0, 0.1, 200)} | {f"o{k}": rng.normal(0, 1, 200) for k in range(6)})
    frame.loc[0, ["x", "y"]] = [1e12, np.nan]
    want = frame["x"].corr(frame["y"])
    df = spark.createDataFrame(frame)
    for features in (["x", "y"], ["x", "y", "o0"], list(frame.columns)):
        got = sk.pearson_matrix(df, features).where("feature_a = 'x' AND feature_b = 'y'").first()["r"]
        assert got == pytest.approx(want, abs=1e-9)
