"""Pearson and Spearman matrices, pair statistics, correlation networks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimlark.config import DEFAULT, Config
from skimlark.functions.cube import rank_products
from skimlark.functions.exprs import finite
from skimlark.functions.order import materialize, running_total
from skimlark.operators.types import coerce_override

Pair = tuple[str, str]
METHODS = ("pearson", "spearman")
CANCELLED = 1e-6  # share of a sum of squares below which its spread is measured by deviations


def usable_numeric(df: DataFrame, types: Mapping[str, str], usable: Sequence[str] | None = None) -> DataFrame:
    """``position, column, finite_count, usable`` of the numeric columns.

    Usable: three finite values or more, not all equal, and in the usable set.
    """
    names = [c for c, t in types.items() if t == "numeric"]
    if not names:
        return df.sparkSession.createDataFrame([], "position int, column string, finite_count long, usable boolean")
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), finite(df, c).alias("v")) for i, c in enumerate(names)])))
    table = cells.groupBy("position", "column").agg(
        F.count("v").alias("finite_count"), (F.min("v") < F.max("v")).alias("spread"))
    allowed = F.col("column").isin(list(usable)) if usable is not None else F.lit(True)
    fit = F.coalesce((F.col("finite_count") >= 3) & F.col("spread") & allowed, F.lit(False))
    return table.select("position", "column", "finite_count", fit.alias("usable"))


def usable_numeric_list(df: DataFrame, types: Mapping[str, str], usable: Sequence[str] | None = None) -> list[str]:
    rows = usable_numeric(df, types, usable).where("usable").orderBy("position").collect()
    return [r["column"] for r in rows]


def feature_selection(usable: Sequence[str], wanted: Sequence[str] | None = None, *,
                      config: Config = DEFAULT) -> list[str]:
    """The features to correlate: the first ten by default, twenty at most on request."""
    if wanted is None:
        return list(usable)[:config.correlation_default_features]
    unknown = [c for c in wanted if c not in usable]
    if unknown:
        raise ValueError(f"not usable as numeric features: {unknown}")
    if len(wanted) > config.correlation_max_selectable:
        raise ValueError(f"at most {config.correlation_max_selectable} features can be selected")
    return list(wanted)


def bounded_features(usable: Sequence[str], config: Config = DEFAULT) -> tuple[list[str], bool]:
    """All features, or the first ``correlation_max_features`` if that is set; and whether any were left out."""
    most = config.correlation_max_features
    return list(usable)[:most], most is not None and len(usable) > most


# ---- sums over pairs -------------------------------------------------------

def _partial_products(width: int):
    """Per task: count and sums for every pair i <= j of the columns, nulls left out pairwise."""
    low, high = np.triu_indices(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, width, width))
        for batch in batches:
            x = batch.to_numpy(dtype=float, na_value=np.nan)
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            first, second = x.T @ there, (x * x).T @ there
            total += np.stack([there.T @ there, first, first.T, second, second.T, x.T @ x])
        yield pd.DataFrame({"i": low, "j": high, **{
            name: total[k][low, high] for k, name in enumerate(["n", "sx", "sy", "sxx", "syy", "sxy"])}})
    return run


def pair_products(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``i, j, n, sx, sy, sxx, syy, sxy`` for all pairs i <= j of double columns.

    For wide tables: each task multiplies its Arrow batches as matrices and emits
    one small triangle; the triangles are summed by pair on many reducers.
    """
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = df.select(*columns).mapInPandas(_partial_products(len(columns)), schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def _finite_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select(*[finite(df, c).alias(f"f{i}") for i, c in enumerate(features)])


def _labelled(pairs: Sequence[Pair], row: DataFrame, method: str) -> DataFrame:
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.lit(method).alias("method"),
                 F.col(f"n{k}").cast("long").alias("n"), F.col(f"r{k}").cast("double").alias("r"))
        for k, (a, b) in enumerate(pairs)])))


def pearson_pairs(df: DataFrame, pairs: Sequence[Pair], *, config: Config = DEFAULT) -> DataFrame:
    """``feature_a, feature_b, method, n, r`` per pair over the rows finite in both."""
    features = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(features)}
    base = _finite_table(df, features)
    if len(pairs) > config.pairs_per_pass:
        return _pearson_products(base, features, pairs, config)
    return _pearson_deviations(base, at, pairs)


def _pearson_deviations(base: DataFrame, at: Mapping[str, int], pairs: Sequence[Pair]) -> DataFrame:
    """Each pair from deviations over its own rows."""
    aggs = []
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(f"f{at[a]}"), F.col(f"f{at[b]}")
        both = x.isNotNull() & y.isNotNull()
        # masked deviations: a guarded corr() would fail on a column without spread
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        aggs += [F.count_if(both).alias(f"n{k}"), F.try_divide(F.covar_pop(x, y), spread).alias(f"r{k}")]
    return _labelled(pairs, base.agg(*aggs), "pearson")


def _pearson_products(base: DataFrame, features: Sequence[str], pairs: Sequence[Pair], config: Config) -> DataFrame:
    """Sums of products in one pass; pairs that lose digits by cancellation are measured again by deviations."""
    columns = [f"f{i}" for i in range(len(features))]
    means = base.agg(*[F.avg(c).alias(c) for c in columns]).first()  # one number per feature
    centred = base.select(*[(F.col(c) - F.lit(means[c] or 0.0)).alias(c) for c in columns])
    n = F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    doubtful = ~((vx > F.col("sxx") * CANCELLED) & (vy > F.col("syy") * CANCELLED))
    r = F.when(~doubtful, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    names = F.array(*[F.lit(c) for c in features])
    table = materialize(pair_products(centred, columns).where("n > 0").select(
        F.get(names, F.col("i")).alias("_a"), F.get(names, F.col("j")).alias("_b"), n.cast("long").alias("n"), r.alias("r"), doubtful.alias("doubtful")))
    wanted = {(min(p), max(p)) for p in pairs}
    again = [p for row in table.where("doubtful").select("_a", "_b").toLocalIterator() if (p := (row["_a"], row["_b"])) in wanted and p[0] != p[1]]
    at = {c: i for i, c in enumerate(features)}
    table = table.drop("doubtful")
    for start in range(0, len(again), config.columns_per_pass):
        part = again[start:start + config.columns_per_pass]
        exact = _pearson_deviations(base, at, part).select(F.col("feature_a").alias("_a"), F.col("feature_b").alias("_b"), F.col("r").alias("_r"))
        table = table.join(F.broadcast(exact), ["_a", "_b"], "left").select("_a", "_b", "n", F.coalesce("_r", "r").alias("r"))
    return _in_pair_order(table, pairs, "pearson")


def _in_pair_order(table: DataFrame, pairs: Sequence[Pair], method: str) -> DataFrame:
    wanted = table.sparkSession.createDataFrame(
        [(min(p), max(p), *p) for p in pairs], "_a string, _b string, feature_a string, feature_b string")
    return F.broadcast(wanted).join(table, ["_a", "_b"], "left").select(  # at most 100 x 100 names
        "feature_a", "feature_b", F.lit(method).alias("method"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "r")


# ---- ranks -----------------------------------------------------------------

def avg_rank(df: DataFrame, column: str, *, config: Config = DEFAULT) -> DataFrame:
    """``value, count, avg_rank``: the mean rank every occurrence of a value gets."""
    rows = df.count()
    counts = (
        df.select(finite(df, column).alias("value")).where("value IS NOT NULL")
        .groupBy("value").agg(F.count(F.lit(1)).alias("count")).withColumn("_one", F.lit(0)))
    ranked = running_total(counts, ["_one"], ["value"], "count", rows, config)
    return ranked.select("value", "count", (F.col("before") + (F.col("count") + 1) / 2).alias("avg_rank"))


def _masks(base: DataFrame, features: Sequence[str], pairs: Sequence[Pair]) -> tuple[int, dict[Pair, tuple], dict[Pair, int]]:
    """Which rows each pair shares: ``(rows, mask per pair, n per pair)``.

    A mask is the set of features that must be present. Equal and nested masks
    are recognised by their counts, so that complete columns share one ranking.
    """
    at = {c: i for i, c in enumerate(features)}
    single = base.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"f{i}").alias(f"f{i}") for i in at.values()]).first()
    rows, n = single["rows"], {c: single[f"f{i}"] for c, i in at.items()}
    partial = sorted({c for p in pairs if n[p[0]] < rows and n[p[1]] < rows for c in p})
    both = {}
    if partial:
        sums = pair_products(base, [f"f{at[c]}" for c in partial]).where("i < j").select("i", "j", "n").collect()  # names only
        for r in sums:
            both[partial[r["i"]], partial[r["j"]]] = both[partial[r["j"]], partial[r["i"]]] = int(r["n"])
    stand_in: dict[str, str] = {}
    for c in features:
        twin = next((o for o in stand_in.values() if n[o] == n[c] == both.get((o, c), -1)), c)
        stand_in[c] = twin
    masks, shared = {}, {}
    for a, b in pairs:
        if n[a] == rows and n[b] == rows:
            masks[a, b], shared[a, b] = (), rows
        elif n[a] == rows or n[b] == rows:
            gap = b if n[a] == rows else a
            masks[a, b], shared[a, b] = (stand_in[gap],), n[gap]
        else:
            shared[a, b] = both[a, b]
            inner = next((c for c in (a, b) if n[c] == both[a, b]), None)  # one mask inside the other
            masks[a, b] = (stand_in[inner],) if inner else tuple(sorted({stand_in[a], stand_in[b]}))
    return rows, masks, shared


def spearman_pairs(df: DataFrame, pairs: Sequence[Pair], *, config: Config = DEFAULT) -> DataFrame:
    """``feature_a, feature_b, method, n, r``: Pearson of average ranks, ranked within each pair's rows.

    Every (feature, mask) is ranked once and shared by all pairs on that mask. Beyond ``Config.single_task_rows`` rows, or with
    many masks, the ranks of all masks come from one ordering of each feature.
    """
    features = sorted({c for p in pairs for c in p})
    at = {c: i for i, c in enumerate(features)}
    base = _finite_table(df, features)
    rows, masks, shared = _masks(base, features, pairs)
    tasks = sorted({(c, masks[p]) for p in pairs for c in p})
    if rows > config.single_task_rows or len(tasks) > config.columns_per_pass:
        return _spearman_cube(base, features, pairs, rows, min(shared.values()) == rows, config)
    number = {t: k for k, t in enumerate(tasks)}
    size = {(c, masks[p]): shared[p] for p in pairs for c in p}
    middles = [(size[t] + 1) / 2 for t in tasks]

    def cell(task) -> Column:
        c, mask = task
        v = F.col(f"f{at[c]}")
        for m in mask:
            v = F.when(F.col(f"f{at[m]}").isNotNull(), v)
        return v

    ranked = _rank_rows(base.select(*[cell(t).alias(f"v{k}") for t, k in number.items()]), middles)

    ends = [(number[a, masks[a, b]], number[b, masks[a, b]]) for a, b in pairs]
    if len(pairs) > config.pairs_per_pass:
        sums = pair_products(ranked, [f"d{k}" for k in number.values()])
        asked = ranked.sparkSession.createDataFrame(
            [(min(e), max(e), a, b, int(shared[a, b])) for e, (a, b) in zip(ends, pairs)],
            "i int, j int, feature_a string, feature_b string, n long")
        spread = F.sqrt(F.col("sxx") * F.col("syy"))
        return F.broadcast(asked).join(sums, ["i", "j"], "left").select(  # one row per pair
            "feature_a", "feature_b", F.lit("spearman").alias("method"), asked["n"],
            F.when(spread > 0, F.col("sxy") / spread).alias("r"))
    aggs = []
    for k, ((x, y), pair) in enumerate(zip(ends, pairs)):
        x, y = F.col(f"d{x}"), F.col(f"d{y}")
        spread = F.sqrt(F.sum(x * x) * F.sum(y * y))
        aggs += [F.coalesce(F.max(F.lit(shared[pair])), F.lit(shared[pair])).alias(f"n{k}"),
                 F.when(spread > 0, F.sum(x * y) / spread).alias(f"r{k}")]
    return _labelled(pairs, ranked.agg(*aggs), "spearman")


def _spearman_cube(base: DataFrame, features: Sequence[str], pairs: Sequence[Pair], rows: int, complete: bool, config: Config) -> DataFrame:
    """The same at any size: all ranks of a column come from one ordering, one count per presence class."""
    columns = [f"f{i}" for i in range(len(features))]
    n = np.full((len(features), len(features)), rows, np.int64)
    if not complete:
        n[:] = 0
        for r in pair_products(base, columns).select("i", "j", "n").toLocalIterator():  # names only
            n[r["i"], r["j"]] = n[r["j"], r["i"]] = int(r["n"])
    sums = rank_products(base, columns, rows, n, config)
    found = base.sparkSession.createDataFrame(sums, "i int, j int, sxx double, syy double, sxy double")  # one row per pair
    spread = F.sqrt(F.col("sxx") * F.col("syy"))
    at = {c: i for i, c in enumerate(features)}
    asked = base.sparkSession.createDataFrame(
        [(min(at[a], at[b]), max(at[a], at[b]), a, b, int(n[at[a], at[b]])) for a, b in pairs],
        "i int, j int, feature_a string, feature_b string, n long")
    return F.broadcast(asked).join(found, ["i", "j"], "left").select(
        "feature_a", "feature_b", F.lit("spearman").alias("method"), "n", F.when(spread > 0, F.col("sxy") / spread).alias("r"))


def _with_ids(values: DataFrame) -> DataFrame:
    """Rows under ids that stay the same for every reader: written, not recomputed."""
    return materialize(values.withColumn("_id", F.monotonically_increasing_id()))


def _cells_of(values: DataFrame, tasks: Sequence[int], *keep: str) -> DataFrame:
    """``keep..., task, v`` of the non-null values."""
    cells = [F.struct(F.lit(k).alias("task"), F.col(f"v{k}").alias("v")) for k in tasks]
    return values.select(*keep, F.inline(F.array(*cells))).where("v IS NOT NULL")


def _by_row(cells: DataFrame, tasks: Sequence[int], prefix: str) -> DataFrame:
    """Cells back to one row per id, a column per task."""
    return cells.groupBy("_id").agg(*[F.max(F.when(F.col("task") == k, F.col("d"))).alias(f"{prefix}{k}") for k in tasks])


def _middle(middles: Sequence[float]) -> Column:
    return F.get(F.array(*[F.lit(float(m)) for m in middles]), F.col("task"))


def _rank_rows(values: DataFrame, middles: Sequence[float]) -> DataFrame:
    """Rank deviations ``d{task}`` when one task can order a whole column: a window per column."""
    tasks = range(len(middles))
    cells = _cells_of(_with_ids(values), tasks, "_id")
    ordered = Window.partitionBy("task").orderBy("v")
    equal = ordered.rangeBetween(Window.currentRow, Window.currentRow)  # same sort, no second one
    d = F.rank().over(ordered) + (F.count(F.lit(1)).over(equal) - 1) / 2 - _middle(middles)
    return _by_row(cells.withColumn("d", d), tasks, "d").drop("_id")


# ---- matrices --------------------------------------------------------------

def _diagonal(df: DataFrame, features: Sequence[str], method: str) -> DataFrame:
    """Each feature with itself, as a local table: readers of the matrix read the data no more."""
    counts = df.agg(*[F.count(finite(df, c)) for c in features]).first()
    return df.sparkSession.createDataFrame([(c, c, method, n, 1.0) for c, n in zip(features, counts, strict=True)],
                                           "feature_a string, feature_b string, method string, n long, r double")


def correlate(df: DataFrame, pairs: Sequence[Pair], method: str, *, config: Config = DEFAULT) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}, not {method!r}")
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, method string, n long, r double")
    pairs_of = pearson_pairs if method == "pearson" else spearman_pairs
    return pairs_of(df, pairs, config=config)


def correlation_matrix(df: DataFrame, features: Sequence[str], method: str = "pearson", *,
                       config: Config = DEFAULT) -> DataFrame:
    """The full symmetric matrix in long form; the diagonal is 1. The triangle is computed once."""
    features, _ = bounded_features(features, config)
    upper = correlate(df, list(combinations(features, 2)), method, config=config)
    mirrored = upper.select(
        F.explode(F.array(F.struct("feature_a", "feature_b"),
                          F.struct(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b")))).alias("p"),
        "method", "n", "r").select("p.feature_a", "p.feature_b", "method", "n", "r")
    return mirrored.unionByName(_diagonal(df, features, method)) if features else mirrored


def pearson_matrix(df: DataFrame, features: Sequence[str], *, config: Config = DEFAULT) -> DataFrame:
    return correlation_matrix(df, features, "pearson", config=config)


def spearman_matrix(df: DataFrame, features: Sequence[str], *, config: Config = DEFAULT) -> DataFrame:
    return correlation_matrix(df, features, "spearman", config=config)


def pair_stats(df: DataFrame, x: str, y: str, *, config: Config = DEFAULT) -> DataFrame:
    """``n, pearson, spearman`` of the rows finite in both; null below three rows or without spread."""
    both = pearson_pairs(df, [(x, y)], config=config).unionByName(spearman_pairs(df, [(x, y)], config=config))
    pick = lambda m: F.max(F.when((F.col("method") == m) & (F.col("n") >= 3), F.col("r"))).alias(m)
    return both.agg(F.max("n").alias("n"), *[pick(m) for m in METHODS])


def random_features(usable: Sequence[str], *, k: int | None = None, seed: int | None = None,
                    config: Config = DEFAULT) -> list[str]:
    """Seeded draw of feature names without replacement: the k smallest digests of seed and name."""
    k = config.random_feature_count if k is None else k
    seed = config.random_seed if seed is None else seed
    return sorted(usable, key=lambda c: hashlib.md5(f"{seed}:{c}".encode()).hexdigest())[:k]


def random_subset_corr(df: DataFrame, usable: Sequence[str], method: str = "pearson", *, k: int | None = None,
                       seed: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Matrix of a seeded random subset drawn from all usable features."""
    return correlation_matrix(df, random_features(usable, k=k, seed=seed, config=config), method, config=config)


def network_edges(matrix: DataFrame, features: Sequence[str], threshold: float | None = None, *,
                  config: Config = DEFAULT) -> DataFrame:
    """``a, b, r`` of the pairs with |r| at the threshold or above, each pair once in feature order."""
    t = config.correlation_threshold if threshold is None else threshold
    if not 0 <= t <= 1:
        raise ValueError("the correlation threshold lies between 0 and 1")
    place = F.array(*[F.lit(c) for c in features])
    ordered = F.array_position(place, F.col("feature_a")) < F.array_position(place, F.col("feature_b"))
    inside = F.col("feature_a").isin(list(features)) & F.col("feature_b").isin(list(features))
    return matrix.where(inside & ordered & (F.abs("r") >= t)).select(
        F.col("feature_a").alias("a"), F.col("feature_b").alias("b"), "r")


def network_nodes(edges: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, degree`` for every feature, isolated ones with 0."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("feature"), F.lit(1).alias("one"))
    nodes = edges.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in features])).alias("feature"), F.lit(0).alias("one"))
    return ends.unionByName(nodes).groupBy("feature").agg(F.sum("one").alias("degree"))


def matrix_completion(df: DataFrame, existing: DataFrame, features: Sequence[str], *,
                      overrides: Mapping[str, str] | None = None, method: str = "pearson",
                      config: Config = DEFAULT) -> DataFrame:
    """The matrix over ``features``: known values stay, missing pairs are computed after re-typing."""
    known = {(r["feature_a"], r["feature_b"]) for r in existing.where("r IS NOT NULL")  # at most 100 x 100 names
             .select("feature_a", "feature_b").collect()}
    wanted = [(a, b) for a, b in combinations(features, 2) if (a, b) not in known and (b, a) not in known]
    retyped = coerce_override(df.select(*df.columns), dict(overrides or {}))
    added = correlate(retyped, wanted, method, config=config).select(
        "feature_a", "feature_b", F.when(F.col("n") >= 3, F.col("r")).alias("r"))
    both = existing.where("r IS NOT NULL").select("feature_a", "feature_b", "r").unionByName(added)
    place = F.array(*[F.lit(c) for c in features])
    a, b = F.col("feature_a"), F.col("feature_b")
    first = F.array_position(place, a) < F.array_position(place, b)
    pairs = both.where(a.isin(list(features)) & b.isin(list(features)) & (a != b)).select(
        F.when(first, a).otherwise(b).alias("a"), F.when(first, b).otherwise(a).alias("b"), "r")
    pairs = pairs.groupBy("a", "b").agg(F.max("r").alias("r"))
    mirrored = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), "r"),
        F.struct(F.col("b").alias("feature_a"), F.col("a").alias("feature_b"), "r"))))
    diagonal = df.sparkSession.range(1).select(F.explode(place).alias("feature_a")).select(
        "feature_a", F.col("feature_a").alias("feature_b"), F.lit(1.0).alias("r"))
    return mirrored.unionByName(diagonal)
