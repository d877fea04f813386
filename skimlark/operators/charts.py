"""The numbers behind exploratory charts, over all rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skimlark.config import DEFAULT, Config
from skimlark.functions.exprs import cell_text, col, finite, iso_from_micros, micros, normal_quantile
from skimlark.functions.order import attach_groups, exact_quantiles, materialize, running_total
from skimlark.functions.values import melt, top_values, value_counts
from skimlark.operators.profile import fences
from skimlark.operators.sampling import sample_rows

# How many categories each chart shows, and its resolution.
TOP_SHOWN = 5
GROUP_BOX_GROUPS = 12
GROUPED_BOX_X, GROUPED_BOX_COLOUR = 8, 6
FACETS = 9
CONTINGENCY_LABELS = 30
STACKED_A, STACKED_C, STACKED_B = 8, 4, 6
BOX_MINIMUM = 3
HISTOGRAM_MIN_BINS, HISTOGRAM_MAX_BINS = 5, 40
KDE_STEPS = 120
QQ_POINTS = 4000
ACF_LAGS = (0, 2, 4, 6, 8)

POINT_CHARTS = ("scatter",)  # charts with a mark for every row
CATEGORY = ("categorical", "boolean")
OTHER = "Other"


# ---- category counts -------------------------------------------------------

def category_counts(df: DataFrame, columns: Sequence[str], *, top_k: int | None = None,
                    config: Config = DEFAULT) -> DataFrame:
    """``column, rank, value, count``: most frequent values over all rows."""
    columns = list(columns)
    tops = top_values(df, value_counts(df, columns), columns, top_k or config.top_k_categories)
    return tops.select(_name(columns), "rank", "value", "count")


def _name(columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("position")).alias("column")


def full_counts(df: DataFrame, columns: Sequence[str], *, config: Config = DEFAULT) -> DataFrame:
    """As ``category_counts``, for columns with few distinct values only."""
    columns = list(columns)
    counts = value_counts(df, columns)
    few = counts.groupBy("position").agg(F.count(F.lit(1)).alias("u"), F.sum("count").alias("n")).where(
        (F.col("u") <= config.full_counts_max_cardinality) & (F.col("n") > 0))  # n: share the shuffle of the counts
    tops = top_values(df, counts, columns, config.top_k_categories)
    return tops.join(F.broadcast(few), "position", "left_semi").select(_name(columns), "rank", "value", "count")


def top5_with_other(df: DataFrame, column: str, *, cap: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """``rank, value, count, share``: the five leading values and the rest as one.

    The rest is the true remainder; ``cap=10`` counts ranks six to ten only.
    """
    counts = value_counts(df, [column])
    tops = top_values(df, counts, [column], max(TOP_SHOWN, cap or 0))
    lead = tops.where(F.col("rank") <= TOP_SHOWN).select("rank", "value", "count")
    if cap is None:
        everything = counts.select(F.lit(1).alias("sign"), "count").unionByName(
            lead.select(F.lit(-1).alias("sign"), "count"))
        rest = everything.agg(F.sum(F.col("sign") * F.col("count")).alias("count"))
    else:
        rest = tops.where(F.col("rank") > TOP_SHOWN).agg(F.sum("count").alias("count"))
    rest = rest.where("count > 0").select(F.lit(TOP_SHOWN + 1).alias("rank"), F.lit(OTHER).alias("value"), "count")
    shown = lead.unionByName(rest)
    total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # at most six rows
    return shown.select("rank", "value", "count", (F.col("count") / total).alias("share"))


# ---- one numeric column ----------------------------------------------------

def _span(df: DataFrame, column: str):
    """Count, ends and spread of the finite values: one row on the driver."""
    v = finite(df, column)
    return df.agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"),
                  F.approx_count_distinct(v).alias("about"), F.count(F.lit(1)).alias("rows")).first()


def bin_count(n: int) -> int:
    """Square-root rule between 5 and 40, halves rounded up."""
    return max(HISTOGRAM_MIN_BINS, min(HISTOGRAM_MAX_BINS, math.floor(math.sqrt(n) + 0.5)))


def histogram(df: DataFrame, column: str, *, bins: int | None = None) -> DataFrame:
    """``bin, x0, x1, count`` with equal widths; empty bins kept, last bin closed."""
    s = _span(df, column)
    k = bins or bin_count(s["n"])
    if not s["n"]:
        return df.sparkSession.range(0).select(
            F.col("id").alias("bin"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("x1"), F.lit(0).cast("long").alias("count"))
    lo, hi = (s["lo"] - 0.5, s["hi"] + 0.5) if s["lo"] == s["hi"] else (s["lo"], s["hi"])
    width = (hi - lo) / k
    v = finite(df, column)
    place = F.least(F.floor((v - lo) / width), F.lit(k - 1).cast("long"))
    counts = df.where(v.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = df.sparkSession.range(k).withColumnRenamed("id", "bin")
    return grid.join(F.broadcast(counts), "bin", "left").select(  # at most 40 rows
        "bin", (F.lit(lo) + F.col("bin") * width).alias("x0"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("x1"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _kernel_width(df: DataFrame, column: str, span, config: Config) -> float:
    """Rule-of-thumb width 1.06 * spread * n**-0.2; the spread is the smaller of standard deviation and scaled quartile distance."""
    lower, upper = exact_quantiles(df, {column: finite(df, column)}, (0.25, 0.75), rows=span["rows"], config=config).first()["q"]
    deviation = span["sd"] or 0.0
    spread = min(deviation, (upper - lower) / 1.34) if upper > lower else deviation
    return 1.06 * spread * span["n"] ** -0.2 or (span["hi"] - span["lo"]) / 20


def kde(df: DataFrame, column: str, *, points: int | None = None, bandwidth: float | None = None,
        config: Config = DEFAULT) -> DataFrame:
    """``point, x, density``: Gaussian density on an even grid.

    Each task sums the kernels of its Arrow batches at all grid points and hands on one row per point. Values are
    counted first when they repeat.
    """
    span = _span(df, column)
    nothing = df.sparkSession.createDataFrame([], "point int, x double, density double")
    width = (bandwidth or _kernel_width(df, column, span, config)) if span["n"] else 0
    if not width > 0:
        return nothing
    values = df.select(finite(df, column).alias("v"), F.lit(1).cast("long").alias("c")).where("v IS NOT NULL")
    if span["about"] * 10 < span["n"]:
        values = values.groupBy("v").agg(F.sum("c").alias("c"))
    steps = points or KDE_STEPS
    grid = np.array([span["lo"] + i * ((span["hi"] - span["lo"]) / steps) for i in range(steps + 1)])

    def heights(batches):
        total = np.zeros(len(grid))
        for pdf in batches:
            for part in np.array_split(pdf[["v", "c"]].to_numpy(float), len(pdf) // 4096 + 1):
                total += np.exp(-0.5 * ((grid[:, None] - part[:, 0]) / width) ** 2) @ part[:, 1]
        yield pd.DataFrame({"point": np.arange(len(grid)), "x": grid, "height": total})

    scale = 1 / (span["n"] * width * math.sqrt(2 * math.pi))
    return values.mapInPandas(heights, "point int, x double, height double").groupBy("point", "x").agg(
        (F.sum("height") * scale).alias("density"))


def box_stats(df: DataFrame, columns: Sequence[str], *, config: Config = DEFAULT) -> DataFrame:
    """``column, n, min, q1, median, q3, max, iqr, lower, upper, outliers`` per column."""
    columns = list(columns)
    table = exact_quantiles(df, {c: finite(df, c) for c in columns}, (0.0, 0.25, 0.5, 0.75, 1.0), config=config)
    boxes = {r["column"]: (r["n"], *r["q"]) for r in table.collect()}  # six numbers per column
    columns = [c for c in columns if c in boxes]
    aggs, limits = [], {}
    for i, c in enumerate(columns):
        limits[c] = fences(boxes[c][2], boxes[c][4])
        v = finite(df, c)
        aggs += [F.count_if((v < limits[c][0]) | (v > limits[c][1])).alias(f"{i}_outliers")]
    row = df.agg(*aggs)
    fields = ["n", "min", "q1", "median", "q3", "max", "iqr", "lower", "upper"]
    for i, c in enumerate(columns):
        n, lo, q1, q2, q3, hi = boxes[c]
        known = dict(zip(fields, (n, lo, q1, q2, q3, hi, q3 - q1, *limits[c])))
        row = row.withColumns({f"{i}_{f}": F.lit(x).cast("long" if f == "n" else "double") for f, x in known.items()})
    return melt(row, columns, [*fields, "outliers"]).drop("position")


def outlier_rows(df: DataFrame, column: str, *, config: Config = DEFAULT) -> DataFrame:
    """The rows whose value lies beyond the box fences, with the fences."""
    cuts = exact_quantiles(df, {column: finite(df, column)}, (0.25, 0.75), config=config).first()
    if cuts is None:
        return df.limit(0).withColumns({"lower": F.lit(0.0), "upper": F.lit(0.0)})
    lo, hi = fences(*cuts["q"])
    v = finite(df, column)
    return df.where((v < lo) | (v > hi)).withColumns({"lower": F.lit(lo), "upper": F.lit(hi)})


# ---- numeric by category ---------------------------------------------------

def _boxes(rows: DataFrame, by: list[str], config: Config) -> DataFrame:
    """Box figures of ``y`` per group of ``rows(by..., y)``; groups of three and more."""
    table = exact_quantiles(rows, {"y": F.col("y")}, (0.0, 0.25, 0.5, 0.75, 1.0), by=by, config=config)
    q = [F.col("q")[i] for i in range(5)]
    iqr = q[3] - q[1]
    boxes = table.where(F.col("n") >= BOX_MINIMUM).select(
        *by, "n", q[0].alias("min"), q[1].alias("q1"), q[2].alias("median"), q[3].alias("q3"), q[4].alias("max"),
        iqr.alias("iqr"), (q[1] - 1.5 * iqr).alias("lower"), (q[3] + 1.5 * iqr).alias("upper"))
    boxes = materialize(boxes)
    outside = (
        attach_groups(rows, boxes.select(*by, "n", "lower", "upper"), by, "n", config)
        .groupBy(*by).agg(F.count_if((F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper"))).alias("outliers")))
    return boxes.join(outside, by)


def _first_labels(df: DataFrame, column: str, count: int) -> list[str]:
    """The first ``count`` values in text order; a bounded list."""
    c = df.select(col(column).alias("label")).where("label IS NOT NULL").distinct().orderBy("label").limit(count)
    return [r["label"] for r in c.collect()]


def _joint_counts(cells: DataFrame, *by: str) -> DataFrame:
    """Row counts per combination of categories, written once: labels and counts read no row again."""
    return materialize(cells.groupBy(*by).agg(F.count(F.lit(1)).alias("count")))


def _triples(df: DataFrame, value: str | None, **categories: str) -> DataFrame:
    """Category texts under short names, and the finite value as ``y``."""
    out = [cell_text(df, c).alias(k) for k, c in categories.items()]
    if value is not None:
        out.append(finite(df, value).alias("y"))
    return df.select(*out)


def group_box(df: DataFrame, value: str, category: str, *, config: Config = DEFAULT) -> DataFrame:
    """Box figures per category for the twelve largest categories."""
    rows = _triples(df, value, category=category).where("category IS NOT NULL AND y IS NOT NULL")
    largest = (
        rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "category").limit(GROUP_BOX_GROUPS))
    keep = [r["category"] for r in largest.collect()]
    return _boxes(rows.where(F.col("category").isin(keep)), ["category"], config)


def grouped_box(df: DataFrame, value: str, x: str, colour: str, *, config: Config = DEFAULT) -> DataFrame:
    """Box figures per (x, colour): first eight x-values, first six colours."""
    cells = _triples(df, value, x=x, colour=colour)
    groups = _joint_counts(cells, "x", "colour")
    xs, cs = _first_labels(groups, "x", GROUPED_BOX_X), _first_labels(groups, "colour", GROUPED_BOX_COLOUR)
    rows = cells.where(F.col("x").isin(xs) & F.col("colour").isin(cs) & F.col("y").isNotNull())
    return _boxes(rows, ["x", "colour"], config)


def facet_box(df: DataFrame, value: str, x: str, colour: str, *, config: Config = DEFAULT) -> DataFrame:
    """Box figures per (x, colour): first nine x-values, every colour."""
    cells = _triples(df, value, x=x, colour=colour)
    xs = _first_labels(cells, "x", FACETS)
    rows = cells.where(F.col("x").isin(xs) & F.col("colour").isNotNull() & F.col("y").isNotNull())
    return _boxes(rows, ["x", "colour"], config)


def group_mean(df: DataFrame, value: str, category: str) -> DataFrame:
    """``category, n, mean, std, low, high`` per category."""
    rows = _triples(df, value, category=category).where("category IS NOT NULL AND y IS NOT NULL")
    stats = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.coalesce(F.stddev_samp("y"), F.lit(0.0)).alias("std"))
    return stats.withColumns({"low": F.col("mean") - F.col("std"), "high": F.col("mean") + F.col("std")})


# ---- categories against categories -----------------------------------------

def contingency(df: DataFrame, a: str, b: str, *, include_null: bool = False) -> DataFrame:
    """``a, b, count`` for the first thirty values each; zero cells kept."""
    pairs = _pairs(_triples(df, None, a=a, b=b), include_null)
    joint = _joint_counts(pairs, "a", "b")
    las, lbs = _first_labels(joint, "a", CONTINGENCY_LABELS), _first_labels(joint, "b", CONTINGENCY_LABELS)
    counts = joint.where(F.col("a").isin(las) & F.col("b").isin(lbs))
    labels = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    grid = df.sparkSession.range(1).select(F.explode(labels(las)).alias("a")).select("a", F.explode(labels(lbs)).alias("b"))
    return grid.join(F.broadcast(counts), ["a", "b"], "left").select(  # at most 900 cells
        "a", "b", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _pairs(cells: DataFrame, include_null: bool) -> DataFrame:
    if include_null:
        return cells.withColumns({c: F.coalesce(c, F.lit("nan")) for c in ("a", "b")})
    return cells.where("a IS NOT NULL AND b IS NOT NULL")


def facet_contingency(df: DataFrame, a: str, b: str, colour: str) -> DataFrame:
    """``colour, a, b, count``: one contingency for each of the first nine colours with two rows or more."""
    joint = _joint_counts(_triples(df, None, a=a, b=b, colour=colour), "colour", "a", "b")
    shown = joint.where(F.col("colour").isin(_first_labels(joint, "colour", FACETS)))
    large = shown.groupBy("colour").agg(F.sum("count").alias("rows")).where("rows >= 2").collect()  # at most nine
    counts = shown.where(F.col("colour").isin([r["colour"] for r in large]) & F.col("a").isNotNull() & F.col("b").isNotNull())

    def labels(side):
        w = Window.partitionBy("colour").orderBy(side)
        numbered = counts.select("colour", side).distinct().withColumn("_r", F.row_number().over(w))
        return numbered.where(F.col("_r") <= CONTINGENCY_LABELS).groupBy("colour").agg(
            F.collect_list(side).alias(f"{side}s"))  # at most thirty labels

    grid = (
        labels("a").join(F.broadcast(labels("b")), "colour")
        .select("colour", "bs", F.explode("as").alias("a")).select("colour", "a", F.explode("bs").alias("b")))
    return grid.join(counts, ["colour", "a", "b"], "left").select(
        "colour", "a", "b", F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def stacked_bar(df: DataFrame, a: str, b: str, colour: str) -> DataFrame:
    """``a, colour, b, count, total, start, end``: stacked segments of b per (a, colour)."""
    cells = _triples(df, None, a=a, b=b, colour=colour)
    joint = _joint_counts(cells, "a", "colour", "b")
    las, lbs, lcs = (_first_labels(joint, c, k) for c, k in (("a", STACKED_A), ("b", STACKED_B), ("colour", STACKED_C)))
    counts = joint.where(F.col("a").isin(las) & F.col("b").isin(lbs) & F.col("colour").isin(lcs))
    bar = Window.partitionBy("a", "colour")
    end = F.sum("count").over(bar.orderBy("b"))
    return counts.select("a", "colour", "b", "count", F.sum("count").over(bar).alias("total"),
                         (end - F.col("count")).alias("start"), end.alias("end"))


# ---- points and lines ------------------------------------------------------

def scatter(df: DataFrame, x: str, y: str, *, colour: str | None = None, sample: int | None = None,
            config: Config = DEFAULT) -> DataFrame:
    """``x, y[, colour]`` of the rows where both are finite; each row keeps its colour."""
    out = [finite(df, x).alias("x"), finite(df, y).alias("y")]
    if colour is not None:
        out.append(cell_text(df, colour).alias("colour"))
    points = df.select(*out).where("x IS NOT NULL AND y IS NOT NULL")
    return points if sample is None else sample_rows(points, sample, seed=config.random_seed)


def drawn_points(points: DataFrame, x: str, y: str, width: int, ties: Sequence[str] = ()) -> DataFrame:
    """The points that a line chart of ``width`` pixel columns needs: first, last, lowest and highest of each column.

    The line through them covers the same pixels as the line through all points: inside a pixel column only the reach
    matters, between columns only the last point of one and the first of the next. One scan for the range of x, one
    partial aggregate; at most four rows a column are shuffled from a task. ``ties`` orders points of equal x.
    """
    span = points.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if span["lo"] is None:
        return points
    reach = float(span["hi"] - span["lo"]) or 1.0
    column = F.least(F.floor((F.col(x) - F.lit(span["lo"])).cast("double") * width / reach), F.lit(width - 1).cast("long"))
    point = F.struct(*points.columns)
    along, up = F.struct(x, *ties, y), F.struct(y, x, *ties)
    picked = points.where(F.col(y).isNotNull()).groupBy(column.alias("_pixel")).agg(
        F.min_by(point, along).alias("first"), F.max_by(point, along).alias("last"), F.min_by(point, up).alias("low"), F.max_by(point, up).alias("high"))
    return picked.select(F.explode(F.array_distinct(F.array("first", "last", "low", "high"))).alias("p")).select("p.*")


def time_series(df: DataFrame, time: str, value: str, *, sample: int | None = None, points: int | None = None,
                config: Config = DEFAULT) -> DataFrame:
    """``t, value`` in time order (range-partitioned sort), pairs with a gap left out.

    ``points`` keeps the at most four points of each of so many pixel columns that draw the same line as all rows.
    """
    width = points
    points = df.select(micros(df, time).alias("_t"), finite(df, value).alias("value")).where(
        "_t IS NOT NULL AND value IS NOT NULL")
    if width is not None:
        points = drawn_points(points, "_t", "value", width)
    if sample is not None:
        points = sample_rows(points, sample, seed=config.random_seed)
    return points.orderBy("_t", "value").select(iso_from_micros(F.col("_t")).alias("t"), "value")


def line_series(df: DataFrame, value: str, *, order_by: Sequence[str], time: str | None = None,
                sample: int | None = None, points: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """``row, x, value`` in row order: x is the shared time axis, or null without one.

    ``order_by`` gives the row order and must be unique; gaps stay as null values. ``points`` keeps, along the row
    number, the points that draw the same line on so many pixel columns; gaps are left out then.
    """
    x = iso_from_micros(micros(df, time)) if time else F.lit(None).cast("string")
    keys = [f"_o{i}" for i in range(len(order_by))]
    rows = df.select(*[col(o).alias(k) for o, k in zip(order_by, keys)], x.alias("x"), finite(df, value).alias("value"))
    if sample is not None:
        rows = sample_rows(rows, sample, seed=config.random_seed)
    rows = rows.withColumns({"_one": F.lit(0), "_c": F.lit(1).cast("long")})
    numbered = running_total(rows, ["_one"], keys, "_c", rows.count(), config).select(F.col("before").alias("row"), "x", "value")
    return numbered if points is None else drawn_points(numbered, "row", "value", points)


def qq_points(df: DataFrame, column: str, *, points: int = QQ_POINTS, config: Config = DEFAULT) -> DataFrame:
    """``i, z, value, line``: sorted values against normal quantiles, every n/4000-th point.

    Distinct values carry their counts, so a frequent value is one row until its
    own points are written out. ``line`` runs through the nearest-rank quartiles.
    """
    v = finite(df, column)
    n = df.agg(F.count(v)).first()[0]
    counts = (
        df.select(v.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("c"))
        .withColumn("_one", F.lit(0)))
    step = max(1, n // points)
    ranked = running_total(counts, ["_one"], ["value"], "c", n, config)
    spots = {k: max(0, min(n - 1, math.floor((n - 1) * p + 0.5))) for k, p in (("q1", 0.25), ("q3", 0.75))}
    first = F.ceil(F.col("before") / step) * step
    last = F.col("before") + F.col("c") - 1
    quarter = {k: F.max(F.when((F.col("before") <= i) & (last >= i), F.col("value"))).over(Window.partitionBy("_one"))
               for k, i in spots.items()}
    # rows that hold a point or a quartile: about `points` of them
    holds_quartile = [(F.col("before") <= i) & (last >= i) for i in spots.values()]
    kept = ranked.where((first <= last) | holds_quartile[0] | holds_quartile[1])
    shown = kept.withColumns(quarter).where(first <= last).select(
        F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("i"), "value", "q1", "q3")
    z = normal_quantile((F.col("i") + 0.5) / n)
    z1, z3 = normal_quantile(F.lit(0.25)), normal_quantile(F.lit(0.75))
    line = F.col("q1") + (F.col("q3") - F.col("q1")) * (z - z1) / (z3 - z1)
    return shown.where(F.lit(n >= 4)).select("i", z.alias("z"), "value", line.alias("line"))


def acf(df: DataFrame, column: str, *, order_by: Sequence[str], lags: Sequence[int] = ACF_LAGS,
        config: Config = DEFAULT) -> DataFrame:
    """``lag, acf, band, n``: autocorrelation of the finite values in row order.

    Rows tied on ``order_by`` stand in value order. Equal neighbours form runs;
    products inside a run need its length only, and of a run no more than its
    first and last few positions take part in products with other runs.
    """
    keys = [f"_o{i}" for i in range(len(order_by))]
    runs = (
        df.select(*[col(o).alias(k) for o, k in zip(order_by, keys)], finite(df, column).alias("v"))
        .where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("c")))
    s = df.agg(F.count(finite(df, column)).alias("n"), F.avg(finite(df, column)).alias("m"),
               F.var_pop(finite(df, column)).alias("var")).first()
    n = s["n"]
    lags = sorted({k for k in lags if 0 <= k < n // 3})
    if n < 8 or not lags:
        return df.sparkSession.range(0).select(
            F.col("id").cast("int").alias("lag"), F.lit(0.0).alias("acf"), F.lit(0.0).alias("band"), F.col("id").alias("n"))
    reach = max(lags)
    placed = running_total(runs.withColumn("_one", F.lit(0)), ["_one"], [*keys, "v"], "c", n, config)
    dev = F.col("v") - s["m"]
    ends = F.array_union(
        F.sequence(F.lit(0).cast("long"), F.least(F.col("c"), F.lit(max(reach, 1)).cast("long")) - 1),
        F.sequence(F.greatest(F.col("c") - max(reach, 1), F.lit(0).cast("long")), F.col("c") - 1))
    spots = placed.select(
        F.col("before").alias("run"), "c", dev.alias("d"), F.explode(ends).alias("offset"))
    # Blocks of positions; the first positions of a block are also lent to the block before.
    size = config.single_task_rows
    place = F.col("run") + F.col("offset")
    block = F.floor(place / size)
    lent = (place % size < reach) & (block > 0)
    spots = spots.withColumns({"place": place, "blocks": F.when(
        lent, F.array(F.struct(block.alias("block"), F.lit(True).alias("own")),
                      F.struct((block - 1).alias("block"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(block.alias("block"), F.lit(True).alias("own"))))})
    spots = spots.select("run", "c", "d", "offset", "place", F.inline("blocks"))
    ahead = Window.partitionBy("block").orderBy("place")
    sums = []
    for k in lags:
        partner = F.first(F.struct("run", "d")).over(ahead.rangeBetween(k, k)) if k else None
        spots = spots.withColumn(f"p{k}", partner) if k else spots
        inside = F.when(F.col("offset") == 0, F.greatest(F.col("c") - k, F.lit(0).cast("long")) * F.col("d") * F.col("d"))
        across = F.when(F.col(f"p{k}.run") != F.col("run"), F.col("d") * F.col(f"p{k}.d")) if k else F.lit(0.0)
        sums.append(F.sum(F.when(F.col("own"), F.coalesce(inside, F.lit(0.0)) + F.coalesce(across, F.lit(0.0)))).alias(f"s{k}"))
    row = spots.agg(*sums)
    whole = s["var"] * n
    share = lambda k: F.col(f"s{k}") / whole if whole else F.lit(1.0 if k == 0 else 0.0)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), share(k).alias("acf"), F.lit(1.96 / math.sqrt(n)).alias("band"),
                 F.lit(n).cast("long").alias("n")) for k in lags])))


# ---- time ------------------------------------------------------------------

def _bucket(df: DataFrame, time: str, unit: str) -> Column:
    return F.date_format(F.date_trunc(unit, col(time)), "yyyy-MM-dd'T'HH:mm:ss")


def category_over_time(df: DataFrame, time: str, category: str, *, unit: str = "day") -> DataFrame:
    """``bucket, category, count`` per calendar unit."""
    rows = df.select(_bucket(df, time, unit).alias("bucket"), cell_text(df, category).alias("category"))
    return rows.where("bucket IS NOT NULL AND category IS NOT NULL").groupBy("bucket", "category").agg(
        F.count(F.lit(1)).alias("count"))


def time_coverage(df: DataFrame, time: str, *, unit: str = "month") -> DataFrame:
    """``bucket, count``: records per calendar unit."""
    rows = df.select(_bucket(df, time, unit).alias("bucket")).where("bucket IS NOT NULL")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"))


# ---- choosing --------------------------------------------------------------

def chart_for(ta: str, tb: str, coloured: bool = False) -> str:
    """The chart two effective types call for."""
    kinds = {"category" if t in CATEGORY else t for t in (ta, tb)}
    if kinds == {"numeric"}:
        return "scatter"
    if kinds == {"numeric", "category"}:
        return "grouped_box" if coloured else "group_box"
    if kinds == {"category"}:
        return "stacked_bar" if coloured else "contingency"
    return "time_series" if kinds == {"numeric", "datetime"} else "unsupported"


def relationship(df: DataFrame, a: str, b: str, types: Mapping[str, str], *, colour: str | None = None,
                 sample: int | None = None, points: int | None = None, config: Config = DEFAULT) -> tuple[str, DataFrame | None]:
    """The chart two columns call for by their effective types, and its numbers."""
    tint = colour if colour is not None and types.get(colour) in CATEGORY else None
    kind = chart_for(types[a], types[b], tint is not None)
    number, other = (a, b) if types[a] == "numeric" else (b, a)
    makers = {
        "scatter": lambda: scatter(df, a, b, colour=tint, sample=sample, config=config),
        "group_box": lambda: group_box(df, number, other, config=config),
        "grouped_box": lambda: grouped_box(df, number, other, tint, config=config),
        "contingency": lambda: contingency(df, a, b),
        "stacked_bar": lambda: stacked_bar(df, a, b, tint),
        "time_series": lambda: time_series(df, other, number, sample=sample, points=points, config=config),
    }
    return kind, makers[kind]() if kind in makers else None
