"""Exact-size seeded samples and series aligned on the same rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from skimlark.config import DEFAULT, Config
from skimlark.functions.exprs import cell_text, col, finite, iso_from_micros, kind_is_moment, micros
from skimlark.functions.order import materialize


#: Ranges of draws that one pass tells apart, and rows of the last range that the driver orders.
RANGES = 4096
LAST_ROWS = 2000
DRAWS = 16**13


def sample_rows(df: DataFrame, n: int | None = None, *, seed: int | None = None, key: Sequence[str] | None = None,
                order_by: Sequence[str] | None = None, total: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Exactly ``n`` rows without replacement (all rows when there are no more).

    Every row draws a number and the n smallest win. With a unique ``key`` the
    number is a hash of seed and key, the same however the rows are
    partitioned; without one it is Spark's seeded ``rand`` (equal rows draw apart). Rows above a
    threshold that about n rows pass are dropped inside their task and the others written; the n-th
    smallest draw is found by counting ranges of draws, so no task orders n rows, whatever n is. ``total`` is
    the number of rows where it is known.
    """
    n = config.plot_sample_size if n is None else n
    seed = config.random_seed if seed is None else seed
    total = df.count() if total is None else total
    if total <= n:
        return df.orderBy(*order_by) if order_by else df
    if key:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in key]))
        draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    else:
        draw = F.floor(F.rand(seed) * DRAWS).cast("long")
    drawn = df.withColumn("_draw", draw)
    limit = min(DRAWS, math.ceil((n + 10 * math.sqrt(n) + 10) / total * DRAWS))
    near, held = _numbered(drawn.where(F.col("_draw") < limit))  # about n rows
    if held < n:
        limit, near = DRAWS, _numbered(drawn)[0]
    if n <= config.broadcast_rows:  # few enough for every task to hand on n rows
        out = near.orderBy("_draw", "_row").limit(n).drop("_draw", "_row")
    else:
        out = near.where(_among_smallest(near, n, limit)).drop("_draw", "_row")
    return out.orderBy(*order_by) if order_by else out


def _numbered(drawn: DataFrame) -> tuple[DataFrame, int]:
    """The rows written, with a number that tells equal draws apart, and how many they are, observed while they are written."""
    seen = Observation()
    rows = materialize(drawn.withColumn("_row", F.monotonically_increasing_id()).observe(seen, F.count(F.lit(1)).alias("rows")))
    return rows, seen.get["rows"]


def _among_smallest(near: DataFrame, n: int, limit: int) -> Column:
    """Whether a row is one of the n smallest by draw, then number."""
    draw, below = _nth(near, "_draw", 0, limit, n)
    equal = near.where(F.col("_draw") == draw)
    facts = equal.agg(F.count(F.lit(1)).alias("rows"), F.max("_row").alias("last")).first()
    if facts["rows"] == n - below:
        return F.col("_draw") <= draw
    row, _ = _nth(equal, "_row", 0, facts["last"] + 1, n - below)
    return (F.col("_draw") < draw) | ((F.col("_draw") == draw) & (F.col("_row") <= row))


def _nth(rows: DataFrame, name: str, low: int, high: int, n: int) -> tuple[int, int]:
    """The n-th smallest of a column of integers in [low, high), and how many are smaller: the range that holds it is counted finer and finer."""
    value, before = F.col(name), 0
    while high - low > 1:
        width = -(-(high - low) // RANGES)
        inside = rows.where((value >= low) & (value < high))
        counts = inside.groupBy(F.expr(f"({name} - {low}) div {width}").alias("r")).agg(F.count(F.lit(1)).alias("c")).orderBy("r").collect()
        for r in counts:  # at most RANGES rows
            if before + r["c"] >= n:
                break
            before += r["c"]
        low, high = low + r["r"] * width, min(high, low + (r["r"] + 1) * width)
        if r["c"] <= LAST_ROWS:
            last = sorted(x[0] for x in rows.where((value >= low) & (value < high)).select(name).collect())
            found = last[n - before - 1]
            return found, before + sum(x < found for x in last)
    return low, before


def sample_facts(df: DataFrame, n: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row: rows there are, rows a sample keeps, and whether it leaves any out."""
    n = config.plot_sample_size if n is None else n
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("original_count"), F.least(rows, F.lit(n).cast("long")).alias("plotted_count"),
                  (rows > n).alias("sampled"))


def time_axis(types: Mapping[str, str]) -> str | None:
    """The shared x axis: the first datetime column, usable or not."""
    return next((c for c, t in types.items() if t == "datetime"), None)


def aligned_series(df: DataFrame, types: Mapping[str, str], columns: Sequence[str] | None = None, *,
                   sample: int | None = None, key: Sequence[str] | None = None, order_by: Sequence[str] | None = None,
                   total: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """Chart columns of the same rows: all of them, or one common sample.

    Numbers become finite doubles or null, moments ISO text, the rest text;
    ``x_axis`` repeats the first datetime column of the table.
    """
    if sample is not None:
        df = sample_rows(df, sample, key=key, order_by=order_by, total=total, config=config)
    elif order_by:
        df = df.orderBy(*order_by)
    out = []
    for c in columns or types:
        if types[c] == "numeric":
            out.append(finite(df, c).alias(c))
        elif types[c] == "datetime" and kind_is_moment(df, c):
            out.append(iso_from_micros(micros(df, c)).alias(c))
        else:
            out.append(cell_text(df, c).alias(c))
    axis = time_axis(types)
    if axis is not None:
        moment = iso_from_micros(micros(df, axis)) if kind_is_moment(df, axis) else cell_text(df, axis)
        out.append(moment.alias("x_axis"))
    return df.select(*out)
