"""Mergeable profile states: one scan gives one row per column, and rows of later batches or other files are merged into it.

A state holds counts, range, mean and central moments, a quantile sketch and a distinct-count sketch. Moments of two states
merge about their common mean without losing digits; sketches merge by their own union. ``state(A)`` merged with ``state(B)``
is ``state(A and B)``: exactly for counts and range, to rounding for moments, within their bounds for sketches. A state is a
small table, so it can be written beside the data and brought up to date by each batch, also from ``foreachBatch`` of a stream.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimlark.config import DEFAULT, Config
from skimlark.functions.exprs import FLOATING, NESTED, TEMPORAL, col, dtype_of, finite, iso_from_micros, micros, present

DISTINCT_BITS = 14
"""log2 of the buckets of a distinct-count sketch: a standard error of 0.8 %."""
SCHEMA = ["column", "rows", "count", "finite_count", "positive_infinity_count", "negative_infinity_count", "zero_count", "min", "max",
          "earliest_us", "latest_us", "text_chars", "mean", "m2", "m3", "m4", "quantiles", "distinct"]


HEAD = 1000
"""Rows that are looked at for a value of each column that its moments are taken about; which one changes rounding only."""
FAR = 1e150
"""Values beyond are no pivots, so that no difference overflows."""


def _pivots(df: DataFrame, columns: list[str]) -> list[float]:
    """A finite value of each column or 0: moments of values that are far from 0 for their spread keep their digits about it."""
    numbers = [c for c in columns if not isinstance(dtype_of(df, c), TEMPORAL + NESTED + (T.StringType,))]
    if not numbers:
        return [0.0] * len(columns)
    head = df.select(*[finite(df, c).alias(str(i)) for i, c in enumerate(numbers)]).limit(HEAD)
    row = head.agg(*[F.first(str(i), ignorenulls=True) for i in range(len(numbers))]).first()
    near = {c: float(x) for c, x in zip(numbers, row, strict=True) if x is not None and abs(x) < FAR}
    return [near.get(c, 0.0) for c in columns]


def _cell(df: DataFrame, position: int, name: str, pivot: float) -> Column:
    dtype = dtype_of(df, name)
    there = present(df, name)
    number = F.lit(None).cast("double") if isinstance(dtype, TEMPORAL + NESTED + (T.StringType,)) else finite(df, name)
    raw = col(name).cast("double") if isinstance(dtype, FLOATING) else F.lit(None).cast("double")
    moment = micros(df, name) if isinstance(dtype, TEMPORAL) else F.lit(None).cast("long")
    chars = F.length(col(name)).cast("long") if isinstance(dtype, T.StringType) else F.lit(None).cast("long")
    value = F.lit(None).cast("long") if isinstance(dtype, NESTED) else F.when(there.isNotNull(), F.xxhash64(there + 0.0 if isinstance(dtype, FLOATING) else there))
    return F.struct(F.lit(position).alias("position"), there.isNotNull().alias("there"), number.alias("v"), F.lit(pivot).alias("pivot"), (number - F.lit(pivot)).alias("d"), raw.alias("raw"), moment.alias("t"),
                    chars.alias("chars"), value.alias("value"))


def profile_state(df: DataFrame, columns: Sequence[str] | None = None, *, config: Config = DEFAULT) -> DataFrame:
    """One row per column, from one scan and a look at the first rows; every task hands on one row a column.

    Numbers are summarised as they are stored; texts are only counted, measured and told apart.
    """
    columns = list(columns or df.columns)
    pivots = _pivots(df, columns)
    cells = df.select(F.inline(F.array(*[_cell(df, i, c, pivots[i]) for i, c in enumerate(columns)])))
    v, n = F.col("v"), F.count("v")
    central = cells.groupBy("position").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("there").alias("count"), n.alias("finite_count"),
        F.count_if(F.col("raw") == float("inf")).alias("positive_infinity_count"), F.count_if(F.col("raw") == float("-inf")).alias("negative_infinity_count"),
        F.count_if(v == 0).alias("zero_count"), F.min("v").alias("min"), F.max("v").alias("max"), F.min("t").alias("earliest_us"), F.max("t").alias("latest_us"),
        F.sum("chars").alias("text_chars"), (F.max("pivot") + F.avg("d")).alias("mean"), F.var_pop("d").alias("_var"), F.skewness("d").alias("_skew"), F.kurtosis("d").alias("_kurt"),
        F.kll_sketch_agg_double("v", F.lit(config.sketch_k)).alias("quantiles"), F.hll_sketch_agg("value", F.lit(DISTINCT_BITS)).alias("distinct"))
    n, var = F.col("finite_count"), F.col("_var")
    moments = {
        "m2": var * n, "m3": F.when(n > 0, F.coalesce(F.when(var > 0, F.col("_skew")), F.lit(0.0)) * F.pow(var, F.lit(1.5)) * n),
        "m4": F.when(n > 0, F.when(var > 0, (F.col("_kurt") + 3) * var * var * n).otherwise(0.0)),
        "quantiles": F.when(n > 0, F.col("quantiles"))}
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "column"))
    counts = ["rows", "count", "finite_count", "positive_infinity_count", "negative_infinity_count", "zero_count"]
    return names.join(F.broadcast(central.withColumns(moments)), "position", "left").fillna(0, counts).select(*SCHEMA)


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all rows that the given states have seen, column by column; a column that one of them lacks is kept."""
    every = reduce(lambda a, b: a.unionByName(b), states)
    n = F.col("finite_count")
    common = every.groupBy("column").agg(F.try_divide(F.sum(n * F.col("mean")), F.sum(n)).alias("_mean"))  # one row per column
    both = every.join(F.broadcast(common), "column")
    d = F.when(n > 0, F.col("mean") - F.col("_mean"))
    m2, m3, m4 = F.col("m2"), F.col("m3"), F.col("m4")
    return both.groupBy("column").agg(
        *[F.sum(c).alias(c) for c in ("rows", "count", "finite_count", "positive_infinity_count", "negative_infinity_count", "zero_count")],
        F.min("min").alias("min"), F.max("max").alias("max"), F.min("earliest_us").alias("earliest_us"), F.max("latest_us").alias("latest_us"),
        F.sum("text_chars").alias("text_chars"), F.max("_mean").alias("mean"),
        F.sum(m2 + n * d**2).alias("m2"), F.sum(m3 + 3 * d * m2 + n * d**3).alias("m3"), F.sum(m4 + 4 * d * m3 + 6 * d**2 * m2 + n * d**4).alias("m4"),
        F.kll_merge_agg_double(F.when(n > 0, F.col("quantiles"))).alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    ).withColumn("quantiles", F.when(n > 0, F.col("quantiles"))).select(*SCHEMA)


def profile_of_state(state: DataFrame) -> DataFrame:
    """The profile that a state knows, one row per column.

    Counts, range and moments are those of all rows; quartiles and ``distinct_estimate`` come from sketches.
    """
    n, var = F.col("finite_count").cast("double"), F.try_divide(F.col("m2"), F.col("finite_count"))
    varies = F.col("max") > F.col("min")
    g1 = F.when(varies, F.col("m3") / n / F.pow(var, F.lit(1.5)))
    g2 = F.when(varies, F.col("m4") / n / (var * var) - 3)
    variance = F.when(n > 1, F.when(varies, F.col("m2") / (n - 1)).otherwise(0.0))
    quantile = lambda p: F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    missing = F.col("rows") - F.col("count")
    return state.select(
        "column", "rows", "count", missing.alias("missing_count"), F.try_divide(missing.cast("double"), F.col("rows")).alias("missing_rate"),
        "finite_count", "positive_infinity_count", "negative_infinity_count", "zero_count", "min", "max", "mean", F.sqrt(variance).alias("std"),
        variance.alias("variance"), F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
        *[quantile(p).alias(name) for name, p in (("q1_estimate", 0.25), ("median_estimate", 0.5), ("q3_estimate", 0.75))],
        F.hll_sketch_estimate("distinct").alias("distinct_estimate"),
        iso_from_micros(F.col("earliest_us")).alias("earliest"), iso_from_micros(F.col("latest_us")).alias("latest"),
        F.try_divide(F.col("text_chars").cast("double"), F.col("count")).alias("avg_len"))


def approximate_distinct(df: DataFrame, columns: Sequence[str] | None = None, *, config: Config = DEFAULT) -> DataFrame:
    """``column, distinct_estimate``: opt-in estimates in place of exact counts, without a shuffle of values."""
    return profile_of_state(profile_state(df, columns, config=config)).select("column", "distinct_estimate")
