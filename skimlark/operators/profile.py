"""Profiles: the dataset as a whole, numeric, categorical and datetime columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimlark.config import DEFAULT, Config
from skimlark.functions.exprs import (
    FLOATING, INTEGRAL, NESTED, TEMPORAL, col, dtype_of, finite, is_missing, iso_from_micros, micros, parse_number, present)
from skimlark.functions.order import attach_groups, exact_quantiles, materialize, previous_value, running_total
from skimlark.functions.values import chunks, one_row, top_values, value_counts

NUMERIC_FIELDS = [
    "count", "missing_count", "missing_rate", "finite_count", "positive_infinity_count", "negative_infinity_count",
    "mean", "median", "min", "max", "std", "variance", "q1", "q3", "iqr", "skewness", "kurtosis", "zero_count",
    "zero_rate", "outlier_count", "outlier_rate"]


def quartiles(df: DataFrame, columns: Sequence[str], config: Config = DEFAULT, rows: int | None = None) -> dict[str, tuple[float, float, float]]:
    """Exact quartiles of each column's finite values: three numbers per column on the driver."""
    out = {}
    rows = df.count() if rows is None else rows
    for part in chunks(list(columns), config.columns_per_pass):
        table = exact_quantiles(df, {c: finite(df, c) for c in part}, rows=rows, config=config)
        out.update({r["column"]: tuple(r["q"]) for r in table.collect()})
    return out


def fences(q1: float, q3: float) -> tuple[float, float]:
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach


def numeric_profile(df: DataFrame, columns: Sequence[str], *, rows: int | None = None, config: Config = DEFAULT) -> DataFrame:
    """One row of moments, quartiles and outlier counts per column.

    The quartiles are found first. Then one aggregate over (column, value) cells,
    partial on every task, does the rest: power sums around the median, which is
    never more than one deviation from the mean, and values beyond the fences.
    Grouping by column keeps the aggregate's generated code the same for any number
    of columns; very wide tables are read some columns at a time. ``rows``: the
    number of rows where it is known.
    """
    cuts = quartiles(df, list(columns), config, rows)
    return _stack([_power_sums(df, part, cuts) for part in chunks(list(columns), config.columns_per_pass)])


def _power_sums(df: DataFrame, columns: Sequence[str], cuts: dict[str, tuple[float, float, float]]) -> DataFrame:
    def per_column(pick) -> Column:
        """A number per column, chosen by the cell's position."""
        numbers = [pick(cuts[c]) if c in cuts else None for c in columns]
        return F.get(F.array(*[F.lit(x).cast("double") for x in numbers]), F.col("position"))

    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), _raw_number(df, c).alias("x"),
                 present(df, c).isNotNull().alias("there")) for i, c in enumerate(columns)])))
    known = cells.withColumn("v", F.when(F.abs("x") < float("inf"), F.col("x"))).withColumn(
        "d", F.col("v") - per_column(lambda q: q[1]))
    v, d, square = F.col("v"), F.col("d"), F.col("d") * F.col("d")
    spread = per_column(lambda q: q[2] - q[0]) > 0
    outside = (v < per_column(lambda q: fences(q[0], q[2])[0])) | (v > per_column(lambda q: fences(q[0], q[2])[1]))
    sums = known.groupBy("position", "column").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("there").alias("count"), F.count("v").alias("finite_count"),
        F.count_if(F.col("x") == float("inf")).alias("positive_infinity_count"),
        F.count_if(F.col("x") == float("-inf")).alias("negative_infinity_count"),
        F.min("v").alias("min"), F.max("v").alias("max"), F.count_if(v == 0).alias("zero_count"),
        F.count_if(spread & outside).alias("outlier_count"),
        F.sum(d).alias("s1"), F.sum(square).alias("s2"), F.sum(square * d).alias("s3"), F.sum(square * square).alias("s4"))

    n, c = F.col("finite_count").cast("double"), F.col("count")
    shift, p2, p3, p4 = (F.try_divide(F.col(f"s{k}"), n) for k in (1, 2, 3, 4))  # shift: mean minus median
    m2 = F.greatest(p2 - shift**2, F.lit(0.0))
    m3 = p3 - 3 * shift * p2 + 2 * shift**3
    m4 = p4 - 4 * shift * p3 + 6 * shift**2 * p2 - 3 * shift**4
    varies = F.col("max") > F.col("min")
    g1 = F.when(varies, m3 / F.pow(m2, F.lit(1.5)))
    g2 = F.when(varies, m4 / (m2 * m2) - 3)
    variance = F.when(n > 1, F.when(varies, m2 * n / (n - 1)).otherwise(0.0))
    q1, median, q3 = (per_column(lambda q, j=j: q[j]) for j in range(3))
    made = {
        "missing_count": F.col("rows") - c,
        "missing_rate": F.try_divide((F.col("rows") - c).cast("double"), F.col("rows")),
        "mean": median + shift, "median": median, "std": F.sqrt(variance), "variance": variance,
        "q1": q1, "q3": q3, "iqr": q3 - q1,
        "skewness": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
        "zero_rate": F.try_divide(F.col("zero_count").cast("double"), n),
        "outlier_rate": F.try_divide(F.col("outlier_count").cast("double"), n)}
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "column"))
    counts = ["rows", "count", "finite_count", "positive_infinity_count", "negative_infinity_count", "zero_count", "outlier_count"]
    complete = names.join(F.broadcast(sums), ["position", "column"], "left").fillna(0, counts)  # one row per column
    return complete.withColumns(made).select("column", *NUMERIC_FIELDS)


def _raw_number(df: DataFrame, name: str) -> Column:
    """The value as double with infinities kept and NaN as null; strings are parsed."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, FLOATING):
        return present(df, name).cast("double")
    return parse_number(col(name)) if isinstance(dtype, T.StringType) else finite(df, name)


def _stack(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def field_statistics(df: DataFrame, columns: Sequence[str], *, config: Config = DEFAULT) -> DataFrame:
    """The statistics table of the effective-numeric columns."""
    return numeric_profile(df, columns, config=config).select(
        "column", "mean", "median", "std", "min", "max", "q1", "q3", "iqr", "skewness", "outlier_count")


def categorical_profile(df: DataFrame, columns: Sequence[str], *, top_k: int | None = None, rows: int | None = None,
                        config: Config = DEFAULT) -> DataFrame:
    """Counts, exact distinct count and most frequent values, one row per column.

    Distinct count and top list read the same shuffle of value counts.
    """
    columns = list(columns)
    k = top_k or config.top_k_categories
    rows = F.lit(df.count() if rows is None else rows)
    names = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "column"))
    counts = value_counts(df, columns)
    # both readers need the counts, so that they can share one shuffle
    unique = counts.groupBy("position").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("count").alias("count"))
    tops = top_values(df, counts, columns, k).groupBy("position").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", F.col("count").alias("n")))).alias("_top"))  # <= k each
    base = names.join(F.broadcast(unique), "position", "left").fillna(0, ["count", "unique_count"])
    n = F.col("count")
    share = lambda c: F.try_divide(c.cast("double"), n)
    first = F.get("_top", F.lit(0))
    return (
        base.join(F.broadcast(tops), "position", "left")
        .select(
            "column", "count", (rows - n).alias("missing_count"),
            F.try_divide((rows - n).cast("double"), rows).alias("missing_rate"), "unique_count",
            F.coalesce(share(F.col("unique_count")), F.lit(0.0)).alias("unique_ratio"),
            first["value"].alias("top_value"), F.coalesce(first["n"], F.lit(0)).cast("long").alias("top_count"),
            share(first["n"]).alias("top_share"),
            F.transform("_top", lambda t: F.struct(
                t["value"].alias("value"), t["n"].alias("count"), share(t["n"]).alias("share"))).alias("top_values")))


def datetime_profile(df: DataFrame, columns: Sequence[str], *, order_by: Sequence[str] | None = None,
                     config: Config = DEFAULT) -> DataFrame:
    """Range, repeats, order and typical interval of date and timestamp columns.

    ``monotonic_increasing`` is a statement about row order, so it needs
    ``order_by`` (rows tied there may stand in any order); otherwise it is null.
    Intervals in microseconds.
    """
    columns = list(columns)
    moments = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), micros(df, c).cast("long").alias("t")) for i, c in enumerate(columns)])))
    # all columns in one table of distinct moments, written once; the order is split by (column, moment)
    distinct = materialize(moments.where("t IS NOT NULL").groupBy("position", "t").agg(F.count(F.lit(1)).alias("c")))
    cells, rows = distinct.count(), df.count()
    spans = materialize(distinct.groupBy("position").agg(F.sum("c").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")))  # a row per column
    steps = previous_value(distinct, ["position"], ["t"], "t", cells, config)
    # n sorted values have n - 1 gaps: repeats give zeros, distinct neighbours give steps
    gaps = (
        steps.select("position", F.inline(F.array(
            F.struct((F.col("t") - F.col("previous")).alias("gap"), F.lit(1).cast("long").alias("c")),
            F.struct(F.lit(0).cast("long").alias("gap"), (F.col("c") - 1).alias("c")))))
        .where("gap IS NOT NULL AND c > 0").groupBy("position", "gap").agg(F.sum("c").alias("c")))
    n, upto = F.col("n"), F.col("before") + F.col("c")
    placed = running_total(gaps, ["position"], ["gap"], "c", 2 * cells, config).join(F.broadcast(spans.select("position", "n")), "position")
    median = placed.groupBy("position").agg(
        F.max(F.when(F.col("gap") == 0, F.col("c"))).alias("repeats"),
        ((F.min(F.when(upto > F.floor((n - 2) / 2), F.col("gap")))
          + F.min(F.when(upto > F.floor((n - 1) / 2), F.col("gap")))) / 2).alias("median_interval_us"))
    base = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column")) for i, c in enumerate(columns)])))
    for found in (spans, median, _in_order(df, columns, order_by, rows, config)):
        base = base.join(F.broadcast(found), "position", "left")
    there, missing = F.coalesce(n, F.lit(0)).cast("long"), F.lit(rows).cast("long") - F.coalesce(n, F.lit(0))
    return base.select(
        "column", there.alias("count"), missing.alias("missing_count"),
        F.try_divide(missing.cast("double"), F.lit(rows)).alias("missing_rate"),
        iso_from_micros(F.col("lo")).alias("earliest"), iso_from_micros(F.col("hi")).alias("latest"),
        F.when(n > 1, F.col("hi") - F.col("lo")).alias("span_us"),
        F.coalesce("repeats", F.lit(0)).cast("long").alias("duplicate_timestamp_count"),
        F.when(there > 0, F.col("monotonic_increasing")).alias("monotonic_increasing"), "median_interval_us")


def _in_order(df, columns, order_by, rows, config):
    """``position, monotonic_increasing``: does each column never fall along ``order_by``?

    Equal order keys collapse to their smallest and largest values first, so a
    frequent key costs one row; then neighbours are compared, column by column.
    """
    if not order_by:
        return df.sparkSession.range(0).select(F.lit(0).alias("position"), F.lit(None).cast("boolean").alias("monotonic_increasing"))
    keys = [f"_o{i}" for i in range(len(order_by))]
    spans = df.select(*[micros(df, c).cast("long").alias(f"_t{i}") for i, c in enumerate(columns)],
                      *[col(o).alias(k) for o, k in zip(order_by, keys)]).groupBy(*keys).agg(
        *[f(f"_t{i}").alias(f"{e}{i}") for i in range(len(columns)) for f, e in ((F.min, "_lo"), (F.max, "_hi"))])
    cells = spans.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.col(f"_lo{i}").alias("_lo"), F.col(f"_hi{i}").alias("_hi"))
        for i in range(len(columns))]))).where("_lo IS NOT NULL")
    return previous_value(cells, ["position"], keys, "_hi", rows * len(columns), config).groupBy("position").agg(
        F.bool_and(F.col("previous").isNull() | (F.col("previous") <= F.col("_lo"))).alias("monotonic_increasing"))


def marked(c: Column, kind: T.DataType) -> Column:
    """A value with null marks and lengths at every level, so that different nested values are hashed differently; maps by ascending key."""
    if isinstance(kind, T.StructType):
        return F.struct(c.isNull(), *[marked(c.getField(f.name), f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.struct(c.isNull(), F.size(c), F.transform(c, lambda x: marked(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(c)), lambda k: F.struct(marked(k, kind.keyType), marked(F.element_at(c, k), kind.valueType)))
        return F.struct(c.isNull(), F.size(c), pairs)
    return F.struct(c.isNull(), c)


def _row_parts(df: DataFrame) -> list[Column]:
    """Values and null marks of a whole row; equal rows have equal parts."""
    parts = []
    for f in df.schema.fields:
        c = present(df, f.name)
        parts += [marked(c, f.dataType)] if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else [c.isNull(), c]
    return parts


def row_fingerprint(df: DataFrame) -> list[Column]:
    """128 bits that stand for a whole row: two seeded hashes over values and null marks."""
    return [F.xxhash64(F.lit(seed), *_row_parts(df)).alias(name) for seed, name in ((1, "_h1"), (2, "_h2"))]


def duplicate_rows(df: DataFrame, *, proof: bool = False, bits: int = 64, config: Config = DEFAULT) -> DataFrame:
    """``rows, distinct_rows, duplicate_rows, duplicate_rate`` of whole rows.

    Rows are grouped by a 128-bit fingerprint, so the shuffle carries 16 bytes
    per distinct row instead of the row. Nulls are equal to each other, as are NaNs.

    ``proof`` compares the rows themselves wherever a fingerprint occurs twice: the smallest and the largest row of a fingerprint
    are equal, or its rows are counted by value. Only such rows are shuffled, after each task has reduced them to two a fingerprint.
    ``bits`` narrows each of the two hashes, so that a test can make them collide.
    """
    prints = df.select(*[F.shiftrightunsigned(h, 64 - bits).alias(n) if bits < 64 else h for h, n in zip(row_fingerprint(df), KEYS)])
    groups = prints.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("c"))
    hidden = F.lit(0)
    if proof:
        groups = materialize(groups)
        hidden = F.lit(_hidden_rows(df, groups.where("c > 1"), bits, config))
    n, d = F.col("rows"), F.col("distinct_rows")
    return (
        groups
        .agg(F.coalesce(F.sum("c"), F.lit(0)).alias("rows"), (F.count(F.lit(1)) + hidden).alias("distinct_rows"))
        .select("rows", "distinct_rows", (n - d).alias("duplicate_rows"),
                F.coalesce(F.try_divide((n - d).cast("double"), n), F.lit(0.0)).alias("duplicate_rate")))


KEYS = ["_h1", "_h2"]


def _hidden_rows(df: DataFrame, groups: DataFrame, bits: int, config: Config) -> int:
    """Number of different rows that share their fingerprint with a smaller one; ``groups`` are fingerprints with their counts."""
    if groups.isEmpty():
        return 0
    hashes = [F.shiftrightunsigned(h, 64 - bits).alias(n) if bits < 64 else h for h, n in zip(row_fingerprint(df), KEYS)]
    rows = df.select(*hashes, F.struct(*[p.alias(f"_{i}") for i, p in enumerate(_row_parts(df))]).alias("_row"))
    ends = attach_groups(rows, groups, KEYS, "c", config).groupBy(*KEYS).agg(
        F.min("_row").alias("lo"), F.max("_row").alias("hi"), F.count(F.lit(1)).alias("c"))
    mixed = materialize(ends.where("NOT (lo <=> hi)").select(*KEYS, "c"))
    if mixed.isEmpty():
        return 0
    each = attach_groups(rows, mixed, KEYS, "c", config).groupBy(*KEYS, "_row").agg(F.count(F.lit(1)).alias("c"))
    return each.count() - mixed.count()


def _bytes(df: DataFrame, name: str) -> Column:
    """Estimated size of one value: fixed width, or bytes of the text."""
    dtype, c = dtype_of(df, name), col(name)
    if isinstance(dtype, T.StringType):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, INTEGRAL + FLOATING + (T.BooleanType,)):
        return F.coalesce(F.array_size(c), F.lit(0)) * _width(dtype.elementType)
    if isinstance(dtype, NESTED):
        text = F.to_json(F.struct(c)) if not isinstance(dtype, T.BinaryType) else c
        return F.coalesce(F.octet_length(text), F.lit(0))
    return F.lit(_width(dtype))


def _width(dtype: T.DataType) -> int:
    """Bytes of the plain types."""
    widths = [(T.BooleanType, 1), (T.ByteType, 1), (T.ShortType, 2), (T.IntegerType, 4), (T.FloatType, 4),
              (T.DateType, 4), (T.DecimalType, 16)]
    return next((w for t, w in widths if isinstance(dtype, t)), 8)


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: size, missing cells, duplicate and empty rows, empty columns."""
    names = df.columns
    missing = [is_missing(df, c) for c in names]
    flags = df.select(
        F.array(*missing).alias("_m"), F.forall(F.array(*missing), lambda m: m).alias("_empty"),
        sum((_bytes(df, c).cast("long") for c in names), F.lit(0).cast("long")).alias("_bytes"))
    counts = flags.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col("_m")[i]).alias(f"m{i}") for i in range(len(names))],
        F.count_if("_empty").alias("fully_empty_rows"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("memory_bytes"))
    rows, width = F.col("rows"), len(names)
    cells = sum((F.col(f"m{i}") for i in range(width)), F.lit(0).cast("long"))
    empty = sum(((F.col(f"m{i}") == rows).cast("long") for i in range(width)), F.lit(0).cast("long"))
    dup = duplicate_rows(df).select("duplicate_rows", "duplicate_rate")
    return one_row(counts, dup).select(
        "rows", F.lit(width).cast("long").alias("columns"), cells.alias("missing_cells"),
        F.coalesce(F.try_divide(cells.cast("double"), rows * width), F.lit(0.0)).alias("missing_rate"),
        "duplicate_rows", "duplicate_rate", "fully_empty_rows", empty.alias("fully_empty_columns"), "memory_bytes")


__all__ = ["numeric_profile", "field_statistics", "categorical_profile", "datetime_profile", "duplicate_rows",
           "dataset_profile", "quartiles", "fences", "TEMPORAL"]
