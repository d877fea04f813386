"""Long-form value counts shared by distinct counts, top-k lists and shares."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimlark.functions.exprs import FLOATING, INTEGRAL, TEMPORAL, col, dtype_of, micros_sql, present_sql

LONG_TEXT = 40  # characters; longer strings are grouped by digest and this prefix


def chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def melt(row: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row of ``{index}_{field}`` columns to one row per column."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 *[F.col(f"{i}_{f}").alias(f) for f in fields])
        for i, c in enumerate(names)])))


def one_row(*tables: DataFrame) -> DataFrame:
    """Single-row tables with different columns, merged into one row."""
    merged = tables[0]
    for t in tables[1:]:
        merged = merged.unionByName(t, allowMissingColumns=True)
    return merged.agg(*[F.max(c).alias(c) for c in merged.columns])


def value_key(df: DataFrame, position: int, name: str) -> str:
    """SQL text of a struct that identifies a value of any plain type.

    Numbers and moments stay binary. A long string is carried as digest plus
    prefix, so that counting documents does not shuffle documents.
    """
    dtype = dtype_of(df, name)
    c = present_sql(df, name)
    whole, real, text, digest = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS STRING)", "CAST(NULL AS BINARY)"
    if isinstance(dtype, INTEGRAL):
        whole = f"CAST({c} AS BIGINT)"
    elif isinstance(dtype, FLOATING):
        real = f"CAST({c} AS DOUBLE)"
    elif isinstance(dtype, TEMPORAL):
        whole = micros_sql(df, name)
    else:
        string = f"CAST({c} AS STRING)"
        text = f"substring({string}, 1, {LONG_TEXT})"
        digest = f"if(length({string}) > {LONG_TEXT}, unhex(md5({string})), NULL)"
    return (f"named_struct('position', {position}, 'whole', {whole}, 'real', {real}, 'text', {text}, "
            f"'digest', {digest}, 'there', {c} IS NOT NULL)")


KEY = ["position", "whole", "real", "text", "digest"]


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``position, whole, real, text, digest, count`` of every distinct value."""
    cells = df.selectExpr(f"inline(array({', '.join(value_key(df, i, c) for i, c in enumerate(names))}))")
    return cells.where("there").groupBy(*KEY).agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column, u``: exact number of distinct non-missing values."""
    labels = F.array(*[F.lit(c) for c in names])
    return (
        value_counts(df, names).groupBy("position").agg(F.count(F.lit(1)).alias("u"))
        .select(F.get(labels, F.col("position")).alias("column"), "u"))


def _shown(df: DataFrame, names: Sequence[str]) -> Column:
    """The counted value as text; prefix only for long strings."""
    out = F.coalesce(F.col("text"), F.col("whole").cast("string"), F.col("real").cast("string"))
    moments = [i for i, c in enumerate(names) if isinstance(dtype_of(df, c), TEMPORAL)]
    if moments:
        moment = F.timestamp_add("MICROSECOND", F.col("whole"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        out = F.when(F.col("position").isin(moments), moment.cast("string")).otherwise(out)
    return out


def top_values(df: DataFrame, counts: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """``position, rank, value, count``: the k most frequent values per column.

    Ties go to the smaller value (long strings: smaller prefix, then digest).
    The cut works on counts, prefixes and digests, so each task passes on at
    most k rows per column; whole long strings are fetched for the k finalists.
    """
    shown = counts.withColumn("value", _shown(df, names))
    order = Window.partitionBy("position").orderBy(F.desc("count"), F.asc("value"), F.asc_nulls_first("digest"))
    finalists = (
        shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("position", "rank", "value", "count", "digest"))
    texts = [c for c in names if isinstance(dtype_of(df, c), T.StringType)]
    if texts:
        wanted = F.broadcast(finalists.where("digest IS NOT NULL").select("position", "digest"))  # <= k per column
        cells = df.select(F.inline(F.array(*[
            F.struct(F.lit(names.index(c)).alias("position"), col(c).alias("whole_text")) for c in texts])))
        cells = cells.where(F.length("whole_text") > LONG_TEXT).withColumn("digest", F.unhex(F.md5("whole_text")))
        found = (
            cells.join(wanted, ["position", "digest"], "left_semi")
            .groupBy("position", "digest").agg(F.any_value("whole_text").alias("whole_text")))
        finalists = (
            finalists.join(found, ["position", "digest"], "left")
            .withColumn("value", F.coalesce("whole_text", "value")))
    return finalists.select("position", "rank", "value", "count")
