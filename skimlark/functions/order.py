"""Global order without one task seeing all rows.

Running totals, neighbours and exact quantiles over any number of rows. Each
function first asks how many rows there can be: up to
``Config.single_task_rows`` a plain window per key is used, beyond that the rows
are range-partitioned, the partition number is stored with them, and a small
table of per-partition totals carries the sums over the seams.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skimlark.config import DEFAULT, Config


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, ``spark.checkpoint.dir``; a local one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="skimlark-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go at their end: for tables that are collected or written, whose shuffles nobody reads again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, config: Config) -> DataFrame:
    """Rows split by range of (keys, order); ``_part`` numbers the ranges.

    The bounds come from a sample, so the numbers are only the same for every
    reader once they are written: hence the checkpoint.
    """
    parts = min(config.range_parts, max(2, math.ceil(rows / config.single_task_rows)))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return materialize(ranged.withColumn("_part", F.spark_partition_id()))


def _join_seams(parts: DataFrame, seams: DataFrame, on: list[str], rows: int, config: Config) -> DataFrame:
    # A range split yields at most (#keys + #parts) seam rows; the key count is
    # only known by counting, and the seam table is cheap to count.
    small = seams.count() <= config.broadcast_rows
    return parts.join(F.broadcast(seams) if small else seams, on)


def attach_groups(base: DataFrame, table: DataFrame, by: Sequence[str], weight: str, config: Config = DEFAULT) -> DataFrame:
    """``base`` joined with one row per group; ``weight`` counts the group's rows in ``base``.

    A table beyond ``Config.broadcast_rows`` is cut in two: groups with more than a ``broadcast_rows``-th of all rows, which are
    fewer than ``broadcast_rows`` by that, are broadcast; only rows of the others are shuffled. No hot group is one task. Null keys match nothing.
    """
    by = list(by)
    if table.count() <= config.broadcast_rows:
        return base.join(F.broadcast(table), by)
    total = table.agg(F.sum(weight)).first()[0] or 0
    heavy = F.coalesce(F.col(weight), F.lit(0)) * config.broadcast_rows > total
    hot = F.broadcast(table.where(heavy))
    rest = base.join(F.broadcast(table.where(heavy).select(*by)), by, "left_anti").join(table.where(~heavy), by)
    return base.join(hot, by).unionByName(rest)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str, rows: int, config: Config = DEFAULT
) -> DataFrame:
    """Adds ``before``: the sum of ``weight`` over earlier rows with the same keys.

    ``(keys, order)`` must be unique; ``rows`` is an upper bound of the row count.
    """
    keys, order = list(keys), list(order)
    earlier = (Window.unboundedPreceding, -1)
    if rows <= config.single_task_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*earlier)
        return df.withColumn("before", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    parts = range_parts(df, keys, order, rows, config)
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(*earlier)
    seams = (
        parts.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
        .select(*keys, "_part", F.coalesce(F.sum("_sum").over(across), F.lit(0)).alias("_offset"))
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(*earlier)
    return (
        _join_seams(parts, seams, [*keys, "_part"], rows, config)
        .withColumn("before", F.col("_offset") + F.coalesce(F.sum(weight).over(within), F.lit(0)))
        .drop("_part", "_offset")
    )


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rows: int, config: Config = DEFAULT
) -> DataFrame:
    """Adds ``previous``: ``value`` of the row just before, within the same keys."""
    keys, order = list(keys), list(order)
    if rows <= config.single_task_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn("previous", F.lag(value).over(w))
    parts = range_parts(df, keys, order, rows, config)
    position = F.struct(*[F.col(c) for c in order])
    across = Window.partitionBy(*keys).orderBy("_part")
    seams = (
        parts.groupBy(*keys, "_part").agg(F.max_by(value, position).alias("_last"))
        .select(*keys, "_part", F.lag("_last").over(across).alias("_seam"))
    )
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    return (
        _join_seams(parts, seams, [*keys, "_part"], rows, config)
        .withColumn("_first", F.row_number().over(within) == 1)
        .withColumn("previous", F.when(F.col("_first"), F.col("_seam")).otherwise(F.lag(value).over(within)))
        .drop("_part", "_seam", "_first")
    )


def exact_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    by: Sequence[str] = (),
    rows: int | None = None,
    config: Config = DEFAULT,
) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns, optionally by group.

    Returns ``by..., column, n, q`` with ``q`` an array in the order of ``probs``.
    Nulls are skipped; ``by`` columns must not be null.

    Few rows: ``percentile`` over distinct values with their counts. Many rows:
    mergeable sketches give a narrow value bracket around every target rank, a
    second pass counts what lies below, and only the rows inside the brackets
    are shuffled and ordered. A bracket that misses its target is opened to the
    whole range, so the answer is exact in any case.
    """
    by = list(by)
    names = list(values)
    if rows is None:
        rows = df.count()
    base = df.select(*by, *[values[c].cast("double").alias(f"_v{i}") for i, c in enumerate(names)])
    if rows <= config.single_task_rows:
        picked = _counted_quantiles(base, len(names), probs, by)
    else:
        picked = _bracketed_quantiles(base, len(names), probs, by, config)
    labels = F.array(*[F.lit(c) for c in names])
    return picked.select(*by, F.get(labels, F.col("_k")).alias("column"), "n", "q")


def _counted_quantiles(base, width, probs, by):
    cells = base.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.col(f"_v{i}").alias("_v")) for i in range(width)]))).where("_v IS NOT NULL")
    counts = cells.groupBy(*by, "_k", "_v").agg(F.count(F.lit(1)).alias("_c"))
    # bounded: a key has no more than ``rows`` distinct values
    return counts.groupBy(*by, "_k").agg(
        F.sum("_c").alias("n"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_c")).alias("q"))


def _attach(base: DataFrame, table: DataFrame, by: list[str], config: Config) -> DataFrame:
    """Put the bracket columns next to the rows: literals, or a join by group, whose rows ``_rows`` counts."""
    if not by:
        row = table.first()
        return base.withColumns({c: F.lit(row[c]).cast(dict(table.dtypes)[c]) for c in table.columns})
    return attach_groups(base, table, by, "_rows", config)


def _bracketed_quantiles(base, width, probs, by, config):
    ks, js = range(width), range(len(probs))
    # Sketch per task slice first, then merge: no reducer meets all sketches of a big scan at once.
    slices = base.withColumn("_slice", F.spark_partition_id() % 512).groupBy(*by, "_slice").agg(
        *[F.kll_sketch_agg_double(f"_v{i}", F.lit(config.sketch_k)).alias(f"_s{i}") for i in ks],
        *[F.count(f"_v{i}").alias(f"_c{i}") for i in ks], F.count(F.lit(1)).alias("_rows"))
    merged = slices.groupBy(*by).agg(
        *[F.kll_merge_agg_double(F.when(F.col(f"_c{i}") > 0, F.col(f"_s{i}"))).alias(f"_s{i}") for i in ks],
        *[F.sum(f"_c{i}").alias(f"_n{i}") for i in ks], F.sum("_rows").alias("_rows"))

    def edge(i, p, shift):
        at = min(1.0, max(0.0, p + shift))
        return F.when(F.col(f"_n{i}") > 0, F.kll_sketch_get_quantile_double(F.col(f"_s{i}"), F.lit(float(at))))

    brackets = materialize(merged.select(
        *by, "_rows", *[f"_n{i}" for i in ks],
        *[edge(i, p, -config.sketch_slack).alias(f"_lo{i}_{j}") for i in ks for j, p in enumerate(probs)],
        *[edge(i, p, config.sketch_slack).alias(f"_hi{i}_{j}") for i in ks for j, p in enumerate(probs)]))

    rows = _attach(base, brackets.drop(*[f"_n{i}" for i in ks]), by, config)
    counted = rows.groupBy(*by).agg(
        *[F.count_if(F.col(f"_v{i}") < F.col(f"_lo{i}_{j}")).alias(f"_below{i}_{j}") for i in ks for j in js],
        *[F.count_if(F.col(f"_v{i}").between(F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}"))).alias(f"_in{i}_{j}")
          for i in ks for j in js])
    joined = brackets.join(counted, by) if by else _attach(brackets, counted, by, config)
    checked = [F.col(c) for c in (*by, "_rows")] + [F.col(f"_n{i}") for i in ks]
    for i in ks:
        for j, p in enumerate(probs):
            place = F.lit(float(p)) * (F.col(f"_n{i}") - 1)
            below, inside = F.col(f"_below{i}_{j}"), F.col(f"_in{i}_{j}")
            hit = (below <= F.floor(place)) & (F.ceil(place) < below + inside)
            lo, hi = F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")
            known = hit & (lo == hi)  # one frequent value fills the bracket: no rows needed (NaN bounds match none)
            checked += [
                F.when(known, lo).alias(f"_known{i}_{j}"),
                F.when(known, float("nan")).when(hit, lo).otherwise(float("-inf")).alias(f"_lo{i}_{j}"),
                F.when(known, float("nan")).when(hit, hi).otherwise(float("inf")).alias(f"_hi{i}_{j}"),
                F.when(hit, below).otherwise(F.lit(0)).alias(f"_below{i}_{j}"),
                F.when(known, F.lit(0)).when(hit, inside).otherwise(F.col(f"_n{i}")).alias(f"_in{i}_{j}")]
    final = materialize(joined.select(*checked))
    inside_rows = final.agg(F.sum(sum((F.col(f"_in{i}_{j}") for i in ks for j in js), F.lit(0)))).first()[0] or 0

    edges = final.select(*by, "_rows", *[f"{e}{i}_{j}" for e in ("_lo", "_hi") for i in ks for j in js])
    rows = _attach(base, edges, by, config)
    cells = rows.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.lit(j).alias("_j"),
                 F.when(F.col(f"_v{i}").between(F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")), F.col(f"_v{i}")).alias("_v"))
        for i in ks for j in js]))).where("_v IS NOT NULL")
    counts = cells.groupBy(*by, "_k", "_j", "_v").agg(F.count(F.lit(1)).alias("_c"))
    ranked = running_total(counts, [*by, "_k", "_j"], ["_v"], "_c", inside_rows, config)

    targets = final.select(*by, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_k"), F.lit(j).alias("_j"), F.lit(float(p)).alias("_p"),
                 F.col(f"_n{i}").alias("n"), F.col(f"_in{i}_{j}").alias("_inside"), F.col(f"_below{i}_{j}").alias("_below"),
                 F.col(f"_known{i}_{j}").alias("_known"))
        for i in ks for j, p in enumerate(probs)]))).where("n > 0")
    on = [*by, "_k", "_j"]
    placed = attach_groups(ranked, targets, on, "_inside", config) if by else ranked.join(F.broadcast(targets), on)
    upto = F.col("_below") + F.col("before") + F.col("_c")
    place = F.col("_p") * (F.col("n") - 1)
    picks = placed.groupBy(*on).agg(
        F.min(F.when(upto > F.floor(place), F.col("_v"))).alias("_l"),
        F.min(F.when(upto > F.ceil(place), F.col("_v"))).alias("_h"))
    value = F.coalesce("_known", F.col("_l") + (F.col("_h") - F.col("_l")) * (place - F.floor(place)))
    return targets.join(picks, on, "left").groupBy(*by, "_k").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("_j", value.alias("_q")))), lambda s: s["_q"]).alias("q"))
