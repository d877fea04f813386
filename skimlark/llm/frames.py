"""Help for DataFrames: shared folders, renaming against clashes, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skimlark.functions.order import passing

BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)


def small_batches(spark: SparkSession) -> None:
    """Batches of texts that pass to Python hold 8 MB at most, so that a task's memory does not grow with its texts; a setting of the session's own stays."""
    name, size = BATCH_BYTES
    if spark.conf.get(name, None) in ("67108864b", "64MB", "67108864"):  # the default
        spark.conf.set(name, str(size))


def shared(spark: SparkSession) -> str:
    """Folder that driver and executors see: the session's ``spark.checkpoint.dir``; local masters without one get a temporary folder."""
    small_batches(spark)
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or (
        context._jsc.sc().getCheckpointDir().get() if context._jsc.sc().getCheckpointDir().isDefined() else None)
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="skimlark-llm-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named


def kept(df: DataFrame) -> DataFrame:
    """The rows written once to the shared folder; their lineage ends there, and the shuffles that made them go."""
    shared(df.sparkSession)
    with passing(df.sparkSession):
        return df.select("*").checkpoint()


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows written as Parquet under the shared folder and read again."""
    path = os.path.join(shared(df.sparkSession), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reader(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node that has an edge ``(a, b)``; component is the smallest node reached.

    Large star and small star in turn; each round links every neighbour to the smallest one. Minima are partial
    aggregates and rows return to them by a join that can be split, so a node with very many edges is no single task.
    """
    links = kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = kept(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
