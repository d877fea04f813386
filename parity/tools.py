"""Registry of checked queries, table access, and rounding alike in both engines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Stored kinds of the given tables' columns.
TABLES: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "int"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "int"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "int"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
             ("p_retailprice", "double")],
    "orders": [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
               ("o_orderdate", "moment"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "int"), ("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"),
                 ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
                 ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "moment")],
    "events": [("event_id", "int"), ("ts", "moment"), ("user_id", "int"), ("event_type", "string"), ("value", "double"),
               ("props", "string")],
    "documents": [("doc_id", "int"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "int")],
    "embeddings": [("vec_id", "int"), ("embedding", "nested"), ("label", "int")],
    "pages": [("page_id", "int"), ("url", "string"), ("html", "string")],
    "benchmark": [("item_id", "int"), ("text", "string")],
    "labels": [("doc_id", "int"), ("quality", "int"), ("toxic", "int")],
    "conversations": [("conv_id", "int"), ("turn", "int"), ("role", "string"), ("text", "string")],
}

# lineitem with gaps, infinities and stray content: one expression for both engines.
GAPS: list[tuple[str, str, str]] = [
    ("v_has", "double", "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END"),
    ("v_high", "double", "CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_tax END"),
    ("v_crit", "double", "CASE WHEN l_orderkey % 10 <> 0 THEN NULL ELSE l_discount END"),
    ("v_null", "double", "CAST(NULL AS DOUBLE)"),
    ("v_const", "string", "'same'"),
    ("v_near", "int", "CASE WHEN l_orderkey % 1000 = 0 THEN 1 END"),
    ("v_inf", "double", "CASE WHEN l_orderkey % 1000 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 1000 = 1 "
                        "THEN CAST('-Infinity' AS DOUBLE) ELSE l_extendedprice END"),
    ("v_head", "string", "CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE "
                         "concat('Heading of worksheet section ', CAST(l_linenumber AS {S})) END"),
    ("v_mixed", "string", "CASE WHEN l_orderkey % 2 = 0 THEN NULL WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS {S}) "
                          "ELSE concat('n/a-', CAST(l_suppkey AS {S})) END"),
    ("v_island", "double", "CASE WHEN l_orderkey % 50 <> 0 THEN NULL ELSE l_quantity END"),
]


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(*[f"{e.format(S='STRING')} AS {c}" for c, _, e in GAPS])


GAPS_SQL = "(SELECT " + ", ".join(f"{e.format(S='VARCHAR')} AS {c}" for c, _, e in GAPS) + " FROM lineitem)"


def stat(c: Column | str) -> Column:
    """A summed statistic to nine significant digits: summation order differs between engines."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string("%.8e", c).cast("double") + 0.0)


def exact(c: Column | str) -> Column:
    """A value computed in a few operations, to twelve significant digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.format_string("%.11e", c).cast("double") + 0.0)


def r6(c: Column | str) -> Column:
    """Ratios and correlations to six places."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + 0.0


def sql_stat(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NOT NULL THEN CAST(printf('%.8e', CAST(({e}) AS DOUBLE)) AS DOUBLE) + 0.0 END)"


def sql_exact(e: str) -> str:
    return f"(CASE WHEN ({e}) IS NOT NULL THEN CAST(printf('%.11e', CAST(({e}) AS DOUBLE)) AS DOUBLE) + 0.0 END)"


def sql_r6(e: str) -> str:
    return f"(round(CAST(({e}) AS DOUBLE), 6) + 0.0)"


def finish(df: DataFrame, **how) -> DataFrame:
    """Round the named columns; ``how`` maps a rounding name to columns."""
    for name, columns in how.items():
        f = {"stat": stat, "exact": exact, "r6": r6}[name]
        df = df.withColumns({c: f(c) for c in columns})
    return df


def union_sql(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)
