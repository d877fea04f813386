"""Correlation matrices, ranks, networks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

import skimlark as sk
from parity.tools import GAPS_SQL, finish, gaps, query, sql_r6, table, union_sql

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]
# columns with gaps, infinities and real dependence between them
MIXED = {
    "price": "l_extendedprice", "charge": "l_extendedprice * (1 - l_discount)",
    "taxed": "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice * (1 - l_discount) * (1 + l_tax) END",
    "size": "CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_quantity END",
    "steps": "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE -floor(l_extendedprice / 10000) END",
    "wild": "CASE WHEN l_orderkey % 1000 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity + l_tax END",
}
MIXED_SQL = "(SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in MIXED.items()) + " FROM lineitem)"


def mixed(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in MIXED.items()])


def _both(rel, a, b):
    return (f"(SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {rel} "
            f"WHERE isfinite(CAST({a} AS DOUBLE)) AND isfinite(CAST({b} AS DOUBLE)))")


def _r(expr="corr(x, y)"):
    return f"CASE WHEN isnan({expr}) THEN NULL ELSE {sql_r6(expr)} END"


def pearson_sql(rel, a, b):
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {_r()} AS r FROM {_both(rel, a, b)}"


def ranked_sql(rel, a, b):
    return f"""(SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS x,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS y FROM {_both(rel, a, b)})"""


def spearman_sql(rel, a, b):
    return f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, {_r()} AS r FROM {ranked_sql(rel, a, b)}"


def matrix_sql(rel, features, method, pair_sql):
    """All pairs, mirrored, and a diagonal of ones."""
    pairs = union_sql([pair_sql(rel, a, b) for a, b in combinations(features, 2)])
    diagonal = union_sql([
        f"SELECT '{a}', '{a}', '{method}', count(CASE WHEN isfinite(CAST({a} AS DOUBLE)) THEN 1 END), 1.0::DOUBLE FROM {rel}" for a in features])
    return f"""(WITH p AS ({pairs})
SELECT a AS feature_a, b AS feature_b, '{method}' AS method, n, r FROM p UNION ALL SELECT b, a, '{method}', n, r FROM p
UNION ALL {diagonal})"""


@query("usable_numeric", oracle=union_sql([
    f"""SELECT '{c}' AS "column", count(v) AS finite_count, count(v) >= 3 AND coalesce(min(v) < max(v), false) AS usable
FROM (SELECT CASE WHEN isfinite({c}) THEN {c} END AS v FROM {GAPS_SQL})""" for c in ("v_has", "v_high", "v_crit", "v_inf", "v_island")]))
def usable_numeric(spark, sf):
    df = gaps(spark, sf)
    return sk.usable_numeric(df, sk.type_map(df)).drop("position")


@query("pearson_matrix", oracle=f"""
SELECT * FROM {matrix_sql('lineitem', FEATURES, 'pearson', pearson_sql)}
UNION ALL SELECT * FROM {matrix_sql(MIXED_SQL, list(MIXED), 'pearson', pearson_sql)}""")
def pearson_matrix(spark, sf):
    out = sk.pearson_matrix(table(spark, sf, "lineitem"), FEATURES).unionByName(sk.pearson_matrix(mixed(spark, sf), list(MIXED)))
    return finish(out, r6=["r"])


@query("spearman_matrix", oracle=f"""
SELECT * FROM {matrix_sql('lineitem', FEATURES, 'spearman', spearman_sql)}
UNION ALL SELECT * FROM {matrix_sql(MIXED_SQL, list(MIXED), 'spearman', spearman_sql)}""")
def spearman_matrix(spark, sf):
    out = sk.spearman_matrix(table(spark, sf, "lineitem"), FEATURES).unionByName(sk.spearman_matrix(mixed(spark, sf), list(MIXED)))
    return finish(out, r6=["r"])


# sixteen columns, each with gaps of its own: 240 (column, mask) rankings
GAPPY = {f"g{i}": f"CASE WHEN (l_orderkey * 7 + l_linenumber * {i + 1}) % {i + 3} = 0 THEN NULL ELSE {FEATURES[i % 6]} * {1 + i // 6} + {i // 6} * l_discount END"
         for i in range(16)}
GAPPY_SQL = "(SELECT " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in GAPPY.items()) + " FROM lineitem)"


@query("spearman_masks", oracle=f"SELECT * FROM {matrix_sql(GAPPY_SQL, list(GAPPY), 'spearman', spearman_sql)}")
def spearman_masks(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in GAPPY.items()])
    return finish(sk.spearman_matrix(df, list(GAPPY)), r6=["r"])


@query("avg_rank", oracle=union_sql([
    f"SELECT '{c}' AS col, v AS value, count(*) AS count, any_value(k) AS avg_rank FROM (SELECT CAST({c} AS DOUBLE) AS v, "
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS k FROM lineitem) GROUP BY v"
    for c in ("l_quantity", "l_extendedprice")]))
def avg_rank(spark, sf):
    df = table(spark, sf, "lineitem")
    parts = [sk.avg_rank(df, c).withColumn("col", F.lit(c)) for c in ("l_quantity", "l_extendedprice")]
    return parts[0].unionByName(parts[1])


@query("pair_stats", oracle=union_sql([
    f"SELECT '{a}' AS x, '{b}' AS y, p.n, p.r AS pearson, s.r AS spearman FROM ({pearson_sql(rel, a, b)}) p, ({spearman_sql(rel, a, b)}) s"
    for rel, a, b in (("part", "p_size", "p_retailprice"), (MIXED_SQL, "taxed", "steps"))]))
def pair_stats(spark, sf):
    parts = [sk.pair_stats(df, a, b).select(F.lit(a).alias("x"), F.lit(b).alias("y"), "n", "pearson", "spearman")
             for df, a, b in ((table(spark, sf, "part"), "p_size", "p_retailprice"), (mixed(spark, sf), "taxed", "steps"))]
    return finish(parts[0].unionByName(parts[1]), r6=["pearson", "spearman"])


@query("random_subset_corr", oracle=f"""
WITH f AS (SELECT c, row_number() OVER (ORDER BY md5(concat('42:', c))) AS k FROM (VALUES {', '.join(f"('{c}')" for c in FEATURES)}) AS t(c)),
m AS (SELECT * FROM {matrix_sql('lineitem', FEATURES, 'spearman', spearman_sql)})
SELECT m.* FROM m WHERE feature_a IN (SELECT c FROM f WHERE k <= 4) AND feature_b IN (SELECT c FROM f WHERE k <= 4)""")
def random_subset_corr(spark, sf):
    return finish(sk.random_subset_corr(table(spark, sf, "lineitem"), FEATURES, "spearman", k=4, seed=42), r6=["r"])


@query("corr_network", oracle=f"""
WITH e AS (SELECT a, b, r FROM ({union_sql([pearson_sql(MIXED_SQL, a, b) for a, b in combinations(MIXED, 2)])}) WHERE abs(r) >= 0.7)
SELECT 'edge' AS part, a, b, r, CAST(0 AS BIGINT) AS degree FROM e
UNION ALL SELECT 'node', c, NULL, NULL, (SELECT count(*) FROM e WHERE a = c OR b = c) FROM (VALUES {', '.join(f"('{c}')" for c in MIXED)}) AS t(c)""")
def corr_network(spark, sf):
    features = list(MIXED)
    edges = sk.network_edges(sk.pearson_matrix(mixed(spark, sf), features), features)
    nodes = sk.network_nodes(edges, features).select(F.lit("node").alias("part"), F.col("feature").alias("a"), F.lit(None).cast("string").alias("b"),
                                                     F.lit(None).cast("double").alias("r"), "degree")
    edges = edges.withColumns({"part": F.lit("edge"), "degree": F.lit(0).cast("long")})
    return finish(edges.unionByName(nodes), r6=["r"])


@query("matrix_completion", oracle=f"""
WITH p AS ({union_sql([pearson_sql('(SELECT l_quantity, l_tax, CAST(l_linenumber AS DOUBLE) AS line_text, l_discount FROM lineitem)', a, b)
                       for a, b in combinations(['l_quantity', 'l_tax', 'line_text', 'l_discount'], 2)])})
SELECT a AS feature_a, b AS feature_b, r FROM p UNION ALL SELECT b, a, r FROM p
UNION ALL SELECT c, c, 1.0 FROM (VALUES ('l_quantity'), ('l_tax'), ('line_text'), ('l_discount')) AS t(c)""")
def matrix_completion(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_quantity", "l_tax", "CAST(l_linenumber AS STRING) AS line_text", "l_discount")
    known = sk.pearson_matrix(df, ["l_quantity", "l_tax", "l_discount"])
    out = sk.matrix_completion(df, known, ["l_quantity", "l_tax", "line_text", "l_discount"], overrides={"line_text": "numeric"})
    return finish(out, r6=["r"])
