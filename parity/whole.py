"""Whole-table analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

import skimlark as sk
from parity.profiling import FACTS_SQL, moments_sql
from parity.semantic import TYPE_SQL, signals_sql
from parity.tools import GAPS, GAPS_SQL, TABLES, finish, gaps, query, table, union_sql

FIELDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("field_statistics", oracle=f"""
SELECT "column", mean, median, std, min, max, q1, q3, iqr, skewness, outlier_count FROM ({union_sql([moments_sql('lineitem', c) for c in FIELDS])})""")
def field_statistics(spark, sf):
    df = table(spark, sf, "lineitem")
    numeric = [c for c, t in sk.type_map(df).items() if t == "numeric"]
    return finish(sk.field_statistics(df, numeric), stat=["mean", "std"], r6=["skewness"], exact=["median", "q1", "q3", "iqr"])


GAP_TABLE = "(SELECT l_orderkey, l_linenumber, " + GAPS_SQL[len("(SELECT "):]
GAP_COLUMNS = [("l_orderkey", "int"), ("l_linenumber", "int")] + [(c, k) for c, k, _ in GAPS]
MISSING = " + ".join(f"count(*) - count({c})" for c, _ in GAP_COLUMNS)
DISTINCT = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(c for c, _ in GAP_COLUMNS)} FROM {GAP_TABLE}))"
ANALYZE_FACTS = FACTS_SQL[:FACTS_SQL.index("WITH sig AS (")] + f"WITH sig AS ({signals_sql(GAP_TABLE, GAP_COLUMNS, 'gaps')}),\nfacts AS" \
    + FACTS_SQL.split("\nfacts AS", 1)[1]


@query("analyze", oracle=f"""{ANALYZE_FACTS},
size AS (SELECT count(*) AS rows, CAST({MISSING} AS DOUBLE) / (count(*) * {len(GAP_COLUMNS)}) AS missing_rate,
  (count(*) - {DISTINCT}) / CAST(count(*) AS DOUBLE) AS duplicate_rate FROM {GAP_TABLE}),
crit AS (SELECT count(*) AS critical FROM severe WHERE severity = 'critical')
SELECT 'type' AS section, col AS item, t AS value FROM facts
UNION ALL SELECT 'flag', concat(col, '/', CAST(position AS VARCHAR)), concat(flag, '/', severity) FROM severe
UNION ALL SELECT 'usable', f.col, CAST(ordinal AS VARCHAR) FROM flagged f LEFT JOIN worst w ON f.col = w.col
  WHERE NOT (coalesce(w, 0) = 3 OR t = 'constant' OR list_contains(flags, 'near_constant'))
UNION ALL SELECT 'pair', 'l_orderkey', 'l_linenumber'
UNION ALL SELECT 'warning', 'large_dataset', 'yes' FROM size WHERE rows >= 200000
UNION ALL SELECT 'warning', 'critical_quality_flags', 'yes' FROM crit WHERE critical > 0
UNION ALL SELECT 'finding', 'Fact', printf('The table has %d rows and {len(GAP_COLUMNS)} columns.', rows) FROM size
UNION ALL SELECT 'finding', 'Fact', printf('Missing cells: %.2f%%; repeated rows: %.2f%%.', missing_rate * 100, duplicate_rate * 100) FROM size
UNION ALL SELECT 'finding', 'Attention', printf('%d critical quality flags need a look.', critical) FROM crit WHERE critical > 0
UNION ALL SELECT 'finding', 'Limitation', 'Size or readability limits were applied.' FROM size, crit WHERE rows >= 200000 OR critical > 0
UNION ALL SELECT 'finding', 'Limitation', 'A correlation says nothing about cause.'
UNION ALL SELECT 'finding', 'Limitation', 'Values beyond the IQR fences are candidates, not proven errors.'
UNION ALL SELECT 'finding', 'Limitation', 'No units or domain ranges were assumed.'""")
def analyze(spark, sf):
    both = [f"{e.format(S='STRING')} AS {c}" for c, _, e in GAPS]
    a = sk.analyze(table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", *both))
    text = lambda t, section, item, value: a[t].select(
        F.lit(section).alias("section"), F.expr(item).alias("item"), F.expr(value).alias("value"))
    parts = [
        text("schema", "type", "column", "semantic_type"),
        text("quality_flags", "flag", "concat(column, '/', string(position))", "concat(flag, '/', severity)"),
        text("usable_columns", "usable", "column", "string(ordinal)").where("item IN ({})".format(
            ", ".join(f"'{c}'" for c in a.usable))),
        spark.range(1).select(F.lit("pair").alias("section"), F.lit(a.default_pair[0]).alias("item"), F.lit(a.default_pair[1]).alias("value")),
        text("warnings", "warning", "code", "'yes'"),
        text("findings", "finding", "level", "text"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["TABLES", "TYPE_SQL", "gaps"]
