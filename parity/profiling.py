"""Profiles and quality rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

import skimlark as sk
from parity.semantic import TYPE_SQL, UR, signals_sql
from parity.tools import GAPS, GAPS_SQL, TABLES, finish, gaps, query, sql_exact, sql_r6, sql_stat, table, union_sql

ISO6 = "'%Y-%m-%dT%H:%M:%S.%f'"


def moments_sql(rel: str, c: str, label: str | None = None) -> str:
    """The numeric profile of one column."""
    v = f"(CASE WHEN isfinite({c}) THEN CAST({c} AS DOUBLE) END)"
    return f"""SELECT '{label or c}' AS "column", count(CASE WHEN NOT isnan(c) THEN 1 END) AS count,
  count(*) - count(CASE WHEN NOT isnan(c) THEN 1 END) AS missing_count,
  {sql_exact('(count(*) - count(CASE WHEN NOT isnan(c) THEN 1 END)) / CAST(count(*) AS DOUBLE)')} AS missing_rate,
  count(v) AS finite_count, count(CASE WHEN c = 'Infinity'::DOUBLE THEN 1 END) AS positive_infinity_count,
  count(CASE WHEN c = '-Infinity'::DOUBLE THEN 1 END) AS negative_infinity_count,
  {sql_stat('avg(v)')} AS mean, {sql_exact('any_value(q2)')} AS median, min(v) AS min, max(v) AS max,
  {sql_stat('stddev_samp(v)')} AS std, {sql_stat('var_samp(v)')} AS variance, {sql_exact('any_value(q1)')} AS q1,
  {sql_exact('any_value(q3)')} AS q3, {sql_exact('any_value(q3) - any_value(q1)')} AS iqr,
  {sql_r6('skewness(v)')} AS skewness, {sql_r6('kurtosis(v)')} AS kurtosis, count(CASE WHEN v = 0 THEN 1 END) AS zero_count,
  {sql_exact('count(CASE WHEN v = 0 THEN 1 END) / CAST(count(v) AS DOUBLE)')} AS zero_rate,
  count(CASE WHEN q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) THEN 1 END) AS outlier_count,
  {sql_exact('count(CASE WHEN q3 > q1 AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) THEN 1 END) / CAST(count(v) AS DOUBLE)')} AS outlier_rate
FROM (SELECT CAST({c} AS DOUBLE) AS c, {v} AS v, q1, q2, q3 FROM {rel},
  (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3 FROM {rel}))"""


NUMERIC = {
    "lineitem": ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"],
    "customer": ["c_acctbal"], "events": ["value"]}
GAP_NUMBERS = ["v_has", "v_high", "v_crit", "v_inf", "v_island"]


def _profiled(df):
    return finish(df, stat=["mean", "std", "variance"], r6=["skewness", "kurtosis"],
                  exact=["missing_rate", "median", "q1", "q3", "iqr", "zero_rate", "outlier_rate"])


@query("numeric_profile", oracle=union_sql(
    [moments_sql(t, c) for t, cs in NUMERIC.items() for c in cs] + [moments_sql(GAPS_SQL, c) for c in GAP_NUMBERS]))
def numeric_profile(spark, sf):
    parts = [sk.numeric_profile(table(spark, sf, t), cs) for t, cs in NUMERIC.items()]
    parts.append(sk.numeric_profile(gaps(spark, sf), GAP_NUMBERS))
    return _profiled(reduce(lambda a, b: a.unionByName(b), parts))


def _order(c: str) -> str:
    """Most frequent first; ties by value, long strings by prefix and digest."""
    return f"count(*) DESC, substring({c}, 1, 40), CASE WHEN length({c}) > 40 THEN md5({c}) END NULLS FIRST"


def categorical_sql(rel: str, c: str, k: int = 10) -> str:
    return f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM {rel}) AS count, (SELECT count(*) - count({c}) FROM {rel}) AS missing_count,
  (SELECT count(DISTINCT {c}) FROM {rel}) AS unique_count,
  {sql_exact(f'(SELECT count(DISTINCT {c}) / CAST(count({c}) AS DOUBLE) FROM {rel})')} AS unique_ratio,
  first_value(val) OVER (ORDER BY r) AS top_value, first_value(n) OVER (ORDER BY r) AS top_count,
  r AS rank, val AS value, n, {sql_exact(f'n / CAST((SELECT count({c}) FROM {rel}) AS DOUBLE)')} AS share
FROM (SELECT CAST({c} AS VARCHAR) AS val, count(*) AS n, row_number() OVER (ORDER BY {_order(f'CAST({c} AS VARCHAR)')}) AS r
  FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= {k}"""


CATEGORICAL = {"orders": ["o_orderstatus", "o_orderpriority"], "part": ["p_brand", "p_type", "p_name"],
               "events": ["event_type", "props"], "documents": ["lang", "text"], "customer": ["c_name"]}


@query("categorical_profile", oracle=union_sql(
    [f"SELECT * FROM ({categorical_sql(t, c)})" for t, cs in CATEGORICAL.items() for c in cs]
    + [f"SELECT * FROM ({categorical_sql(GAPS_SQL, 'v_mixed')})"]))
def categorical_profile(spark, sf):
    parts = [sk.categorical_profile(table(spark, sf, t), cs) for t, cs in CATEGORICAL.items()]
    parts.append(sk.categorical_profile(gaps(spark, sf), ["v_mixed"]))
    all_rows = reduce(lambda a, b: a.unionByName(b), parts)
    out = all_rows.select(
        "column", "count", "missing_count", "unique_count", "unique_ratio", "top_value", "top_count",
        F.posexplode("top_values").alias("pos", "t")).select(
        "column", F.col("count"), "missing_count", "unique_count", "unique_ratio", "top_value", "top_count",
        (F.col("pos") + 1).cast("long").alias("rank"), "t.value", F.col("t.count").alias("n"), "t.share")
    return finish(out, exact=["unique_ratio", "share"])


def moments_of_time_sql(rel: str, c: str, order: str) -> str:
    """The datetime profile of one column; ``order`` is the row order."""
    return f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing_count,
  strftime(min({c}), {ISO6}) AS earliest, strftime(max({c}), {ISO6}) AS latest,
  CAST(epoch_us(max({c})) - epoch_us(min({c})) AS BIGINT) AS span_us, count({c}) - count(DISTINCT {c}) AS duplicate_timestamp_count,
  (SELECT coalesce(bool_and(p IS NULL OR p <= lo), true) FROM (SELECT lo, lag(hi) OVER (ORDER BY o) AS p FROM
     (SELECT {order} AS o, min({c}) AS lo, max({c}) AS hi FROM {rel} WHERE {c} IS NOT NULL GROUP BY {order}))) AS monotonic_increasing,
  (SELECT CAST(quantile_cont(gap, 0.5) AS DOUBLE) FROM (SELECT CAST(epoch_us({c}) - lag(epoch_us({c})) OVER (ORDER BY {c}) AS DOUBLE) AS gap
     FROM {rel} WHERE {c} IS NOT NULL)) AS median_interval_us
FROM {rel}"""


TIMED = [("events", "ts", "event_id"), ("orders", "o_orderdate", "o_orderkey"), ("lineitem", "l_shipdate", "l_orderkey")]
LATE_SQL = "(SELECT CASE WHEN event_type = 'view' THEN NULL ELSE date_trunc('hour', ts) END AS late_hour, ts FROM events)"


@query("datetime_profile", oracle=union_sql(
    [moments_of_time_sql(*t) for t in TIMED] + [moments_of_time_sql(LATE_SQL, "late_hour", "ts")]))
def datetime_profile(spark, sf):
    parts = [sk.datetime_profile(table(spark, sf, t), [c], order_by=[o]) for t, c, o in TIMED]
    late = table(spark, sf, "events").selectExpr(
        "CASE WHEN event_type = 'view' THEN NULL ELSE CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) END AS late_hour", "ts")
    parts.append(sk.datetime_profile(late, ["late_hour"], order_by=["ts"]))
    return reduce(lambda a, b: a.unionByName(b), parts).drop("missing_rate")


EMPTY_ROWS_SQL = """(SELECT CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS a,
  CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS b, CAST(NULL AS DOUBLE) AS c FROM lineitem)"""
WIDTHS = {"int": 8, "double": 8, "moment": 8}


def dataset_sql(rel: str, label: str, columns: list[tuple[str, str, int]]) -> str:
    """``columns``: name, kind, stored width."""
    missing = " + ".join(f"count(*) - count({c})" for c, _, _ in columns)
    rows_empty = " AND ".join(f"{c} IS NULL" for c, _, _ in columns)
    cols_empty = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c, _, _ in columns)
    size = " + ".join(f"coalesce(strlen({c}), 0)" if k == "string" else str(w) for c, k, w in columns)
    dup = f"(SELECT count(*) FROM (SELECT DISTINCT {', '.join(c for c, _, _ in columns)} FROM {rel}))"
    return f"""SELECT '{label}' AS rel, count(*) AS rows, CAST({len(columns)} AS BIGINT) AS columns, CAST({missing} AS BIGINT) AS missing_cells,
  {sql_exact(f'({missing}) / CAST(count(*) * {len(columns)} AS DOUBLE)')} AS missing_rate, count(*) - {dup} AS duplicate_rows,
  {sql_exact(f'(count(*) - {dup}) / CAST(count(*) AS DOUBLE)')} AS duplicate_rate,
  count(CASE WHEN {rows_empty} THEN 1 END) AS fully_empty_rows, CAST({cols_empty} AS BIGINT) AS fully_empty_columns,
  CAST(sum({size}) AS BIGINT) AS memory_bytes FROM {rel}"""


LINEITEM_WIDTHS = [(c, k, 4 if c == "l_linenumber" else 8) for c, k in TABLES["lineitem"]]


@query("dataset_profile", oracle=union_sql([
    dataset_sql("lineitem", "lineitem", LINEITEM_WIDTHS),
    dataset_sql(EMPTY_ROWS_SQL, "empty_rows", [("a", "double", 8), ("b", "double", 8), ("c", "double", 8)]),
    dataset_sql("documents", "documents", [("doc_id", "int", 8), ("text", "string", 0), ("lang", "string", 0),
                                           ("source", "string", 0), ("n_chars", "int", 8)])]))
def dataset_profile(spark, sf):
    li = table(spark, sf, "lineitem")
    empty = li.selectExpr("CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_quantity END AS a",
                          "CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_tax END AS b", "CAST(NULL AS DOUBLE) AS c")
    parts = [sk.dataset_profile(df).withColumn("rel", F.lit(t)) for t, df in (
        ("lineitem", li), ("empty_rows", empty), ("documents", table(spark, sf, "documents")))]
    return finish(reduce(lambda a, b: a.unionByName(b), parts), exact=["missing_rate", "duplicate_rate"])


@query("duplicate_rows", oracle=f"""
SELECT count(*) AS rows, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS distinct_rows,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS duplicate_rows,
  {sql_exact('(count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))) / CAST(count(*) AS DOUBLE)')} AS duplicate_rate
FROM events""")
def duplicate_rows(spark, sf):
    return finish(sk.duplicate_rows(table(spark, sf, "events").select("user_id", "event_type")), exact=["duplicate_rate"])


LINES = "l_returnflag, l_linestatus, l_quantity, l_discount, l_tax"


@query("duplicate_rows_proved", oracle=f"""
WITH d AS (SELECT count(*) AS n FROM (SELECT DISTINCT {LINES} FROM lineitem))
SELECT count(*) AS rows, any_value(d.n) AS distinct_rows, count(*) - any_value(d.n) AS duplicate_rows,
  {sql_exact('(count(*) - any_value(d.n)) / CAST(count(*) AS DOUBLE)')} AS duplicate_rate
FROM lineitem, d""")
def duplicate_rows_proved(spark, sf):
    lines = table(spark, sf, "lineitem").select(*LINES.split(", "))
    return finish(sk.duplicate_rows(lines, proof=True), exact=["duplicate_rate"])


# ---- quality ---------------------------------------------------------------

RATE = "((n - non_null) / CAST(n AS DOUBLE))"
LONG, MIXED = "(long_text_ratio >= 0.3)", "(numeric_ratio > 0.2 AND numeric_ratio < 0.8)"
ISLAND = "(missing_rate >= 0.7 AND non_null <= greatest(10, floor(0.05 * n)))"
STRAY = f"(non_null > 0 AND missing_rate >= 0.4 AND ({LONG} OR {MIXED} OR {ISLAND}))"
RAISED = [
    ("all_missing", "non_null = 0"), ("constant", "non_null > 0 AND u <= 1"),
    ("high_missing", "non_null > 0 AND missing_rate >= 0.4"),
    ("has_missing", "non_null > 0 AND missing_rate < 0.4 AND missing_rate > 0"),
    ("stray_content_candidate", f"t NOT IN ('datetime', 'text', 'unknown') AND {STRAY}"),
    ("high_cardinality", f"t IN ('categorical', 'text') AND {UR} >= 0.5 AND u > 30"),
    ("id_like", "t = 'id_like'"), ("infinity", "t = 'numeric' AND infinities > 0"),
    ("near_constant", "non_null > 0 AND missing_rate >= 0.995 AND t <> 'unknown' AND u <= 1")]
FLAG_LIST = "[x FOR x IN [" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for f, c in RAISED) + "] IF x IS NOT NULL]"
SEVERITY = """CASE WHEN flag IN ('all_missing', 'stray_content_candidate') OR (flag = 'high_missing' AND missing_rate >= 0.8) THEN 'critical'
  WHEN flag IN ('has_missing', 'id_like') THEN 'info' ELSE 'warning' END"""

QUALITY_RELS = [("gaps", GAPS_SQL, [(c, k) for c, k, _ in GAPS]), ("documents", "documents", TABLES["documents"]),
                ("customer", "customer", TABLES["customer"]), ("labels", "labels", TABLES["labels"])]
FACTS_SQL = f"""WITH sig AS ({union_sql([signals_sql(sql, cols, rel) for rel, sql, cols in QUALITY_RELS])}),
facts AS (SELECT *, {TYPE_SQL} AS t, {RATE} AS missing_rate FROM sig),
flagged AS (SELECT *, {FLAG_LIST} AS flags FROM facts),
each AS (SELECT rel, ordinal, col, missing_rate, unnest(flags) AS flag, unnest(range(len(flags))) AS position FROM flagged),
severe AS (SELECT *, {SEVERITY} AS severity FROM each),
worst AS (SELECT rel, col, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS w FROM severe GROUP BY ALL)
"""


def _facts(spark, sf):
    rels = {"gaps": gaps(spark, sf), **{t: table(spark, sf, t) for t in ("documents", "customer", "labels")}}
    return {name: sk.column_facts(df) for name, df in rels.items()}


def _each(spark, sf, f):
    return reduce(lambda a, b: a.unionByName(b), [
        f(facts).withColumn("rel", F.lit(name)) for name, facts in _facts(spark, sf).items()])


@query("missingness_table", oracle=f"""{FACTS_SQL}
SELECT rel, col AS "column", t AS semantic_type, n - non_null AS missing_count, {sql_exact('missing_rate')} AS missing_rate,
  array_to_string(flags, ',') AS flags FROM flagged WHERE n > non_null""")
def missingness_table(spark, sf):
    return finish(_each(spark, sf, sk.missingness_table), exact=["missing_rate"])


@query("stray_signals", oracle=f"""{FACTS_SQL}
SELECT rel, col AS "column", non_null, {sql_exact('missing_rate')} AS missing_rate, {sql_r6('long_text_ratio')} AS long_text_ratio,
  {sql_r6('numeric_ratio')} AS numeric_ratio, {LONG} AS long_text, {MIXED} AS mixed, {ISLAND} AS island, {STRAY} AS stray FROM facts""")
def stray_signals(spark, sf):
    return finish(_each(spark, sf, sk.stray_signals), exact=["missing_rate"], r6=["long_text_ratio", "numeric_ratio"])


@query("quality_flags", oracle=f"""{FACTS_SQL}
SELECT rel, col AS "column", CAST(position AS BIGINT) AS position, flag, severity FROM severe""")
def quality_flags(spark, sf):
    return _each(spark, sf, sk.quality_flags).select(
        "rel", "column", F.col("position").cast("long").alias("position"), "flag", "severity")


@query("quality_summary", oracle=f"""{FACTS_SQL}
SELECT f.rel, count(CASE WHEN severity = 'critical' THEN 1 END) AS critical, count(CASE WHEN severity = 'warning' THEN 1 END) AS warning,
  count(CASE WHEN severity = 'info' THEN 1 END) AS info, count(severity) AS total_flags,
  count(DISTINCT CASE WHEN len(flags) = 0 THEN f.col END) AS clean_columns
FROM flagged f LEFT JOIN severe s ON f.rel = s.rel AND f.col = s.col GROUP BY f.rel""")
def quality_summary(spark, sf):
    return _each(spark, sf, sk.quality_summary)


BAD = "(coalesce(w, 0) = 3 OR t = 'constant' OR list_contains(flags, 'near_constant'))"


@query("usable_columns", oracle=f"""{FACTS_SQL}
SELECT f.rel, f.col AS "column", t AS semantic_type, NOT {BAD} AS usable,
  CASE WHEN {BAD} THEN CASE WHEN len(flags) > 0 THEN array_to_string(flags, ',') ELSE 'constant' END END AS reasons
FROM flagged f LEFT JOIN worst w ON f.rel = w.rel AND f.col = w.col""")
def usable_columns(spark, sf):
    return _each(spark, sf, sk.usable_columns).drop("ordinal")


def _num_line(rel, c):
    v = f"(CASE WHEN isfinite({c}) THEN CAST({c} AS DOUBLE) END)"
    return f"""SELECT '{c}' AS col, printf('mean %.2f, median %.2f, std %.2f, IQR outliers %d', avg({v}), any_value(q2), stddev_samp({v}),
  count(CASE WHEN q3 > q1 AND ({v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1)) THEN 1 END)) AS line
FROM {rel}, (SELECT quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS q2, quantile_cont({v}, 0.75) AS q3 FROM {rel})"""


def _cat_line(rel, c):
    return f"""SELECT '{c}' AS col, printf('unique %d, top "%s" (%d)', (SELECT count(DISTINCT {c}) FROM {rel}), val, n) AS line FROM
  (SELECT CAST({c} AS VARCHAR) AS val, count(*) AS n FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c}
   ORDER BY {_order(f'CAST({c} AS VARCHAR)')} LIMIT 1)"""


EVENT_LINES = union_sql([
    _cat_line("events", "event_id"), _num_line("events", "user_id"), _num_line("events", "value"), _cat_line("events", "event_type"),
    _cat_line("events", "props"), f"SELECT 'ts' AS col, strftime(min(ts), {ISO6}) || ' → ' || strftime(max(ts), {ISO6}) AS line FROM events"])


@query("column_health", oracle=f"""WITH sig AS ({signals_sql('events', TABLES['events'], 'events')}),
facts AS (SELECT *, {TYPE_SQL} AS t, {RATE} AS missing_rate FROM sig), flagged AS (SELECT *, {FLAG_LIST} AS flags FROM facts),
each AS (SELECT rel, ordinal, col, missing_rate, unnest(flags) AS flag FROM flagged), severe AS (SELECT *, {SEVERITY} AS severity FROM each),
worst AS (SELECT col, max(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END) AS w FROM severe GROUP BY ALL)
SELECT f.col AS "column", t AS effective_type, CASE coalesce(w, 0) WHEN 3 THEN 'critical' WHEN 2 THEN 'warning' WHEN 1 THEN 'info' ELSE 'clean' END AS severity,
  array_to_string(flags, ',') AS flags, line
FROM flagged f LEFT JOIN worst w ON f.col = w.col LEFT JOIN ({EVENT_LINES}) l ON f.col = l.col
WHERE len(flags) > 0 OR t IN ('categorical', 'boolean')""")
def column_health(spark, sf):
    df = table(spark, sf, "events")
    facts = sk.column_facts(df)
    return sk.column_health(
        facts, sk.numeric_profile(df, ["user_id", "value"]), sk.categorical_profile(df, ["event_id", "event_type", "props"]),
        sk.datetime_profile(df, ["ts"])).drop("ordinal")
