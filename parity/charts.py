"""Sampling and the numbers behind charts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

import skimlark as sk
from parity.tools import finish, query, sql_exact, sql_r6, sql_stat, table, union_sql
from skimlark.functions.exprs import (
    NORMAL_CENTRE_BOTTOM, NORMAL_CENTRE_TOP, NORMAL_TAIL_BOTTOM, NORMAL_TAIL_LIMIT, NORMAL_TAIL_TOP)

ISO6 = "'%Y-%m-%dT%H:%M:%S.%f'"
ISO0 = "'%Y-%m-%dT%H:%M:%S'"


@query("sample_rows", oracle="""
SELECT event_id, user_id, event_type, value FROM events ORDER BY md5(concat('42:', CAST(event_id AS VARCHAR))) LIMIT 1000""")
def sample_rows(spark, sf):
    rows = sk.sample_rows(table(spark, sf, "events"), 1000, seed=42, key=["event_id"])
    return rows.select("event_id", "user_id", "event_type", "value")


# a sample of a third of the rows: more than a chart's size
@query("sample_rows_large", oracle="""
WITH n AS (SELECT count(*) // 3 AS n FROM lineitem), ranked AS (SELECT *, row_number() OVER (ORDER BY
  md5(concat('7:', CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR), ':', CAST(l_partkey AS VARCHAR), ':', CAST(l_suppkey AS VARCHAR)))) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ranked, n WHERE k <= n""")
def sample_rows_large(spark, sf):
    df = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return sk.sample_rows(df, df.count() // 3, seed=7, key=keys).select(keys)


LINE_WIDTH = 400


@query("series_points", oracle=f"""
WITH p AS (SELECT epoch_us(ts) AS t, value FROM events WHERE isfinite(value)), s AS (SELECT min(t) AS lo, max(t) AS hi FROM p),
c AS (SELECT t, value, least(floor((t - lo)::DOUBLE * {LINE_WIDTH} / (hi - lo)::DOUBLE)::BIGINT, {LINE_WIDTH - 1}) AS px FROM p, s),
e AS (SELECT t, value, row_number() OVER (PARTITION BY px ORDER BY t, value) AS a, row_number() OVER (PARTITION BY px ORDER BY t DESC, value DESC) AS b,
  row_number() OVER (PARTITION BY px ORDER BY value, t) AS d, row_number() OVER (PARTITION BY px ORDER BY value DESC, t DESC) AS u FROM c)
SELECT DISTINCT strftime(make_timestamp(t), {ISO6}) AS t, value FROM e WHERE a = 1 OR b = 1 OR d = 1 OR u = 1""")
def series_points(spark, sf):
    return sk.time_series(table(spark, sf, "events"), "ts", "value", points=LINE_WIDTH)


@query("aligned_series", oracle=f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, {ISO6}) AS ts, CAST(user_id AS DOUBLE) AS user_id, event_type, value, props,
  strftime(ts, {ISO6}) AS x_axis FROM events""")
def aligned_series(spark, sf):
    df = table(spark, sf, "events")
    return sk.aligned_series(df, sk.type_map(df))


def counts_sql(rel: str, c: str, k: int = 10, having: str = "") -> str:
    return f"""SELECT '{c}' AS "column", r AS rank, val AS value, n AS count FROM
  (SELECT CAST({c} AS VARCHAR) AS val, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS r
   FROM {rel} WHERE {c} IS NOT NULL GROUP BY {c}) WHERE r <= {k} {having}"""


@query("category_counts", oracle=union_sql([counts_sql("orders", c) for c in ("o_orderpriority", "o_orderstatus")]
                                           + [counts_sql("events", c) for c in ("props", "user_id")]))
def category_counts(spark, sf):
    out = sk.category_counts(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]).unionByName(
        sk.category_counts(table(spark, sf, "events"), ["props", "user_id"]))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("full_counts", oracle=union_sql([
    counts_sql("part", c, having=f"AND (SELECT count(DISTINCT {c}) FROM part) <= 50") for c in ("p_brand", "p_size", "p_name", "p_partkey")]))
def full_counts(spark, sf):
    out = sk.full_counts(table(spark, sf, "part"), ["p_brand", "p_size", "p_name", "p_partkey"])
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("top5_with_other", oracle=f"""
WITH c AS (SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_brand),
s AS (SELECT least(r, 6) AS rank, CASE WHEN r <= 5 THEN value ELSE 'Other' END AS value, sum(n) AS n FROM c GROUP BY ALL)
SELECT rank, value, CAST(n AS BIGINT) AS count, {sql_exact('n / CAST((SELECT count(*) FROM part) AS DOUBLE)')} AS share FROM s""")
def top5_with_other(spark, sf):
    out = sk.top5_with_other(table(spark, sf, "part"), "p_brand").withColumn("rank", F.col("rank").cast("long"))
    return finish(out, exact=["share"])


def histogram_sql(rel: str, c: str) -> str:
    return f"""(WITH s AS (SELECT count({c}) AS n, min({c}) AS lo, max({c}) AS hi, greatest(5, least(40, floor(sqrt(count({c})) + 0.5))) AS k FROM {rel}),
w AS (SELECT lo, k, (hi - lo) / k AS width FROM s),
b AS (SELECT least(CAST(floor(({c} - lo) / width) AS BIGINT), CAST(k AS BIGINT) - 1) AS bin, count(*) AS n FROM {rel}, w GROUP BY 1),
g AS (SELECT unnest(range(CAST(k AS BIGINT))) AS bin, lo, width FROM w)
SELECT '{c}' AS col, g.bin, {sql_exact('lo + g.bin * width')} AS x0, {sql_exact('lo + (g.bin + 1) * width')} AS x1, coalesce(n, 0) AS count
FROM g LEFT JOIN b ON g.bin = b.bin)"""


HISTOGRAMS = [("customer", "c_acctbal"), ("lineitem", "l_extendedprice"), ("events", "value")]


@query("histogram", oracle=union_sql([f"SELECT * FROM {histogram_sql(t, c)}" for t, c in HISTOGRAMS]))
def histogram(spark, sf):
    parts = [sk.histogram(table(spark, sf, t), c).withColumn("col", F.lit(c)) for t, c in HISTOGRAMS]
    return finish(reduce(lambda a, b: a.unionByName(b), parts), exact=["x0", "x1"])


@query("kde", oracle=f"""
WITH s AS (SELECT CAST(count(v) AS DOUBLE) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd,
    quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM (SELECT p_retailprice AS v FROM part)),
b AS (SELECT *, 1.06 * least(sd, iqr / 1.34) * pow(n, -0.2) AS h, (hi - lo) / 120 AS step FROM s),
c AS (SELECT p_retailprice AS v, count(*) AS c FROM part GROUP BY 1)
SELECT CAST(i AS INTEGER) AS point, {sql_exact('any_value(lo + i * step)')} AS x,
  {sql_stat('sum(c * exp(-0.5 * pow((lo + i * step - v) / h, 2))) / any_value(n * h * sqrt(2 * pi()))')} AS density
FROM b, c, range(121) AS g(i) GROUP BY i""")
def kde(spark, sf):
    return finish(sk.kde(table(spark, sf, "part"), "p_retailprice"), exact=["x"], stat=["density"])


def box_sql(rel: str, value: str, by: str, labels: str, having: str = "", where: str = "TRUE") -> str:
    """Box figures of ``value`` per group."""
    comma = f"{by}, " if by else ""
    select = f"{labels}, " if labels else ""
    on = " AND ".join(f"r.{b.strip()} = q.{b.strip()}" for b in by.split(",")) if by else "TRUE"
    group = f"GROUP BY {by}" if by else ""
    names = ", ".join(f"q.{b.strip()}" for b in by.split(",")) if by else ""
    outer = f"GROUP BY {names}" if by else ""
    first = f"{names}, " if by else ""
    return f"""SELECT {select}n, min, q1, median, q3, max, {sql_exact('q3 - q1')} AS iqr, {sql_exact('q1 - 1.5 * (q3 - q1)')} AS lower,
  {sql_exact('q3 + 1.5 * (q3 - q1)')} AS upper, outliers FROM (
SELECT {first}any_value(q.n) AS n, any_value(q.lo) AS min, {sql_exact('any_value(q.q1)')} AS q1, {sql_exact('any_value(q.q2)')} AS median,
  {sql_exact('any_value(q.q3)')} AS q3, any_value(q.hi) AS max,
  count(CASE WHEN r.{value} < q.q1 - 1.5 * (q.q3 - q.q1) OR r.{value} > q.q3 + 1.5 * (q.q3 - q.q1) THEN 1 END) AS outliers
FROM {rel} r JOIN (SELECT {comma}count({value}) AS n, min({value}) AS lo, max({value}) AS hi, quantile_cont({value}, 0.25) AS q1,
  quantile_cont({value}, 0.5) AS q2, quantile_cont({value}, 0.75) AS q3 FROM {rel} WHERE {where} {group} {having}) q ON {on} {outer})"""


BOX = ["min", "q1", "median", "q3", "max"]
EXACT_BOX = ["q1", "median", "q3", "iqr", "lower", "upper"]
BOXED = ["l_extendedprice", "l_quantity", "l_discount"]


@query("box_stats", oracle=union_sql(
    [box_sql("lineitem", c, "", f"'{c}' AS \"column\"") for c in BOXED] + [box_sql("events", "value", "", "'value' AS \"column\"")]))
def box_stats(spark, sf):
    out = sk.box_stats(table(spark, sf, "lineitem"), BOXED).unionByName(sk.box_stats(table(spark, sf, "events"), ["value"]))
    return finish(out, exact=EXACT_BOX)


@query("outlier_rows", oracle=f"""
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value, {sql_exact('q1 - 1.5 * (q3 - q1)')} AS lower, {sql_exact('q3 + 1.5 * (q3 - q1)')} AS upper
FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def outlier_rows(spark, sf):
    out = sk.outlier_rows(table(spark, sf, "events"), "value").select("event_id", "value", "lower", "upper")
    return finish(out, exact=["lower", "upper"])


@query("group_box", oracle=f"""
WITH top AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 12)
{box_sql('part', 'p_retailprice', 'p_brand', 'p_brand AS category', 'HAVING count(p_retailprice) >= 3', 'p_brand IN (SELECT p_brand FROM top)')}""")
def group_box(spark, sf):
    return finish(sk.group_box(table(spark, sf, "part"), "p_retailprice", "p_brand"), exact=EXACT_BOX)


@query("grouped_box", oracle=box_sql(
    "lineitem", "l_extendedprice", "l_returnflag, l_linestatus", "l_returnflag AS x, l_linestatus AS colour", "HAVING count(*) >= 3"))
def grouped_box(spark, sf):
    return finish(sk.grouped_box(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag", "l_linestatus"), exact=EXACT_BOX)


@query("facet_box", oracle=box_sql(
    "(SELECT p_brand, CAST(p_size AS VARCHAR) AS size_text, p_retailprice FROM part)", "p_retailprice", "p_brand, size_text",
    "p_brand AS x, size_text AS colour", "HAVING count(*) >= 3",
    "p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 9)"))
def facet_box(spark, sf):
    return finish(sk.facet_box(table(spark, sf, "part"), "p_retailprice", "p_brand", "p_size"), exact=EXACT_BOX)


@query("group_mean", oracle=f"""
SELECT o_orderpriority AS category, count(*) AS n, {sql_stat('avg(o_totalprice)')} AS mean, {sql_stat('coalesce(stddev_samp(o_totalprice), 0)')} AS std,
  {sql_stat('avg(o_totalprice) - coalesce(stddev_samp(o_totalprice), 0)')} AS low,
  {sql_stat('avg(o_totalprice) + coalesce(stddev_samp(o_totalprice), 0)')} AS high FROM orders GROUP BY 1""")
def group_mean(spark, sf):
    return finish(sk.group_mean(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), stat=["mean", "std", "low", "high"])


@query("contingency", oracle="""
WITH a AS (SELECT DISTINCT p_brand AS a FROM part ORDER BY 1 LIMIT 30),
b AS (SELECT DISTINCT CAST(p_size AS VARCHAR) AS b FROM part ORDER BY 1 LIMIT 30),
c AS (SELECT p_brand AS a, CAST(p_size AS VARCHAR) AS b, count(*) AS n FROM part GROUP BY ALL)
SELECT a.a, b.b, coalesce(n, 0) AS count FROM a CROSS JOIN b LEFT JOIN c ON a.a = c.a AND b.b = c.b""")
def contingency(spark, sf):
    return sk.contingency(table(spark, sf, "part"), "p_brand", "p_size")


@query("facet_contingency", oracle="""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS colour FROM lineitem),
f AS (SELECT colour FROM c GROUP BY colour HAVING count(*) >= 2 AND colour IN (SELECT DISTINCT colour FROM c ORDER BY 1 LIMIT 9)),
a AS (SELECT DISTINCT colour, a FROM c), b AS (SELECT DISTINCT colour, b FROM c),
n AS (SELECT colour, a, b, count(*) AS n FROM c GROUP BY ALL)
SELECT f.colour, a.a, b.b, coalesce(n, 0) AS count FROM f JOIN a ON f.colour = a.colour JOIN b ON f.colour = b.colour
LEFT JOIN n ON n.colour = f.colour AND n.a = a.a AND n.b = b.b""")
def facet_contingency(spark, sf):
    return sk.facet_contingency(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")


@query("stacked_bar", oracle="""
WITH c AS (SELECT p_brand AS a, p_type AS b, CAST(p_size AS VARCHAR) AS colour, count(*) AS n FROM part
  WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 8) AND p_type IN (SELECT DISTINCT p_type FROM part ORDER BY 1 LIMIT 6)
  AND CAST(p_size AS VARCHAR) IN (SELECT DISTINCT CAST(p_size AS VARCHAR) FROM part ORDER BY 1 LIMIT 4) GROUP BY ALL)
SELECT a, colour, b, n AS count, CAST(sum(n) OVER (PARTITION BY a, colour) AS BIGINT) AS total,
  CAST(sum(n) OVER (PARTITION BY a, colour ORDER BY b) - n AS BIGINT) AS start, CAST(sum(n) OVER (PARTITION BY a, colour ORDER BY b) AS BIGINT) AS "end" FROM c""")
def stacked_bar(spark, sf):
    return sk.stacked_bar(table(spark, sf, "part"), "p_brand", "p_type", "p_size")


@query("scatter", oracle="""
SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_brand AS colour FROM part""")
def scatter(spark, sf):
    return sk.scatter(table(spark, sf, "part"), "p_size", "p_retailprice", colour="p_brand")


@query("time_series", oracle=f"SELECT strftime(ts, {ISO6}) AS t, value FROM events")
def time_series(spark, sf):
    return sk.time_series(table(spark, sf, "events"), "ts", "value")


@query("line_series", oracle=f"""
SELECT row_number() OVER (ORDER BY event_id) - 1 AS row, strftime(ts, {ISO6}) AS x, value FROM events""")
def line_series(spark, sf):
    return sk.line_series(table(spark, sf, "events"), "value", order_by=["event_id"], time="ts")


def _poly(cs, x):
    return reduce(lambda acc, c: f"({acc} * {x} + ({c!r}))", cs[1:], f"({cs[0]!r})")


def normal_sql(p: str) -> str:
    tail = f"sqrt(-2.0 * ln(least({p}, 1.0 - {p})))"
    tv = f"{_poly(NORMAL_TAIL_TOP, tail)} / {_poly(NORMAL_TAIL_BOTTOM, tail)}"
    mid = f"({p} - 0.5)"
    sq = f"({mid} * {mid})"
    return (f"(CASE WHEN {p} < {NORMAL_TAIL_LIMIT} THEN {tv} WHEN {p} > {1 - NORMAL_TAIL_LIMIT!r} THEN -({tv}) "
            f"ELSE {_poly(NORMAL_CENTRE_TOP, sq)} * {mid} / {_poly(NORMAL_CENTRE_BOTTOM, sq)} END)")


def qq_sql(rel: str, c: str) -> str:
    z1, z3 = normal_sql("0.25::DOUBLE"), normal_sql("0.75::DOUBLE")
    return f"""(WITH o AS (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, CAST(count(*) OVER () AS DOUBLE) AS n FROM {rel}),
q AS (SELECT max(CASE WHEN i = floor((n - 1) * 0.25 + 0.5) THEN v END) AS q1, max(CASE WHEN i = floor((n - 1) * 0.75 + 0.5) THEN v END) AS q3 FROM o),
p AS (SELECT o.*, {normal_sql('((i + 0.5::DOUBLE) / n)')} AS z FROM o)
SELECT '{c}' AS col, i, {sql_stat('z')} AS z, v AS value, {sql_stat(f'q1 + (q3 - q1) * (z - {z1}) / ({z3} - {z1})')} AS line
FROM p, q WHERE i % greatest(1, CAST(floor(n / 4000) AS BIGINT)) = 0)"""


QQ = [("customer", "c_acctbal"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice")]


@query("qq_points", oracle=union_sql([f"SELECT * FROM {qq_sql(t, c)}" for t, c in QQ]))
def qq_points(spark, sf):
    parts = [sk.qq_points(table(spark, sf, t), c).withColumn("col", F.lit(c)) for t, c in QQ]
    return finish(reduce(lambda a, b: a.unionByName(b), parts), stat=["z", "line"])


def acf_sql(rel: str, c: str, order: str, label: str) -> str:
    lags = (0, 2, 4, 6, 8)
    ahead = ", ".join(f"lead(d, {k}) OVER (ORDER BY {order}, {c}) AS d{k}" for k in lags)
    parts = union_sql([
        f"SELECT '{label}' AS label, {k} AS lag, {sql_r6(f'sum(d * d{k}) / sum(d * d)')} AS acf, {sql_r6('1.96 / sqrt(count(*))')} AS band, "
        "count(*) AS n FROM l" for k in lags])
    return f"""(WITH l AS (SELECT d, {ahead} FROM (SELECT {order}, {c}, {c} - avg({c}) OVER () AS d FROM {rel})) {parts})"""


ACFS = [("events", "value", "ts", "by_time"), ("events", "value", "event_type", "tied"), ("lineitem", "l_quantity", "l_returnflag", "runs")]


@query("acf", oracle=union_sql([f"SELECT * FROM {acf_sql(*a)}" for a in ACFS]))
def acf(spark, sf):
    parts = [sk.acf(table(spark, sf, t), c, order_by=[o]).withColumn("label", F.lit(label)) for t, c, o, label in ACFS]
    return finish(reduce(lambda a, b: a.unionByName(b), parts), r6=["acf", "band"])


RELATED = [("o_totalprice", "o_orderpriority"), ("o_orderstatus", "o_orderpriority"), ("o_orderdate", "o_totalprice"),
           ("o_custkey", "o_totalprice"), ("o_orderdate", "o_orderstatus")]


@query("relationship", oracle=f"""
SELECT 'group_box' AS chart, o_orderpriority AS k1, NULL AS k2, {sql_exact('quantile_cont(o_totalprice, 0.5)')} AS v FROM orders GROUP BY 2
UNION ALL SELECT 'contingency', o_orderstatus, o_orderpriority, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2, 3
UNION ALL SELECT 'time_series', strftime(o_orderdate, {ISO6}), NULL, o_totalprice FROM orders
UNION ALL SELECT 'scatter', CAST(o_custkey AS VARCHAR), NULL, o_totalprice FROM orders
UNION ALL SELECT 'unsupported', NULL, NULL, NULL""")
def relationship(spark, sf):
    df = table(spark, sf, "orders")
    types = sk.type_map(df)
    shown = {"group_box": ("category", "NULL", "median"), "contingency": ("a", "b", "double(count)"),
             "time_series": ("t", "NULL", "value"), "scatter": ("string(bigint(x))", "NULL", "y")}
    parts = []
    for a, b in RELATED:
        kind, rows = sk.relationship(df, a, b, types)
        if rows is None:
            rows = spark.range(1).selectExpr("string(NULL) AS k1", "string(NULL) AS k2", "double(NULL) AS v")
        else:
            k1, k2, v = shown[kind]
            rows = rows.selectExpr(f"string({k1}) AS k1", f"string({k2}) AS k2", f"{v} AS v")
        parts.append(rows.withColumn("chart", F.lit(kind)))
    return finish(reduce(lambda a, b: a.unionByName(b), parts), exact=["v"])


@query("category_over_time", oracle=f"""
SELECT strftime(date_trunc('day', ts), {ISO0}) AS bucket, event_type AS category, count(*) AS count FROM events GROUP BY ALL""")
def category_over_time(spark, sf):
    return sk.category_over_time(table(spark, sf, "events"), "ts", "event_type", unit="day")


@query("time_coverage", oracle=f"""
SELECT strftime(date_trunc('month', o_orderdate), {ISO0}) AS bucket, count(*) AS count FROM orders GROUP BY ALL""")
def time_coverage(spark, sf):
    return sk.time_coverage(table(spark, sf, "orders"), "o_orderdate", unit="month")
