"""Types and conversions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

import skimlark as sk
from parity.tools import TABLES, finish, query, sql_exact, sql_r6, table, union_sql

#: Spellings and patterns that the results depend on.
WS = r"' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INFINITE = "('inf','+inf','-inf','infinity','+infinity','-infinity')"
BOOLS = "('true','false','yes','no','y','n','0','1','是','否')"
ID_NAME = r"(^|[_\s-])(id|uuid|guid|serial|code|编号|序号|编码)($|[_\s-])"
DATE_NAME = "date|time|timestamp|datetime|日期|时间"


def strip_sql(c: str) -> str:
    return f"trim(CAST({c} AS VARCHAR), {WS})"


def number_sql(c: str) -> str:
    t = f"replace({strip_sql(c)}, ',', '')"
    return f"(CASE WHEN regexp_matches({t}, '{NUMBER}') OR lower({t}) IN {INFINITE} THEN TRY_CAST({t} AS DOUBLE) END)"


def date_share_sql(c: str) -> str:
    """Best single-format share, over the day formats text columns of these tables could hold."""
    t = strip_sql(c)
    shapes = [(r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "%Y/%m/%d"),
              (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "%Y-%m-%d %H:%M:%S"),
              (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"),
              (r"^\d{1,2}:\d{2}$", "%H:%M")]
    hits = [f"count(CASE WHEN regexp_matches({t}, '{p}') THEN try_strptime({t}, '{f}') END)" for p, f in shapes]
    return f"greatest({', '.join(hits)})"


def signals_sql(rel: str, columns: list[tuple[str, str]], label: str | None = None) -> str:
    """One SELECT per column: the same signals, written for the other engine."""
    parts = []
    for i, (c, kind) in enumerate(columns):
        there = f"count({c})"
        v = f"(CASE WHEN isnan({c}) THEN NULL ELSE {c} END)" if kind == "double" else c
        there = f"count({v})"
        facts = {
            "n": "count(*)", "non_null": there, "u": f"count(DISTINCT {v})", "bool_like": "false", "zero_padded_ratio": "0.0",
            "numeric_ratio": "0.0", "dt_ratio": "0.0", "avg_len": "0.0", "long_text_ratio": "0.0", "infinities": "0"}
        if kind == "nested":
            facts["u"] = "0"
        elif kind in ("int", "double"):
            facts["numeric_ratio"] = f"CASE WHEN {there} > 0 THEN 1.0 ELSE 0.0 END"
            if kind == "int":
                facts["bool_like"] = f"coalesce(bool_and({c} IN (0, 1)), false)"
            else:
                facts["infinities"] = f"count(CASE WHEN isinf({c}) THEN 1 END)"
        elif kind == "moment":
            facts["dt_ratio"] = f"CASE WHEN {there} > 0 THEN 1.0 ELSE 0.0 END"
        else:
            t = strip_sql(c)

            def share(cond):
                return f"coalesce(avg(CASE WHEN {c} IS NULL THEN NULL WHEN {cond} THEN 1.0 ELSE 0.0 END), 0.0)"
            facts.update(
                bool_like=f"coalesce(bool_and(lower({t}) IN {BOOLS}), false)",
                zero_padded_ratio=share(rf"regexp_matches({t}, '^0\d+$')"),
                numeric_ratio=share(f"{number_sql(c)} IS NOT NULL"),
                dt_ratio=f"CASE WHEN {there} > 0 THEN CAST({date_share_sql(c)} AS DOUBLE) / {there} ELSE 0.0 END",
                avg_len=f"coalesce(avg(length({t})), 0.0)", long_text_ratio=share(f"length({t}) > 20"),
                infinities=f"count(CASE WHEN lower(replace({t}, ',', '')) IN {INFINITE} THEN 1 END)")
        physical = "number" if kind in ("int", "double") else kind
        rel_label = f"'{label}' AS rel, " if label else ""
        parts.append(
            f"SELECT {rel_label}{i} AS ordinal, '{c}' AS col, '{physical}' AS kind, "
            f"regexp_matches(lower('{c}'), '{ID_NAME}') AS id_hint, regexp_matches(lower('{c}'), '{DATE_NAME}') AS date_hint, "
            + ", ".join(f"{e} AS {k}" for k, e in facts.items()) + f" FROM {rel}")
    return union_sql(parts)


UR = "(CASE WHEN non_null > 0 THEN CAST(u AS DOUBLE) / non_null ELSE 0.0 END)"
UNIQUE_ID = f"(id_hint AND {UR} >= 0.9)"
CASCADE = [
    ("non_null = 0", "unknown", "1.0"), ("kind = 'nested'", "unknown", "1.0"), ("u <= 1", "constant", "1.0"),
    ("bool_like", "boolean", "0.98"), (f"kind = 'number' AND {UNIQUE_ID}", "id_like", "0.90"),
    ("kind = 'number'", "numeric", "0.99"),
    ("kind = 'string' AND numeric_ratio >= 0.95 AND zero_padded_ratio < 0.2 AND NOT id_hint", "numeric", "numeric_ratio"),
    ("kind = 'moment' OR (dt_ratio >= 0.9 AND (date_hint OR numeric_ratio < 0.5))", "datetime", "dt_ratio"),
    (UNIQUE_ID, "id_like", "0.92"), (f"u <= 30 OR {UR} < 0.1", "categorical", "0.86"),
    (f"avg_len >= 40 OR {UR} > 0.5", "text", "0.75")]
TYPE_SQL = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in CASCADE) + " ELSE 'categorical' END"
CONFIDENCE_SQL = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, _, x in CASCADE) + " ELSE 0.65 END"

TEXT_ORDERS = [("price_text", "string"), ("date_text", "string"), ("o_orderpriority", "string")]
TEXT_ORDERS_SQL = (
    "(SELECT concat(CAST(CAST(floor(o_totalprice/1000) AS INT) AS VARCHAR), ',', "
    "lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS VARCHAR), 3, '0')) AS price_text, "
    "strftime(o_orderdate, '%Y-%m-%d') AS date_text, o_orderpriority, o_orderkey FROM orders)")


def text_orders(spark, sf):
    """orders with price and date as the text a person would type."""
    return table(spark, sf, "orders").selectExpr(
        "concat(CAST(CAST(floor(o_totalprice/1000) AS INT) AS STRING), ',', "
        "lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0')) AS price_text",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS date_text", "o_orderpriority", "o_orderkey")


SIGNAL_TABLES = ["customer", "orders", "events", "part"]


@query("type_signals", oracle=f"""
SELECT rel, col AS "column", n, non_null, u, {sql_exact(UR)} AS ur, id_hint, date_hint, bool_like,
       {sql_exact('zero_padded_ratio')} AS zero_padded_ratio, {sql_exact('numeric_ratio')} AS numeric_ratio,
       {sql_exact('dt_ratio')} AS dt_ratio, {sql_r6('avg_len')} AS avg_len, {sql_r6('long_text_ratio')} AS long_text_ratio
FROM ({union_sql([signals_sql(t, TABLES[t], t) for t in SIGNAL_TABLES]
                 + [signals_sql(TEXT_ORDERS_SQL, TEXT_ORDERS, 'text_orders')])})""")
def type_signals(spark, sf):
    rels = {t: table(spark, sf, t) for t in SIGNAL_TABLES}
    rels["text_orders"] = text_orders(spark, sf).drop("o_orderkey")
    parts = [sk.type_signals(df).withColumn("rel", F.lit(t)) for t, df in rels.items()]
    out = reduce(lambda a, b: a.unionByName(b), parts).select(
        "rel", "column", "n", "non_null", "u", "ur", "id_hint", "date_hint", "bool_like", "zero_padded_ratio",
        "numeric_ratio", "dt_ratio", "avg_len", "long_text_ratio")
    return finish(out, exact=["ur", "zero_padded_ratio", "numeric_ratio", "dt_ratio"], r6=["avg_len", "long_text_ratio"])


@query("infer_types", oracle=f"""
SELECT rel, col AS "column", {TYPE_SQL} AS semantic_type, {sql_exact(CONFIDENCE_SQL)} AS confidence
FROM ({union_sql([signals_sql(t, TABLES[t], t) for t in TABLES]
                 + [signals_sql(TEXT_ORDERS_SQL, TEXT_ORDERS, 'text_orders')])})""")
def infer_types(spark, sf):
    rels = {t: table(spark, sf, t) for t in TABLES}
    rels["text_orders"] = text_orders(spark, sf).drop("o_orderkey")
    parts = [sk.infer_types(df).select(F.lit(t).alias("rel"), "column", "semantic_type", "confidence")
             for t, df in rels.items()]
    return finish(reduce(lambda a, b: a.unionByName(b), parts), exact=["confidence"])


@query("effective_type_counts", oracle=f"""
SELECT CASE WHEN col = 'l_linenumber' THEN 'categorical' ELSE {TYPE_SQL} END AS effective_type, count(*) AS columns
FROM ({signals_sql('lineitem', TABLES['lineitem'])}) GROUP BY 1""")
def effective_type_counts(spark, sf):
    types = sk.infer_types(table(spark, sf, "lineitem"), overrides={"l_linenumber": "categorical"})
    return sk.effective_type_counts(types)


@query("bool_like", oracle=f"""
SELECT 'quality' AS "column", coalesce(bool_and(lower({strip_sql('quality')}) IN {BOOLS}), false) AS bool_like FROM labels
UNION ALL SELECT 'toxic', coalesce(bool_and(lower({strip_sql('toxic')}) IN {BOOLS}), false) FROM labels
UNION ALL SELECT 'doc_id', coalesce(bool_and(lower({strip_sql('doc_id')}) IN {BOOLS}), false) FROM labels""")
def bool_like(spark, sf):
    return sk.bool_like(table(spark, sf, "labels"), ["quality", "toxic", "doc_id"])


@query("numeric_parse", oracle=f"""
SELECT l_orderkey, l_linenumber, txt, {number_sql('txt')} AS parsed FROM (
  SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5
    WHEN 0 THEN concat(' ', CAST(l_partkey AS VARCHAR), ',000 ') WHEN 1 THEN concat(CAST(l_suppkey AS VARCHAR), 'd')
    WHEN 2 THEN concat('-', CAST(l_partkey AS VARCHAR), '.5e2') WHEN 3 THEN 'Infinity' ELSE l_returnflag END AS txt
  FROM lineitem)""")
def numeric_parse(spark, sf):
    from skimlark.functions.exprs import parse_number
    texts = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", """CASE l_linenumber % 5
        WHEN 0 THEN concat(' ', CAST(l_partkey AS STRING), ',000 ') WHEN 1 THEN concat(CAST(l_suppkey AS STRING), 'd')
        WHEN 2 THEN concat('-', CAST(l_partkey AS STRING), '.5e2') WHEN 3 THEN 'Infinity' ELSE l_returnflag END AS txt""")
    return texts.select("l_orderkey", "l_linenumber", "txt", parse_number(F.col("txt")).alias("parsed"))


@query("datetime_parse", oracle=f"""
SELECT 'yyyy-M-d' AS time_format, count(try_strptime(t, '%Y-%m-%d')) AS hits,
       {sql_exact("count(try_strptime(t, '%Y-%m-%d')) / CAST(count(t) AS DOUBLE)")} AS ratio
FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders)""")
def datetime_parse(spark, sf):
    mixed = table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderpriority = '5-LOW' THEN o_orderpriority ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS t")
    return finish(sk.time_ratios(mixed, "t"), exact=["ratio"])


# one column a format: text in Spark, text's moment in SQL
WRITTEN = [
    ("iso_zone", "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '.', lpad(string(event_id % 1000), 3, '0'), '+02:00')",
     "date_trunc('second', ts) - INTERVAL 2 HOUR + to_milliseconds(event_id % 1000)", "yyyy-M-d'T'H:m:s[.SSSSSSSSS]XXX"),
    ("half_days", "date_format(ts, 'MM/dd/yyyy hh:mm a')", "date_trunc('minute', ts)", "M/d/yyyy h:m a"),
    ("month_names", "date_format(ts, 'd MMM yyyy HH:mm:ss')", "date_trunc('second', ts)", "d MMM yyyy H:m:s"),
    ("day_first", "date_format(ts, 'dd/MM/yyyy HH:mm')", "date_trunc('minute', ts)", "d/M/yyyy H:m"),
    ("fractions", "if(event_id % 3 = 0, date_format(ts, 'yyyy-MM-dd HH:mm:ss'), date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'))",
     "CASE WHEN event_id % 3 = 0 THEN date_trunc('second', ts) ELSE ts END", "yyyy-M-d H:m:s[.SSSSSSSSS]")]


@query("datetime_formats", oracle=union_sql([
    f"""SELECT '{c}' AS col, 'datetime' AS semantic_type, '{f.replace("'", "''")}' AS dt_format, count(x) AS n, sum(epoch_us(x))::DOUBLE AS total,
  strftime(min(x), '%Y-%m-%d %H:%M:%S.%f') AS first, strftime(max(x), '%Y-%m-%d %H:%M:%S.%f') AS last FROM (SELECT {e} AS x FROM events)"""
    for c, _, e, f in WRITTEN]))
def datetime_formats(spark, sf):
    df = table(spark, sf, "events").selectExpr(*[f"{e} AS {c}" for c, e, _, _ in WRITTEN])
    verdicts = {r["column"]: r for r in sk.infer_types(df).collect()}
    read = sk.convert_types(df, {c: r["semantic_type"] for c, r in verdicts.items()}, {c: r["dt_format"] for c, r in verdicts.items()})
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    since = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    parts = [read.agg(
        F.lit(c).alias("col"), F.lit(r["semantic_type"]).alias("semantic_type"), F.lit(r["dt_format"]).alias("dt_format"), F.count(c).alias("n"),
        F.sum(since(c).cast("decimal(38,0)")).cast("double").alias("total"), shown(F.min(c)).alias("first"), shown(F.max(c)).alias("last"))
        for c, r in verdicts.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("convert_types", oracle=f"""
SELECT o_orderkey, CAST(replace(price_text, ',', '') AS DOUBLE) AS price_text,
       strftime(strptime(date_text, '%Y-%m-%d'), '%Y-%m-%dT%H:%M:%S') AS date_text, o_orderpriority FROM {TEXT_ORDERS_SQL}""")
def convert_types(spark, sf):
    df = text_orders(spark, sf)
    verdicts = sk.infer_types(df).collect()
    types = {r["column"]: r["semantic_type"] for r in verdicts}
    formats = {r["column"]: r["dt_format"] for r in verdicts}
    return sk.convert_types(df, types, formats).select(
        "o_orderkey", "price_text", F.date_format("date_text", "yyyy-MM-dd'T'HH:mm:ss").alias("date_text"), "o_orderpriority")


@query("coerce_override", oracle="""
SELECT CAST(l_linenumber AS VARCHAR) AS l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS DOUBLE) * 1000 END AS number_text,
       strftime(make_timestamp(l_orderkey * 1000000), '%Y-%m-%dT%H:%M:%S') AS millis
FROM lineitem""")
def coerce_override(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_linenumber", "CASE WHEN l_linenumber % 2 = 0 THEN concat(l_partkey, ',000') ELSE concat('1,', l_partkey, ',000') END AS number_text",
        "l_orderkey * 1000 AS millis", "l_returnflag")
    out = sk.coerce_override(df, {"l_linenumber": "categorical", "number_text": "numeric", "millis": "datetime",
                                  "l_returnflag": "ignore"})
    return out.withColumn("millis", F.date_format("millis", "yyyy-MM-dd'T'HH:mm:ss"))
