"""Sources, checks before reading, and the sink."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

import skimlark as sk
from parity.semantic import INFINITE, NUMBER, strip_sql
from parity.tools import GAPS_SQL, finish, gaps, query, sql_exact, table
from skimlark.functions.order import shared_folder

ISO = "'%Y-%m-%dT%H:%M:%S'"


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_scan", oracle=f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, {ISO}) AS o_orderdate, o_orderpriority FROM orders""")
def csv_scan(spark, sf):
    path = _folder(spark, "orders-csv")
    table(spark, sf, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")) \
        .write.option("header", True).csv(path)
    df = sk.csv_scan(spark, path, header="auto")
    return sk.convert_types(df, {"o_orderdate": "datetime"}).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))


def _raw_files(lines, path, first):
    """Lines written as they are, each file with the given lines at its top."""
    def run(batches):
        start = pd.DataFrame({"line": first})
        for pdf in batches:
            yield pd.concat([start, pdf])
            start = start[:0]

    lines.mapInPandas(run, "line string").write.option("sep", "\x01").option("emptyValue", "").csv(path)


@query("csv_preamble", oracle="SELECT o_orderkey, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderpriority FROM orders")
def csv_preamble(spark, sf):
    """Blank and other lines above the header of every file, semicolons, found by themselves."""
    path = _folder(spark, "orders-preamble")
    lines = table(spark, sf, "orders").selectExpr(
        "concat_ws(';', string(o_orderkey), o_orderstatus, string(bigint(floor(o_totalprice))), o_orderpriority) AS line").repartition(3)
    _raw_files(lines, path, ["Orders", "", "made by hand", "  ", "o_orderkey;o_orderstatus;price;o_orderpriority", ""])
    return sk.csv_scan(spark, path, sep="auto", header=2)


@query("malformed_lines", oracle="""
SELECT CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || repeat(',x', CAST(o_orderkey % 4 AS INT)) AS line, CAST(2 + o_orderkey % 4 AS INT) AS cells,
  3 AS expected FROM orders WHERE o_orderkey % 4 <> 1""")
def malformed_lines(spark, sf):
    path = _folder(spark, "orders-malformed")
    lines = table(spark, sf, "orders").selectExpr("concat(string(o_orderkey), ',', o_orderstatus, repeat(',x', int(o_orderkey % 4))) AS line").repartition(3)
    _raw_files(lines.select("line"), path, ["key,status,x"])
    return sk.malformed_lines(spark, path).drop("file")


LINES_SQL = """(SELECT concat('cust-', CAST(o_custkey AS VARCHAR)) AS file,
  concat_ws('|', CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')) AS line,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row FROM orders
  UNION ALL SELECT DISTINCT concat('cust-', CAST(o_custkey AS VARCHAR)), 'order|status|priority|placed', 0 FROM orders)"""


def _lines(spark, sf):
    """One file of text lines per customer, a header line first."""
    orders = table(spark, sf, "orders")
    body = orders.selectExpr(
        "concat('cust-', CAST(o_custkey AS STRING)) AS file",
        "concat_ws('|', CAST(o_orderkey AS STRING), o_orderstatus, o_orderpriority, date_format(o_orderdate, 'yyyy-MM-dd')) AS line",
        "o_orderkey")
    return orders, body


@query("delimiter_profile", oracle=f"""
WITH k AS (SELECT file, d, place, length(line) - length(replace(line, d, '')) AS k
  FROM {LINES_SQL}, (VALUES (',', 0), (';', 1), (chr(9), 2), ('|', 3)) AS c(d, place)),
t AS (SELECT file, d, place, k, count(*) AS c FROM k GROUP BY ALL),
s AS (SELECT file, d, place, CAST(sum(k * c) AS BIGINT) AS total,
        coalesce(max(CASE WHEN k > 0 THEN c END), 0) / CAST(sum(c) AS DOUBLE) AS share FROM t GROUP BY ALL)
SELECT file, d AS delimiter, total, {sql_exact('share')} AS share FROM
  (SELECT *, row_number() OVER (PARTITION BY file ORDER BY share DESC, total DESC, place) AS r FROM s) WHERE r = 1""")
def delimiter_profile(spark, sf):
    orders, body = _lines(spark, sf)
    head = orders.selectExpr("concat('cust-', CAST(o_custkey AS STRING)) AS file", "'order|status|priority|placed' AS line").distinct()
    return finish(sk.delimiter_profile(body.select("file", "line").unionByName(head)), exact=["share"])


BARE = f"lower(replace({strip_sql('cell')}, ',', ''))"
KIND = f"""CASE WHEN cell IS NULL OR {strip_sql('cell')} = '' THEN 'empty'
  WHEN regexp_matches({BARE}, '{NUMBER}') OR {BARE} IN {INFINITE} OR {BARE} IN ('nan', '+nan', '-nan') THEN 'numeric'
  WHEN regexp_matches({strip_sql('cell')}, '[-/:年月日]') AND (
     (regexp_matches({strip_sql('cell')}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') AND try_strptime({strip_sql('cell')}, '%Y-%m-%d') IS NOT NULL)
     OR (regexp_matches({strip_sql('cell')}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{2}}:\\d{{2}}$')
         AND try_strptime({strip_sql('cell')}, '%Y-%m-%d %H:%M:%S') IS NOT NULL)) THEN 'datetime' ELSE 'text' END"""


@query("cell_kind", oracle=f"""
SELECT event_id, cell, {KIND} AS kind FROM (SELECT event_id, CASE event_id % 6
  WHEN 0 THEN concat(CAST(user_id AS VARCHAR), ',000') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 2 THEN event_type
  WHEN 3 THEN '  ' WHEN 4 THEN concat('2024-13-', CAST(user_id AS VARCHAR)) ELSE props END AS cell FROM events)""")
def cell_kind(spark, sf):
    cells = table(spark, sf, "events").selectExpr("event_id", """CASE event_id % 6
        WHEN 0 THEN concat(CAST(user_id AS STRING), ',000') WHEN 1 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 2 THEN event_type
        WHEN 3 THEN '  ' WHEN 4 THEN concat('2024-13-', CAST(user_id AS STRING)) ELSE props END AS cell""")
    return cells.select("event_id", "cell", sk.cell_kind(F.col("cell")).alias("kind"))


CELLS_SQL = f"""(SELECT file, row, unnest(string_split(line, '|')) AS cell, unnest(range(len(string_split(line, '|')))) AS col
  FROM {LINES_SQL} WHERE row < 20)"""
HEADER_SQL = f"""
WITH p AS (SELECT file, row, col, cell, {KIND} AS kind FROM {CELLS_SQL}),
w AS (SELECT file, max(col) + 1 AS width FROM p GROUP BY file),
h AS (SELECT * FROM p WHERE row < 5),
b AS (SELECT file, row, count(*) FILTER (kind <> 'empty') AS vals, count(*) FILTER (kind = 'text') AS texts,
        count(*) FILTER (kind = 'numeric') AS numbers, count(DISTINCT cell) FILTER (kind <> 'empty') AS uniques FROM h GROUP BY ALL),
v AS (SELECT r.row, q.file, q.col, q.kind, count(*) AS c FROM p q JOIN (SELECT DISTINCT file, row FROM h) r
        ON q.file = r.file AND q.row > r.row AND q.row <= r.row + 5 WHERE q.kind <> 'empty' GROUP BY ALL),
m AS (SELECT file, row, col, kind AS usual FROM
        (SELECT *, row_number() OVER (PARTITION BY file, row, col ORDER BY c DESC, kind) AS r FROM v) WHERE r = 1),
x AS (SELECT m.file, m.row, avg(CASE WHEN coalesce(h.kind, 'empty') <> usual THEN 1.0 ELSE 0.0 END) AS contrast
        FROM m LEFT JOIN h ON m.file = h.file AND m.row = h.row AND m.col = h.col GROUP BY ALL),
s AS (SELECT b.file, b.row, CASE WHEN vals = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.30 * texts / vals
        + 0.25 * vals / width + 0.20 * uniques / vals + 0.25 * coalesce(contrast, 0.0) - 0.15 * numbers / vals)), 4) END AS score
      FROM b JOIN w ON b.file = w.file LEFT JOIN x ON b.file = x.file AND b.row = x.row)"""


@query("header_score", oracle=f"""{HEADER_SQL}
SELECT file, score >= 0.45 AS header_detected, CASE WHEN score >= 0.45 THEN CAST(row AS BIGINT) END AS header_row,
  CAST(score AS DOUBLE) AS header_confidence, score >= 0.45 AND score < 0.68 AS needs_confirmation
FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, row) AS r FROM s) WHERE r = 1""")
def header_score(spark, sf):
    from pyspark.sql import Window

    from skimlark.sources.delimited import cells_of_lines
    orders, body = _lines(spark, sf)
    w = Window.partitionBy("file").orderBy("o_orderkey")
    # the preview of each file is its first twenty rows; the limit is applied per task, before the shuffle
    rows = body.withColumn("row", F.row_number().over(w)).where(F.col("row") < 20).select(
        "file", "line", F.col("row").cast("long").alias("row"))
    head = orders.selectExpr("concat('cust-', CAST(o_custkey AS STRING)) AS file", "'order|status|priority|placed' AS line",
                             "CAST(0 AS BIGINT) AS row").distinct()
    return sk.header_score(cells_of_lines(rows.unionByName(head), "|"))


@query("encoding_check", oracle=f"""
SELECT source AS file, count(*) AS lines, count(text) AS valid_utf8, {sql_exact('avg(CASE WHEN text IS NOT NULL THEN 1.0 ELSE 0.0 END)')} AS share,
  bool_or(starts_with(text, chr(65279))) AS bom FROM documents GROUP BY source""")
def encoding_check(spark, sf):
    return finish(sk.encoding_check(table(spark, sf, "documents"), file="source", line="text"), exact=["share"])


@query("result_sink", oracle=f"""
SELECT CASE WHEN isinf(v_inf) OR isnan(v_inf) THEN NULL ELSE v_inf END AS v_inf, v_has, v_mixed FROM {GAPS_SQL}""")
def result_sink(spark, sf):
    folder = _folder(spark, "results")
    written = sk.write_results({"values": gaps(spark, sf).select("v_inf", "v_has", "v_mixed")}, folder, format="json")
    return spark.read.schema("v_inf double, v_has double, v_mixed string").json(written["values"])
