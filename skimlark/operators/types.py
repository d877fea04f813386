"""Semantic types: signals per column, the inference cascade, conversions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skimlark.config import DEFAULT, Config
from skimlark.functions.exprs import (
    BOOLEAN_WORDS, FLOATING, INFINITY_WORDS, INTEGRAL, NESTED, NUMERIC, TEMPORAL, ZERO_PADDED_PATTERN,
    col, dtype_of, finite, is_missing, micros_sql, parse_number, present, present_sql, quoted, stripped)
from skimlark.functions.moments import START, induced, parse_any_time, parse_time
from skimlark.functions.values import chunks, distinct_counts, melt

# Name patterns and the names of the semantic types.
ID_NAME = re.compile(r"(^|[_\s-])(id|uuid|guid|serial|code|编号|序号|编码)($|[_\s-])")
DATE_NAME = re.compile(r"date|time|timestamp|datetime|日期|时间")
SEMANTIC_TYPES = ["numeric", "categorical", "datetime", "boolean", "text", "id_like", "constant", "unknown"]
OVERRIDE_TYPES = ["numeric", "categorical", "datetime", "text", "ignore"]
WHITESPACE_SQL = r" \t\n\r\u000b\u000c"
LONG_CELL = 20  # characters from which a cell counts as long text

NUMBER_START = r"^[-+.,\diI]"  # what a number or an infinity begins with, commas included
NO_SIGNALS = {"n": 0, "non_null": 0, "bool_like": False, "zero_padded_ratio": 0.0, "numeric_ratio": 0.0, "avg_len": 0.0,
              "long_text_ratio": 0.0, "infinities": 0, "spread": None, "formats": []}
SIGNAL_SCHEMA = """ordinal int, column string, kind string, n long, non_null long, u long, ur double, id_hint boolean,
    date_hint boolean, bool_like boolean, zero_padded_ratio double, numeric_ratio double, dt_ratio double,
    dt_format string, avg_len double, long_text_ratio double, infinities long"""


def id_hint(name: str) -> bool:
    return bool(ID_NAME.search(name.lower()))


def date_hint(name: str) -> bool:
    return bool(DATE_NAME.search(name.lower()))


def kind_of(df: DataFrame, name: str) -> str:
    """Physical kind of a column: number, boolean, moment, nested or string."""
    dtype = dtype_of(df, name)
    for kind, classes in (("number", NUMERIC), ("boolean", (T.BooleanType,)), ("moment", TEMPORAL), ("nested", NESTED)):
        if isinstance(dtype, classes):
            return kind
    return "string"


def _cell(df: DataFrame, position: int, name: str) -> str:
    """SQL text of what the signals need of one value, the same struct for all columns but strings."""
    kind, c, dtype = kind_of(df, name), present_sql(df, name), dtype_of(df, name)
    whole, real, flag = "CAST(NULL AS BIGINT)", "CAST(NULL AS DOUBLE)", "false"
    moment = "CAST(NULL AS TIMESTAMP_NTZ)"
    if kind == "boolean":
        whole, flag = f"CAST({c} AS BIGINT)", f"{c} IS NOT NULL"
    elif kind == "moment":
        if isinstance(dtype, T.TimestampType):
            whole = micros_sql(df, name)
        else:
            moment = f"CAST({c} AS TIMESTAMP_NTZ)"
    elif isinstance(dtype, INTEGRAL):
        whole, flag = f"CAST({c} AS BIGINT)", f"{c} IN (0, 1)"
    elif kind == "number":
        real = f"CAST({c} AS DOUBLE)"
    return (f"named_struct('position', {position}, 'there', {c} IS NOT NULL, 'whole', {whole}, 'real', {real}, "
            f"'moment', {moment}, 'flag', {flag})")


def _text_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [f"named_struct('position', {i}, 'text', btrim({quoted(c)}, '{WHITESPACE_SQL}'))" for i, c in enumerate(columns)]
    return df.selectExpr(f"inline(array({', '.join(cells)}))")


def _measure(df: DataFrame, columns: Sequence[str], config: Config = DEFAULT) -> dict[str, dict]:
    """Signals of all columns; very wide tables are read some columns at a time."""
    found: dict[str, dict] = {}
    for part in chunks(list(columns), config.columns_per_pass):
        found.update(_measure_part(df, part))
    return found


def _measure_part(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """An aggregate for strings, one for the rest, one for likely dates.

    Grouping cells by column keeps the generated code of an aggregate the same
    for any columns, and each task hands on one row per column. The many time
    formats are only tried on columns where some text begins like a moment.
    """
    strings = [c for c in columns if kind_of(df, c) == "string"]
    others = [c for c in columns if c not in strings]
    found: dict[str, dict] = {}
    if others:
        cells = df.selectExpr(f"inline(array({', '.join(_cell(df, i, c) for i, c in enumerate(others))}))")
        table = cells.groupBy("position").agg(
            F.count(F.lit(1)).alias("n"), F.count_if("there").alias("non_null"),
            F.coalesce(F.bool_and("flag"), F.lit(False)).alias("bool_like"),
            F.count_if(F.abs("real") == float("inf")).alias("infinities"),
            F.coalesce(*[F.min(x) < F.max(x) for x in ("whole", "real", "moment")]).alias("spread"))
        found.update({others[r["position"]]: r.asDict() for r in table.collect()})  # one row per column
    if strings:
        text, size = F.col("text"), F.length("text")
        share = lambda c: F.coalesce(F.avg(F.when(text.isNotNull(), F.coalesce(c, F.lit(False)).cast("double"))), F.lit(0.0))
        # cheap tests first: what cannot be a number, an infinity or a yes is not looked at closely
        number = F.when(text.rlike(NUMBER_START), parse_number(text))
        word = F.when(size <= max(map(len, BOOLEAN_WORDS)), F.lower(text))
        table = _text_cells(df, strings).groupBy("position").agg(
            F.count(F.lit(1)).alias("n"), F.count(text).alias("non_null"),
            F.coalesce(F.bool_and(F.when(text.isNotNull(), F.coalesce(word.isin(BOOLEAN_WORDS), F.lit(False)))), F.lit(False))
            .alias("bool_like"),
            share(text.rlike(ZERO_PADDED_PATTERN)).alias("zero_padded_ratio"),
            share(number.isNotNull()).alias("numeric_ratio"),
            F.count_if(F.abs(number) == float("inf")).alias("infinities"),
            F.count_if(text.rlike(START)).alias("moments"),
            F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_len"), share(size > LONG_CELL).alias("long_text_ratio"))
        found.update({strings[r["position"]]: r.asDict() for r in table.collect()})
    maybe = [c for c in strings if found.get(c, {}).get("moments")]
    if maybe:
        for position, formats in induced(_text_cells(df, maybe)).items():
            found[maybe[position]]["formats"] = formats
    return found


def _counted(df: DataFrame, name: str) -> bool:
    """Does a rule need the exact distinct count of this column?"""
    kind = kind_of(df, name)
    return kind == "string" or (kind == "number" and id_hint(name))


def type_signals(df: DataFrame, columns: Sequence[str] | None = None, *, all_distinct: bool = True,
                 config: Config = DEFAULT) -> DataFrame:
    """What the inference rules look at, one row per column.

    The table is read when this is called; the result is a small local table, so
    rules built on it read nothing again. ``all_distinct=False`` skips the exact
    distinct count where no rule needs it; ``u`` is then 2 for a column whose
    smallest and largest value differ.
    """
    columns = list(columns or df.columns)
    plain = [c for c in columns if kind_of(df, c) != "nested"]
    counted = plain if all_distinct else [c for c in plain if _counted(df, c)]
    measured = _measure(df, columns, config)
    distinct = {r["column"]: r["u"] for r in distinct_counts(df, counted).collect()} if counted else {}
    rows = []
    for i, c in enumerate(columns):
        kind = kind_of(df, c)
        m = NO_SIGNALS | measured.get(c, {})
        there = m["non_null"]
        u = distinct.get(c, 0) if c in counted else (0 if kind == "nested" or not there else 2 if m["spread"] else 1)
        best_format, best = m["formats"][0] if m["formats"] else (None, there if kind == "moment" else 0)
        rows.append((
            i, c, kind, m["n"], there, u, u / there if there else 0.0, id_hint(c), date_hint(c), m["bool_like"],
            m["zero_padded_ratio"], float(there > 0) if kind == "number" else m["numeric_ratio"],
            best / there if there else 0.0, best_format,
            m["avg_len"], m["long_text_ratio"], m["infinities"]))
    return df.sparkSession.createDataFrame(rows, SIGNAL_SCHEMA)


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, *, overrides: Mapping[str, str] | None = None,
                config: Config = DEFAULT) -> DataFrame:
    """``ordinal, column, semantic_type, confidence, reason, effective_type``, one row per column."""
    signals = type_signals(df, columns, all_distinct=False, config=config)
    return classify(signals, overrides=overrides, config=config).select(
        "ordinal", "column", "semantic_type", "confidence", "reason", "effective_type", "dt_format")


def classify(signals: DataFrame, *, overrides: Mapping[str, str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """``type_signals`` plus the verdict of the ordered rules; the first that holds decides."""
    kind, ur = F.col("kind"), F.col("ur")
    unique_id = F.col("id_hint") & (ur >= config.id_unique_ratio)
    parses = (
        (F.col("numeric_ratio") >= config.numeric_parse_ratio)
        & (F.col("zero_padded_ratio") < config.zero_padded_limit) & ~F.col("id_hint"))
    dated = (F.col("dt_ratio") >= config.datetime_parse_ratio) & (F.col("date_hint") | (F.col("numeric_ratio") < 0.5))
    rules = [
        (F.col("non_null") == 0, "unknown", F.lit(1.0), "no values present"),
        (kind == "nested", "unknown", F.lit(1.0), "nested values are not profiled"),
        (F.col("u") <= 1, "constant", F.lit(1.0), "a single distinct value"),
        ((kind == "boolean") | F.col("bool_like"), "boolean", F.lit(0.98), "boolean type or spellings"),
        ((kind == "number") & unique_id, "id_like", F.lit(0.90), "identifier name and unique values"),
        (kind == "number", "numeric", F.lit(0.99), "number type"),
        ((kind == "string") & parses, "numeric", F.col("numeric_ratio"), "strings read as numbers"),
        ((kind == "moment") | dated, "datetime", F.col("dt_ratio"), "values read as moments"),
        (unique_id, "id_like", F.lit(0.92), "identifier name and unique values"),
        ((F.col("u") <= config.max_category_count) | (ur < 0.1), "categorical", F.lit(0.86), "few distinct values"),
        ((F.col("avg_len") >= 40) | (ur > 0.5), "text", F.lit(0.75), "long or mostly unique strings"),
    ]
    verdict = F.struct(F.lit("categorical").alias("t"), F.lit(0.65).alias("c"), F.lit("medium distinct strings").alias("r"))
    for condition, name, confidence, reason in reversed(rules):
        hit = F.struct(F.lit(name).alias("t"), confidence.alias("c"), F.lit(reason).alias("r"))
        verdict = F.when(condition, hit).otherwise(verdict)
    return signals.withColumn("_v", verdict).select(
        "*", F.col("_v.t").alias("semantic_type"), F.col("_v.c").alias("confidence"),
        F.col("_v.r").alias("reason"), _effective(F.col("_v.t"), overrides).alias("effective_type")).drop("_v")


def _effective(inferred: Column, overrides: Mapping[str, str] | None) -> Column:
    out = inferred
    for name, wanted in check_overrides(overrides).items():
        out = F.when(F.col("column") == name, wanted).otherwise(out)
    return out


def check_overrides(overrides: Mapping[str, str] | None) -> dict[str, str]:
    for name, wanted in (overrides or {}).items():
        if wanted not in OVERRIDE_TYPES:
            raise ValueError(f"override of {name!r} must be one of {OVERRIDE_TYPES}, not {wanted!r}")
    return dict(overrides or {})


def type_map(df: DataFrame, columns: Sequence[str] | None = None, *, overrides: Mapping[str, str] | None = None,
             config: Config = DEFAULT) -> dict[str, str]:
    """Effective types on the driver: one small row per column."""
    rows = infer_types(df, columns, overrides=overrides, config=config).collect()
    return {r["column"]: r["effective_type"] for r in sorted(rows, key=lambda r: r["ordinal"])}


def effective_type_counts(types: DataFrame) -> DataFrame:
    """``effective_type, columns`` over the result of :func:`infer_types`."""
    return types.groupBy("effective_type").agg(F.count(F.lit(1)).alias("columns"))


def bool_like(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Are all values of a column spelled like booleans? One row per column."""
    row = df.agg(*[
        F.coalesce(F.bool_and(F.lower(stripped(present(df, c))).isin(BOOLEAN_WORDS)), F.lit(False)).alias(f"{i}_bool_like")
        for i, c in enumerate(columns)])
    return melt(row, columns, ["bool_like"]).select("column", "bool_like")


def time_formats(df: DataFrame, columns: Sequence[str]) -> dict[str, list[tuple[str, int]]]:
    """Time formats of string columns with the number of values each reads, most first; derived from all values."""
    found = induced(_text_cells(df, columns)) if columns else {}
    return {c: found.get(i, []) for i, c in enumerate(columns)}


def time_ratios(df: DataFrame, column: str) -> DataFrame:
    """``time_format, hits, ratio``: share of non-null values that each derived time format reads."""
    text = df.select(present(df, column).cast("string").alias("text"))
    there = text.agg(F.count("text")).first()[0]
    found = time_formats(text, ["text"])["text"]
    return df.sparkSession.createDataFrame([(f, h, h / there) for f, h in found], "time_format string, hits long, ratio double")


def _read_time(df: DataFrame, name: str, known: Sequence[str]) -> Column:
    """The moment of a text by the first of these formats that reads it, else by any common one."""
    return F.coalesce(*[parse_time(col(name), f) for f in known], *([] if known else [parse_any_time(col(name))]))


def convert_types(df: DataFrame, types: Mapping[str, str], formats: Mapping[str, str] | None = None) -> DataFrame:
    """Numbers without thousands commas, parsed moments; other columns unchanged.

    ``formats`` names the time format of a string column (see ``infer_types``);
    the formats of other ones are derived from all values, and a value is read
    by the first that fits it.
    """
    out = {}
    moments = [c for c, t in types.items() if t == "datetime" and kind_of(df, c) == "string"]
    found = time_formats(df, [c for c in moments if not (formats or {}).get(c)])
    for name, t in types.items():
        if t == "numeric" and kind_of(df, name) == "string":
            out[name] = parse_number(col(name))
        elif name in moments:
            known = (formats or {}).get(name)
            out[name] = _read_time(df, name, [known] if known else [f for f, _ in found[name]])
    return df.withColumns(out) if out else df


def coerce_override(df: DataFrame, overrides: Mapping[str, str]) -> DataFrame:
    """Re-read columns as the user says; ``ignore`` drops the column.

    As numbers only the first comma is removed and non-finite values vanish.
    """
    out, dropped = {}, []
    found = time_formats(df, [c for c, t in check_overrides(overrides).items() if t == "datetime" and kind_of(df, c) == "string"])
    for name, wanted in check_overrides(overrides).items():
        kind, c = kind_of(df, name), present(df, name)
        if wanted == "ignore":
            dropped.append(name)
        elif wanted == "numeric":
            if kind == "string":
                once = F.regexp_replace(stripped(c), "^([^,]*),", "$1")
                number = F.when(~F.contains(once, F.lit(",")), parse_number(once))
                out[name] = F.when(F.abs(number) < F.lit(float("inf")), number)
            else:
                out[name] = finite(df, name) if kind in ("number", "boolean") else F.lit(None).cast("double")
        elif wanted in ("categorical", "text"):
            out[name] = c.cast("string")
        elif wanted == "datetime":
            if kind == "string":
                out[name] = _read_time(df, name, [f for f, _ in found[name]])
            elif kind == "number":  # milliseconds, shown in UTC
                out[name] = F.timestamp_add("MILLISECOND", c.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
            else:
                out[name] = c.cast("timestamp_ntz") if kind == "moment" else F.lit(None).cast("timestamp_ntz")
    return (df.withColumns(out) if out else df).drop(*dropped)


def columns_of(types: Mapping[str, str], *wanted: str) -> list[str]:
    return [c for c, t in types.items() if t in wanted]


__all__ = [
    "SEMANTIC_TYPES", "OVERRIDE_TYPES", "id_hint", "date_hint", "type_signals", "classify", "infer_types", "type_map",
    "effective_type_counts", "bool_like", "time_ratios", "convert_types", "coerce_override", "is_missing", "FLOATING"]
