"""Data-quality rules over one row of facts per column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skimlark.config import DEFAULT, Config
from skimlark.operators.types import classify, type_signals

# Flag names in the order they are raised, and severities.
FLAGS = ["all_missing", "constant", "high_missing", "has_missing", "stray_content_candidate", "high_cardinality",
         "id_like", "infinity", "near_constant"]
SEVERITIES = ["info", "warning", "critical"]

DESCRIPTIONS = {
    "all_missing": "No value is present.",
    "constant": "There is at most one distinct value.",
    "high_missing": "The share of missing values reaches the limit.",
    "has_missing": "Some values are missing, fewer than the limit.",
    "stray_content_candidate": "Mostly empty, and what is there looks like notes, headings or a detached block.",
    "high_cardinality": "Too many distinct values to group by.",
    "id_like": "Looks like an identifier rather than a measurement.",
    "infinity": "Holds infinite values.",
    "near_constant": "Almost nothing but one value or gaps.",
}


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, *, overrides: Mapping[str, str] | None = None,
                 config: Config = DEFAULT) -> DataFrame:
    """Signals and types plus missing counts: what the quality rules read."""
    facts = classify(type_signals(df, columns, all_distinct=False, config=config), overrides=overrides, config=config)
    missing = F.col("n") - F.col("non_null")
    return facts.withColumn("missing_count", missing).withColumn(
        "missing_rate", F.coalesce(F.try_divide(missing.cast("double"), F.col("n")), F.lit(0.0)))


def stray_signals(facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Which of the three stray-content signs a column shows."""
    return facts.select(
        "column", "non_null", "missing_rate", "long_text_ratio", "numeric_ratio",
        _long_text().alias("long_text"), _mixed().alias("mixed"), _island().alias("island"),
        _stray(config).alias("stray"))


def _long_text() -> Column:
    return F.col("long_text_ratio") >= 0.3


def _mixed() -> Column:
    return (F.col("numeric_ratio") > 0.2) & (F.col("numeric_ratio") < 0.8)


def _island() -> Column:
    few = F.greatest(F.lit(10).cast("long"), F.floor(F.lit(0.05) * F.col("n")))
    return (F.col("missing_rate") >= 0.7) & (F.col("non_null") <= few)


def _stray(config: Config) -> Column:
    shaky = (F.col("non_null") > 0) & (F.col("missing_rate") >= config.high_missing_rate)
    return shaky & (_long_text() | _mixed() | _island())


def _raised(config: Config) -> list[tuple[str, Column]]:
    kind, rate, there = F.col("semantic_type"), F.col("missing_rate"), F.col("non_null") > 0
    high = rate >= config.high_missing_rate
    conditions = {
        "all_missing": ~there,
        "constant": there & (F.col("u") <= 1),
        "high_missing": there & high,
        "has_missing": there & ~high & (rate > 0),
        "stray_content_candidate": ~kind.isin("datetime", "text", "unknown") & _stray(config),
        "high_cardinality": kind.isin("categorical", "text") & (F.col("ur") >= config.high_cardinality_ratio)
        & (F.col("u") > config.max_category_count),
        "id_like": kind == "id_like",
        "infinity": (kind == "numeric") & (F.col("infinities") > 0),
        "near_constant": there & (rate >= config.near_constant_ratio) & (kind != "unknown") & (F.col("u") <= 1),
    }
    return [(f, conditions[f]) for f in FLAGS]


def severity(flag: Column, missing_rate: Column, config: Config = DEFAULT) -> Column:
    worst = flag.isin("all_missing", "stray_content_candidate") | (
        (flag == "high_missing") & (missing_rate >= config.high_missing_critical_rate))
    return F.when(worst, "critical").when(flag.isin("has_missing", "id_like"), "info").otherwise("warning")


def flagged(facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Facts plus ``flags``: the raised flags with severities, as an array in rule order."""
    nature = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in _raised(config)]))
    return facts.withColumn("flags", F.transform(nature, lambda f: F.struct(
        f.alias("flag"), severity(f, F.col("missing_rate"), config).alias("severity"))))


def quality_flags(facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``ordinal, column, position, flag, severity, description``, one row per raised flag."""
    described = F.lit("")
    for f, text in DESCRIPTIONS.items():
        described = F.when(F.col("flag") == f, text).otherwise(described)
    return (
        flagged(facts, config).select("ordinal", "column", F.posexplode("flags").alias("position", "f"))
        .select("ordinal", "column", "position", "f.flag", "f.severity").withColumn("description", described))


def worst_severity(flags: Column) -> Column:
    raised = F.transform(flags, lambda f: f["severity"])
    out = F.lit("clean")
    for s in SEVERITIES:
        out = F.when(F.array_contains(raised, s), s).otherwise(out)
    return out


def quality_summary(facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row: flags per severity, all flags, columns without a flag."""
    def per(s):
        return F.size(F.filter("flags", lambda f: f["severity"] == s))
    return flagged(facts, config).agg(
        *[F.coalesce(F.sum(per(s)), F.lit(0)).cast("long").alias(s) for s in reversed(SEVERITIES)],
        F.coalesce(F.sum(F.size("flags")), F.lit(0)).cast("long").alias("total_flags"),
        F.count_if(F.size("flags") == 0).alias("clean_columns"))


def usable_columns(facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``ordinal, column, semantic_type, usable, reasons``: which columns analysis may use."""
    names = F.transform("flags", lambda f: f["flag"])
    bad = (
        (worst_severity(F.col("flags")) == "critical") | (F.col("semantic_type") == "constant")
        | F.array_contains(names, "near_constant"))
    reasons = F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise(F.lit("constant"))
    return flagged(facts, config).select(
        "ordinal", "column", "semantic_type", (~bad).alias("usable"), F.when(bad, reasons).alias("reasons"))


def usable_list(usable: DataFrame) -> list[str]:
    """Usable columns in order; all columns when none is usable."""
    rows = sorted(usable.select("ordinal", "column", "usable").collect(), key=lambda r: r["ordinal"])
    return [r["column"] for r in rows if r["usable"]] or [r["column"] for r in rows]


def missingness_table(facts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Columns with gaps: type, count, rate, flags."""
    return flagged(facts, config).where("missing_count > 0").select(
        "column", "semantic_type", "missing_count", "missing_rate",
        F.array_join(F.transform("flags", lambda f: f["flag"]), ",").alias("flags"))


def column_health(facts: DataFrame, numeric: DataFrame | None, categorical: DataFrame | None,
                  moments: DataFrame | None, config: Config = DEFAULT) -> DataFrame:
    """Worst severity and a one-line description per column.

    Clean columns are left out unless their effective type is categorical or boolean.
    """
    lines = []
    if numeric is not None:
        lines.append(numeric.select("column", F.format_string(
            "mean %.2f, median %.2f, std %.2f, IQR outliers %d", "mean", "median", "std", "outlier_count").alias("line")))
    if moments is not None:
        lines.append(moments.select("column", F.concat_ws(" → ", "earliest", "latest").alias("line")))
    if categorical is not None:
        lines.append(categorical.select("column", F.format_string(
            'unique %d, top "%s" (%d)', "unique_count", F.coalesce("top_value", F.lit("—")), "top_count").alias("line")))
    described = lines[0]
    for t in lines[1:]:
        described = described.unionByName(t)
    health = flagged(facts, config).withColumn("severity", worst_severity(F.col("flags")))
    shown = (F.col("severity") != "clean") | F.col("effective_type").isin("categorical", "boolean")
    return (
        health.where(shown).join(F.broadcast(described), "column", "left")  # one row per column
        .select("ordinal", "column", "effective_type", "severity",
                F.array_join(F.transform("flags", lambda f: f["flag"]), ",").alias("flags"), "line"))
