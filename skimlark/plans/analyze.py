"""The whole-table analysis: types, profiles, flags, chart data, correlations."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skimlark.config import DEFAULT, Config
from skimlark.functions.order import materialize
from skimlark.functions.values import one_row
from skimlark.operators import charts, correlation, profile, quality, sampling, types as semantic
from skimlark.operators.state import profile_state
from skimlark.sources.sink import write_results

# The warning codes, and what every set of findings ends with.
WARNING_CODES = ["large_dataset", "wide_dataset", "correlation_truncated", "critical_quality_flags"]
LIMITATIONS = [
    "A correlation says nothing about cause.",
    "Values beyond the IQR fences are candidates, not proven errors.",
    "No units or domain ranges were assumed.",
]


# Small results that other tables build on: written once, so that nothing is scanned twice for them.
SHARED = {"dataset", "numeric_profile", "categorical_profile", "datetime_profile", "pearson_matrix", "spearman_matrix", "sampled_rows",
          "quality_summary", "warnings"}


class Tables(Mapping):
    """Result tables by name, each planned when first asked for."""

    def __init__(self) -> None:
        self._plans: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}

    def plan(self, name: str, make: Callable[[], DataFrame]) -> None:
        self._plans[name] = make

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            made = self._plans[name]()
            self._made[name] = materialize(made) if name in SHARED else made
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


@dataclass
class Analysis:
    """Result tables by name, and the choices made on the way."""

    types: dict[str, str]
    usable: list[str]
    features: list[str]
    default_pair: tuple[str, str] | None
    time_axis: str | None
    tables: Tables

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def write(self, path: str, *, format: str = "json", mode: str = "errorifexists") -> dict[str, str]:
        return write_results(self.tables, path, format=format, mode=mode)


def default_pair(usable: Sequence[str], types: Mapping[str, str],
                 requested: Sequence[tuple[str, str]] = ()) -> tuple[str, str] | None:
    """The first requested pair of usable columns, else the first two, numbers before others."""
    for a, b in requested:
        if a in usable and b in usable:
            return a, b
    ranked = sorted(usable, key=lambda c: types[c] != "numeric")
    return (ranked[0], ranked[1]) if len(ranked) > 1 else None


def warnings_table(dataset: DataFrame, summary: DataFrame, truncated: bool, config: Config = DEFAULT) -> DataFrame:
    """``code, message`` for large, wide, truncated or critically flagged data."""
    rows, cols, critical = F.col("rows"), F.col("columns"), F.col("critical")
    cases = [
        (rows >= config.large_row_threshold, F.format_string("The table has %d rows; charts may show a sample.", rows)),
        (cols >= config.wide_table_threshold, F.format_string("The table has %d columns; matrices are bounded.", cols)),
        (F.lit(truncated), F.lit("More numeric features than a correlation matrix may hold.")),
        (critical > 0, F.format_string("%d critical quality flags were raised.", critical)),
    ]
    found = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(code).alias("code"), text.alias("message"))) for code, (c, text) in zip(WARNING_CODES, cases)]))
    facts = one_row(dataset.select("rows", "columns"), summary.select("critical"))
    return facts.select(F.inline(found))


def findings_table(dataset: DataFrame, summary: DataFrame, warnings: DataFrame) -> DataFrame:
    """``position, level, text``: factual sentences, then the standing limitations."""
    facts = one_row(
        dataset.select("rows", "columns", "missing_rate", "duplicate_rate"),
        summary.select("critical", "total_flags"), warnings.agg(F.count(F.lit(1)).alias("warnings")))
    percent = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    sentences = [
        (F.lit(True), "Fact", F.format_string("The table has %d rows and %d columns.", "rows", "columns")),
        (F.lit(True), "Fact", F.concat(F.lit("Missing cells: "), percent("missing_rate"),
                                       F.lit("; repeated rows: "), percent("duplicate_rate"), F.lit("."))),
        (F.col("critical") > 0, "Attention", F.format_string("%d critical quality flags need a look.", "critical")),
        ((F.col("critical") == 0) & (F.col("total_flags") > 0), "Attention",
         F.format_string("%d quality flags were raised.", "total_flags")),
        (F.col("warnings") > 0, "Limitation", F.lit("Size or readability limits were applied.")),
        *[(F.lit(True), "Limitation", F.lit(text)) for text in LIMITATIONS],
    ]
    said = F.array_compact(F.array(*[
        F.when(c, F.struct(F.lit(level).alias("level"), text.alias("text"))) for c, level, text in sentences]))
    return facts.select(F.posexplode(said).alias("position", "s")).select("position", "s.level", "s.text")


def analyze(df: DataFrame, *, overrides: Mapping[str, str] | None = None, pairs: Sequence[tuple[str, str]] = (),
            method: str = "pearson", threshold: float | None = None, order_by: Sequence[str] | None = None,
            sample_key: Sequence[str] | None = None, config: Config = DEFAULT) -> Analysis:
    """Infer, profile, flag, select, chart, correlate.

    Every table is over all rows, but for ``sampled_rows``, which ``series`` and a scatter chart show
    (``sample_facts`` tells whether rows were left out). Types, usable columns and features are small and decided on the
    driver; each result table is planned when it is first asked for, and tables that say the same of a column share one scan.
    """
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError("the correlation threshold lies between 0 and 1")
    chosen = semantic.check_overrides(overrides)
    small = quality.column_facts(df, overrides=chosen, config=config)  # a local table, one row per column
    verdicts = sorted(small.collect(), key=lambda r: r["ordinal"])
    rows = verdicts[0]["n"] if verdicts else None
    small = small.coalesce(1)  # a row per column: one task, no shuffle
    types = {r["column"]: r["effective_type"] for r in verdicts}
    usable_table = quality.usable_columns(small, config)
    kept = [c for c in quality.usable_list(usable_table) if types[c] != "ignore"]

    texts = [c for c, t in types.items() if t == "numeric" and semantic.kind_of(df, c) == "string" and c not in chosen]
    moments = [c for c, t in types.items() if t == "datetime" and semantic.kind_of(df, c) == "string" and c not in chosen]
    formats = {r["column"]: r["dt_format"] for r in verdicts if r["dt_format"]}
    data = semantic.convert_types(df, {**{c: "numeric" for c in texts}, **{c: "datetime" for c in moments}}, formats)
    data = semantic.coerce_override(data, chosen)
    types = {c: t for c, t in types.items() if t != "ignore"}

    numeric = semantic.columns_of(types, "numeric")
    dated = semantic.columns_of(types, "datetime")
    plain = [c for c in types if c not in numeric and c not in dated and semantic.kind_of(data, c) != "nested"]
    usable_features = correlation.usable_numeric_list(data, types, kept)
    features, truncated = correlation.bounded_features(usable_features, config)
    pair = default_pair(kept, types, pairs)

    t = Tables()
    charted = [c for c in kept if c in types]
    t.plan("schema", lambda: small.select("ordinal", "column", "semantic_type", "confidence", "reason", "effective_type"))
    t.plan("type_counts", lambda: semantic.effective_type_counts(small))
    t.plan("dataset", lambda: profile.dataset_profile(df))
    t.plan("quality_flags", lambda: quality.quality_flags(small, config))
    t.plan("quality_summary", lambda: quality.quality_summary(small, config))
    t.plan("usable_columns", lambda: usable_table)
    t.plan("missingness", lambda: quality.missingness_table(small, config))
    t.plan("warnings", lambda: warnings_table(t["dataset"], t["quality_summary"], truncated, config))
    t.plan("findings", lambda: findings_table(t["dataset"], t["quality_summary"], t["warnings"]))
    t.plan("sample_facts", lambda: df.sparkSession.createDataFrame(
        [(rows, min(rows, config.plot_sample_size), rows > config.plot_sample_size)], "original_count long, plotted_count long, sampled boolean"))
    t.plan("sampled_rows", lambda: sampling.sample_rows(data, config.plot_sample_size, key=sample_key, total=rows, config=config))
    t.plan("series", lambda: sampling.aligned_series(t["sampled_rows"], types, charted, order_by=order_by, config=config))
    t.plan("profile_state", lambda: profile_state(data, config=config))
    if numeric:
        t.plan("numeric_profile", lambda: profile.numeric_profile(data, numeric, rows=rows, config=config))
    if plain:
        t.plan("categorical_profile", lambda: profile.categorical_profile(data, plain, rows=rows, config=config))
        top = lambda: t["categorical_profile"].select("column", "unique_count", F.posexplode("top_values").alias("i", "v")).select(
            "column", (F.col("i") + 1).alias("rank"), "v.value", "v.count", "unique_count")
        t.plan("category_counts", lambda: top().drop("unique_count"))
        t.plan("full_counts", lambda: top().where(F.col("unique_count") <= config.full_counts_max_cardinality).drop("unique_count"))
    if dated:
        t.plan("datetime_profile", lambda: profile.datetime_profile(data, dated, order_by=order_by, config=config))
    if numeric or plain or dated:
        t.plan("column_health", lambda: quality.column_health(
            small, *[t[n] if n in t else None for n in ("numeric_profile", "categorical_profile", "datetime_profile")], config))
    if features:
        for m in correlation.METHODS:
            t.plan(f"{m}_matrix", lambda m=m: correlation.correlation_matrix(data, features, m, config=config))
        drawn = correlation.random_features(usable_features, config=config)
        inside = F.col("feature_a").isin(drawn) & F.col("feature_b").isin(drawn)
        t.plan("random_subset", lambda: t[f"{method}_matrix"].where(inside) if set(drawn) <= set(features)
               else correlation.random_subset_corr(data, usable_features, method, config=config))
        t.plan("network_edges", lambda: correlation.network_edges(t[f"{method}_matrix"], features, threshold, config=config))
        t.plan("network_nodes", lambda: correlation.network_nodes(t["network_edges"], features))
    if pair is not None:
        kind = charts.chart_for(types[pair[0]], types[pair[1]])
        shown = lambda: t["sampled_rows"] if kind in charts.POINT_CHARTS else data
        if kind != "unsupported":
            t.plan("default_chart", lambda: charts.relationship(shown(), *pair, types, points=config.line_points, config=config)[1])
    return Analysis(types, kept, features, pair, sampling.time_axis(types), t)
