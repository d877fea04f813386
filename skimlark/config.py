"""Settings of the engine: analysis thresholds and physical size limits."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Thresholds that decide results, then limits that only decide the plan.

    The second block never changes a result: it says from which size on an
    operator leaves its one-task (or broadcast) form for the distributed one.
    """

    # Analysis thresholds.
    header_preview_rows: int = 20
    header_candidate_rows: int = 5
    header_following_rows: int = 5
    header_detected_score: float = 0.45
    header_confidence_threshold: float = 0.68
    large_row_threshold: int = 200_000
    wide_table_threshold: int = 80
    plot_sample_size: int = 10_000
    line_points: int = 2_000
    max_category_count: int = 30
    top_k_categories: int = 10
    high_cardinality_ratio: float = 0.5
    high_missing_rate: float = 0.4
    high_missing_critical_rate: float = 0.8
    near_constant_ratio: float = 0.995
    correlation_max_features: int | None = None
    correlation_default_features: int = 10
    correlation_max_selectable: int = 20
    correlation_threshold: float = 0.7
    random_feature_count: int = 10
    random_seed: int = 42
    datetime_parse_ratio: float = 0.9
    numeric_parse_ratio: float = 0.95
    id_unique_ratio: float = 0.9
    zero_padded_limit: float = 0.2
    full_counts_max_cardinality: int = 50

    # Physical limits.
    single_task_rows: int = 1_000_000
    """Most rows one window partition may order by itself; more are range-partitioned,
    and exact quantiles over more rows are bracketed by sketches first."""
    range_parts: int = 20_000
    """Most range parts of one ordering; a part is sorted with spilling, so it may grow beyond them."""
    broadcast_rows: int = 100_000
    """Most rows of a lookup table that is sent to every executor."""
    sketch_k: int = 4000
    """Size parameter of the quantile sketches."""
    sketch_slack: float = 0.002
    """Rank distance of a bracket from its target, about twice the sketch error."""
    columns_per_pass: int = 40
    """Columns put into one wide aggregate."""
    pairs_per_pass: int = 6
    """Column pairs put into one aggregate of expressions; more go through matrix products."""


DEFAULT = Config()
