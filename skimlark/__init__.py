"""First look at a table of any size, as Spark jobs over all rows."""

from skimlark.config import DEFAULT, Config
from skimlark.operators.charts import (
    acf, box_stats, category_counts, category_over_time, contingency, facet_box, facet_contingency, full_counts,
    group_box, group_mean, grouped_box, histogram, kde, line_series, outlier_rows, qq_points, relationship, scatter,
    stacked_bar, time_coverage, time_series, top5_with_other)
from skimlark.operators.correlation import (
    avg_rank, bounded_features, correlation_matrix, feature_selection, matrix_completion, network_edges, network_nodes,
    pair_stats, pearson_matrix, random_features, random_subset_corr, spearman_matrix, usable_numeric)
from skimlark.operators.profile import (
    categorical_profile, dataset_profile, datetime_profile, duplicate_rows, field_statistics, numeric_profile)
from skimlark.operators.quality import (
    column_facts, column_health, missingness_table, quality_flags, quality_summary, stray_signals, usable_columns)
from skimlark.operators.sampling import aligned_series, sample_facts, sample_rows, time_axis
from skimlark.operators.state import approximate_distinct, merge_states, profile_of_state, profile_state
from skimlark.operators.types import (
    bool_like, coerce_override, convert_types, effective_type_counts, infer_types, time_formats, time_ratios, type_map, type_signals)
from skimlark.plans.analyze import Analysis, analyze, default_pair
from skimlark.sources.delimited import (
    cell_kind, csv_scan, delimiter_profile, encoding_check, header_score, header_scores, input_validate,
    malformed_lines, normalize_columns)
from skimlark.sources.sink import write_results

__all__ = [name for name in dir() if not name.startswith("_")]
