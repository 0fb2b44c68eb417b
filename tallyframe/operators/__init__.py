from tallyframe.operators.charts import chart_aggregate, chart_from_spec, chart_series
from tallyframe.operators.exact import exact_sums
from tallyframe.operators.grouping import avg_by_group, filtered_sum, group_count, value_counts
from tallyframe.operators.rated import rated_by_group
from tallyframe.operators.rows import contains_text, limit_rows, top_k
from tallyframe.operators.sampling import map_and_sum, ratio_estimate
from tallyframe.operators.skew import join_splitting_hot_keys
from tallyframe.operators.tokens import explode_tokens, token_counts

__all__ = [
    "avg_by_group",
    "chart_aggregate",
    "chart_from_spec",
    "chart_series",
    "contains_text",
    "exact_sums",
    "explode_tokens",
    "filtered_sum",
    "group_count",
    "join_splitting_hot_keys",
    "limit_rows",
    "map_and_sum",
    "rated_by_group",
    "ratio_estimate",
    "token_counts",
    "top_k",
    "value_counts",
]
