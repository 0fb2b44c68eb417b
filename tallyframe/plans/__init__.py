from tallyframe.plans.reports import (
    amount_per_zone,
    items_per_suffix,
    items_per_token,
    items_per_year,
    mean_per_group,
    rated_items,
    records_per_year,
    top_rated_items,
    trips_per_pair,
)

__all__ = [
    "amount_per_zone",
    "items_per_suffix",
    "items_per_token",
    "items_per_year",
    "mean_per_group",
    "rated_items",
    "records_per_year",
    "top_rated_items",
    "trips_per_pair",
]
