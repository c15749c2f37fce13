"""Building blocks that keep plans whole on skewed or very long inputs."""

from panelyard.plans.attach import attach, with_row
from panelyard.plans.hashing import hash_cut, hash_key
from panelyard.plans.ordering import with_global_index, with_running_total, with_series_position
from panelyard.plans.quantiles import exact_quantiles, quantiles_of_table
from panelyard.plans.staging import release, shared_dir, stage

__all__ = [
    "attach",
    "exact_quantiles",
    "hash_cut",
    "hash_key",
    "quantiles_of_table",
    "release",
    "shared_dir",
    "stage",
    "with_global_index",
    "with_row",
    "with_running_total",
    "with_series_position",
]
