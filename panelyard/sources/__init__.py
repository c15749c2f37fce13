"""Readers, feature stores and result sinks."""

from panelyard.sources.csvs import load_panel_folder, load_series, load_table, load_with_target
from panelyard.sources.stores import (
    append_run,
    load_features,
    load_model,
    save_features,
    save_model,
    save_scores,
)

__all__ = [
    "append_run",
    "load_features",
    "load_model",
    "load_panel_folder",
    "load_series",
    "load_table",
    "load_with_target",
    "save_features",
    "save_model",
    "save_scores",
]
