"""A Spark-native engine for OpenStreetMap features and training-data preparation.

The calls below are loaded when first used, so Python workers that import the package stay light.
"""

from __future__ import annotations

import importlib

_CALLS = {
    "geoloom.reader": (
        "OsmReader", "convert_pbf_to_parquet", "convert_pbf_to_pandas", "convert_pbf_to_duckdb", "convert_region_to_parquet", "convert_region_to_pandas",
        "convert_region_to_duckdb", "convert_extract_to_parquet", "convert_extract_to_pandas", "convert_extract_to_duckdb", "display_available_extracts",
    ),
    "geoloom.cli": ("geocode",),
    "geoloom.sources.extracts": ("clear_cache",),
}
__all__ = [name for names in _CALLS.values() for name in names]


def __getattr__(name: str):
    for module, names in _CALLS.items():
        if name in names:
            return getattr(importlib.import_module(module), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
