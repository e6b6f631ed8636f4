"""Importing this module registers every query."""

from workload import (  # noqa: F401
    dispatch_queries,
    explore_queries,
    forecast_queries,
    layout_queries,
    source_queries,
    staging_queries,
    variants,
)
