"""Queries over the driver's tables, grouped as the operators are."""

from __future__ import annotations

import importlib

MODULES = [
    "index_plans",
    "join_plans",
    "groundtruth_plans",
    "stats_plans",
    "distribution_plans",
    "sampling_plans",
    "text_plans",
    "metric_plans",
    "source_plans",
    "stream_plans",
]


def load():
    """(queries, checking SQL) by name."""
    for name in MODULES:
        importlib.import_module(f"spanforge.plans.{name}")
    from spanforge.plans.registry import QUERIES, SQL

    return QUERIES, SQL
