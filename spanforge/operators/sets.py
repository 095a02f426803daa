"""Set operations between groups, ids and finished work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import KEYS, with_position


def union_distinct_sorted(rows: DataFrame, item: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Distinct ids of a group over all its units, numbered in order."""
    ids = rows.filter(F.col(item).isNotNull()).select(*keys, item).distinct()
    return with_position(ids, keys, [F.col(item)], "pos")


def new_items(available: DataFrame, processed: DataFrame, on: Sequence[str]) -> DataFrame:
    return available.select(*on).distinct().join(processed, list(on), "left_anti")


def union_done_sources(*sources: DataFrame, on: Sequence[str]) -> DataFrame:
    """Ids finished according to any source."""
    rows = sources[0].select(*on)
    for more in sources[1:]:
        rows = rows.unionByName(more.select(*on))
    return rows.distinct()
