"""Ordered work inside groups: positions, running sums, neighbours, quantiles.

A group is normally one video and fits a task many times over; then a plain
window is the right plan. Before using it, the group sizes are counted (one
column-pruned pass with map-side combine). Groups above the limit are range-cut
into slabs along their order, each slab is worked on by itself, and one small row
per slab carries the state across. The cut is checkpointed, because slab borders come from
sampling and must not move if an executor is lost.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.session import BROADCAST_ROWS, checkpoint, row_limit

KEYS = ("dataset", "video_id")
SLAB = "_slab"
# Beyond this many slabs they grow instead; a slab is sorted and may spill.
MAX_SLABS = 20_000


@dataclass(frozen=True)
class Oversize:
    """Groups too large for one task; ``groups`` is None when there are none."""

    groups: DataFrame | None = None
    n_groups: int = 0
    rows: int = 0
    limit: int = 0
    whole_table: bool = False

    @property
    def empty(self) -> bool:
        return self.groups is None and not self.whole_table

    def split(self, df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows of ordinary groups, rows of oversize groups)."""
        if self.whole_table:
            return None, df
        if self.groups is None:
            return df, None
        side = F.broadcast(self.groups) if self.n_groups <= BROADCAST_ROWS else self.groups
        keys = list(keys)
        return df.join(side, keys, "left_anti"), df.join(side, keys, "left_semi")


def find_oversize(df: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None) -> Oversize:
    """Count group sizes and keep the groups above ``limit`` rows."""
    limit = limit or row_limit(df.sparkSession)
    if not keys:
        rows = df.count()
        return Oversize(rows=rows, limit=limit, whole_table=rows > limit)
    big = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    n_groups, rows = big.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if n_groups == 0:
        return Oversize(limit=limit)
    return Oversize(checkpoint(big.select(*keys)), n_groups, rows, limit)


def _slabs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], over: Oversize) -> DataFrame:
    rest, big = over.split(df, keys)
    parts = min(MAX_SLABS, max(2, math.ceil(2 * over.rows / over.limit)))
    cut = big.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    cut = checkpoint(cut.withColumn(SLAB, F.spark_partition_id() + 1))
    if rest is None:
        return cut
    return rest.withColumn(SLAB, F.lit(0)).unionByName(cut)


def _attach(df: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(carry, [*keys, SLAB], "left").drop(SLAB)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, Column],
    over: Oversize | None = None,
) -> DataFrame:
    """Add inclusive running sums of exact (integer) columns along ``order``."""
    over = over or find_oversize(df, keys)
    if over.empty:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({n: F.sum(c).over(w) for n, c in sums.items()})
    cut = _slabs(df, keys, order, over)
    totals = cut.groupBy(*keys, SLAB).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, SLAB, *[F.sum(f"_t_{n}").over(before).alias(f"_t_{n}") for n in sums])
    w = Window.partitionBy(*keys, SLAB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = _attach(cut.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}), carry, keys)
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_t_{n}"), F.lit(0)) for n in sums})
    return out.drop(*[f"_t_{n}" for n in sums])


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str = "pos",
    over: Oversize | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its group."""
    over = over or find_oversize(df, keys)
    if over.empty:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(w).cast("long") - 1)
    out = running_sum(df, keys, order, {name: F.lit(1).cast("long")}, over)
    return out.withColumn(name, F.col(name) - 1)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    value: Column,
    over: Oversize | None = None,
) -> DataFrame:
    """Add the last non-NULL ``value`` at or before each row."""
    over = over or find_oversize(df, keys)
    if over.empty:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    cut = _slabs(df, keys, order, over)
    w = Window.partitionBy(*keys, SLAB).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.withColumn(name, F.last(value, ignorenulls=True).over(w))
    # The last value of a slab is the one with the highest local position.
    numbered = local.withColumn(
        "_p", F.row_number().over(Window.partitionBy(*keys, SLAB).orderBy(*order))
    )
    ends = numbered.groupBy(*keys, SLAB).agg(F.max_by(name, "_p").alias("_end"))
    before = Window.partitionBy(*keys).orderBy(SLAB).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*keys, SLAB, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    out = _attach(local, carry, keys)
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def next_value(
    df: DataFrame, keys: Sequence[str], value: str, name: str, over: Oversize | None = None
) -> DataFrame:
    """Add the following value in ascending order of a column unique per group."""
    over = over or find_oversize(df, keys)
    if over.empty:
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(*keys).orderBy(value)))
    cut = _slabs(df, keys, [F.col(value)], over)
    firsts = cut.groupBy(*keys, SLAB).agg(F.min(value).alias("_first"))
    after = Window.partitionBy(*keys).orderBy(SLAB)
    carry = firsts.select(*keys, SLAB, F.lead("_first").over(after).alias("_carry"))
    local = Window.partitionBy(*keys, SLAB).orderBy(value)
    out = _attach(cut.withColumn(name, F.lead(value).over(local)), carry, keys)
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank"
) -> DataFrame:
    """The first ``k`` rows per group, with a 1-based rank column.

    Spark limits every group before the shuffle here, so hot groups stay small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], facts: bool = False
) -> DataFrame:
    """Exact quantiles with linear interpolation, from per-value counts.

    The built-in exact percentile keeps all distinct values of a group in one
    buffer; here only the value counts are ordered. They are made once and written to the shared folder. With
    ``facts`` count, mean, population deviation, smallest and largest value come from the same counts. Groups without
    a value have NULLs.
    """
    keys = list(keys)
    v, c = F.col(value).cast("double"), F.col("_c")
    counted = checkpoint(df.groupBy(*keys, value).agg(F.count(value).alias("_c")))
    sums = F.struct(F.sum(c).alias("n"), F.try_divide(F.sum(v * c), F.sum(c)).alias("mean"))
    totals = counted.groupBy(*keys).agg(sums.alias("_of"))
    ranked = running_sum(counted, keys, [F.col(value)], {"_hi": c})
    ranked = ranked.join(totals, keys) if keys else ranked.withColumn("_of", totals.scalar())

    def at(index: Column) -> Column:
        inside = (index < F.col("_hi")) & (index >= F.col("_hi") - c)
        return F.max(F.when(inside, v))

    parts, picks = [], []
    for name, prob in probs.items():
        spot = (F.col("_of.n") - 1) * F.lit(float(prob))
        parts += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_up_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_f_{name}"),
        ]
        low = F.col(f"_lo_{name}")
        picks.append((low + (F.col(f"_up_{name}") - low) * F.col(f"_f_{name}")).alias(name))
    if facts:
        gap = v - F.col("_of.mean")
        parts += [
            F.sum(c).alias("n"),
            F.max("_of.mean").alias("mean"),
            F.sqrt(F.try_divide(F.sum(c * gap * gap), F.sum(c))).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        ]
        picks = ["n", "mean", "std", "min", "max", *picks]
    return ranked.groupBy(*keys).agg(*parts).select(*keys, *picks)
