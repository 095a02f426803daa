"""Exact 0/1 selection in groups too large for one row: bounds decide most items, what is left is solved in a task.

With a price per unit of weight, every item has a margin, value less price times weight. Taking all items of positive margin gives an
upper bound on every choice; a choice that leaves the side of an item's margin loses the margin's size. An item that
would lose more than lies between the upper bound and a known choice is therefore decided in every best choice.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import Oversize, running_sum
from spanforge.session import checkpoint

# Items on each side of the item at which the capacity ends that look for a good choice, and the choices kept meanwhile.
NEAR = 200
BEAM = 20_000
# Share of the upper bound by which float sums may differ.
SLACK = 1e-12
# Undecided items of a group that are solved in one task, and the choices of a group kept at once.
UNDECIDED = 2_000_000
CHOICES = 20_000_000


def merge(weights: np.ndarray, values: np.ndarray, weight: int, value: float, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Choices (rising weight and value) with and without one more item; those that a lighter one equals or beats are gone."""
    stop = int(np.searchsorted(weights, capacity - weight, side="right"))
    w = np.concatenate([weights, weights[:stop] + weight])
    v = np.concatenate([values, values[:stop] + value])
    order = np.argsort(w, kind="stable")  # two sorted runs
    w, v = w[order], v[order]
    rises = np.append(True, v[1:] > np.maximum.accumulate(v)[:-1])
    w, v = w[rises], v[rises]
    last = np.append(w[1:] > w[:-1], True)
    return w[last], v[last]


def good_value(weights: np.ndarray, values: np.ndarray, capacity: int, price: float, beam: int = BEAM) -> float:
    """The value of a good choice: merged lists of which the ``beam`` most promising choices stay."""
    if capacity < 0:
        return 0.0
    w, v = np.zeros(1, np.int64), np.zeros(1)
    for weight, value in zip(weights.tolist(), values.tolist(), strict=True):
        w, v = merge(w, v, weight, value, capacity)
        if len(w) > beam:
            keep = np.sort(np.argpartition(price * w - v, beam)[:beam])
            w, v = w[keep], v[keep]
    return float(v.max())


def bounded_subset(weights: np.ndarray, values: np.ndarray, capacity: int, price: float, least: float) -> np.ndarray:
    """0/1 choice of maximal value if that is at least ``least``; of equal choices the later item stays out.

    Choices that can't reach ``least`` even if all later items of positive margin are taken are dropped, so the lists stay short. Lists are kept at
    every s-th item, and those between are made again on the way back.
    """
    n = len(weights)
    chosen = np.zeros(n, bool)
    if not n or capacity < 0:
        return chosen
    margin = values - price * weights
    # The items of the smallest margins matter most: looked at last, they find a better choice to measure others by.
    near = np.argsort(-np.abs(margin), kind="stable")
    better = good_value(weights[near], values[near], capacity, price)
    least = max(least, better - SLACK * (abs(better) + 1))
    gain = np.maximum(margin, 0.0)
    later = np.append(np.cumsum(gain[::-1])[::-1], 0.0)

    def add(steps: tuple[np.ndarray, np.ndarray], i: int) -> tuple[np.ndarray, np.ndarray]:
        w, v = merge(*steps, int(weights[i]), float(values[i]), capacity)
        open_ = v + price * (capacity - w) + later[i + 1] >= least
        if open_.sum() > CHOICES:
            raise ValueError(f"more than {CHOICES} undominated choices: this group can't be solved exactly")
        return w[open_], v[open_]

    def at(steps: tuple[np.ndarray, np.ndarray], left: int) -> float:
        place = int(np.searchsorted(steps[0], left, side="right"))
        return float(steps[1][place - 1]) if place else -np.inf

    stride = max(1, int(np.sqrt(n)))
    steps, kept = (np.zeros(1, np.int64), np.zeros(1)), {}
    for i in range(n):
        if i % stride == 0:
            kept[i] = steps
        steps = add(steps, i)
    left = capacity
    for base in sorted(kept, reverse=True):
        rows = [kept[base]]
        for i in range(base, min(base + stride, n)):
            rows.append(add(rows[-1], i))
        for i in range(len(rows) - 2, -1, -1):
            if at(rows[i + 1], left) != at(rows[i], left):
                chosen[base + i] = True
                left -= int(weights[base + i])
    return chosen


def decide(items: DataFrame, keys: Sequence[str], item: str, over: Oversize) -> tuple[DataFrame, DataFrame]:
    """(items in every best choice, undecided items with what is left of the capacity, ``price`` and ``least``).

    ``items`` has integer ``weight``, ``value`` and ``capacity``. Items that no best choice holds are in neither.
    """
    keys = list(keys)
    useful = items.filter((F.col("value") > 0) & (F.col("weight") <= F.col("capacity")) & (F.col("capacity") > 0)).select(*keys, item, "weight", "value", "capacity")
    rate = F.when(F.col("weight") > 0, F.col("value") / F.col("weight")).otherwise(F.lit(float("inf")))
    rated = useful.withColumn("_rate", rate)
    sums = {"_weight": F.col("weight").cast("decimal(38,0)"), "_pos": F.lit(1).cast("long")}
    placed = checkpoint(running_sum(rated, keys, [F.desc("_rate"), F.col(item)], sums, over))
    first = F.when(F.col("_weight") > F.col("capacity"), F.struct("_pos", "_rate"))
    facts = placed.groupBy(*keys).agg(F.min(first).alias("_b"), F.count(F.lit(1)).alias("_n"), F.max("capacity").alias("capacity"))
    # A group that fits whole has no end and a price of nothing.
    facts = facts.select(*keys, "capacity", F.coalesce("_b._pos", F.col("_n") + 1).alias("_end"), F.coalesce("_b._rate", F.lit(0.0)).alias("price"))
    near = placed.drop("capacity").join(facts, keys)
    before, inside = F.col("_pos") < F.col("_end") - NEAR, F.col("_pos") < F.col("_end") + NEAR
    margin = F.col("value") - F.col("price") * F.col("weight")
    row = F.struct("_pos", "weight", "value")
    known = near.groupBy(*keys).agg(
        F.max("price").alias("price"),
        F.max("capacity").alias("capacity"),
        F.coalesce(F.sum(F.when(before, F.col("weight").cast("decimal(38,0)"))), F.lit(0)).cast("long").alias("_used"),
        F.coalesce(F.sum(F.when(before, F.col("value"))), F.lit(0.0)).alias("_value"),
        F.sort_array(F.collect_list(F.when(~before & inside, row))).alias("_near"),
        F.sum(F.greatest(margin, F.lit(0.0))).alias("_margins"),
    )
    known = known.withColumn("_found", F.col("_value") + _good(F.col("_near.weight"), F.col("_near.value"), F.col("capacity") - F.col("_used"), F.col("price")))
    bound = F.col("_margins") + F.col("price") * F.col("capacity")
    known = known.select(*keys, "price", F.col("_found").alias("least"), bound.alias("bound"))
    known = checkpoint(known.withColumn("_slack", SLACK * (F.abs("bound") + 1)))
    judged = placed.select(*keys, item, "weight", "value", "capacity").join(known, keys)
    open_ = F.abs(margin) <= F.col("bound") - F.col("least") + F.col("_slack")
    taken = judged.filter(~open_ & (margin > 0)).select(*keys, item, "weight", "value")
    used = taken.groupBy(*keys).agg(F.sum("weight").alias("_used"), F.sum("value").alias("_value"))
    rest = judged.filter(open_).join(used, keys, "left")
    left = (F.col("capacity") - F.coalesce("_used", F.lit(0))).cast("long")
    least = F.col("least") - F.coalesce("_value", F.lit(0.0)) - F.col("_slack")
    undecided = rest.select(*keys, item, "weight", "value", left.alias("capacity"), "price", least.alias("least"))
    return taken.select(*keys, item), undecided


def _good(weights: Column, values: Column, capacity: Column, price: Column) -> Column:
    def best(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([good_value(np.asarray(w, np.int64), np.asarray(v, float), int(c), p) for w, v, c, p in zip(*batch, strict=True)])

    return F.pandas_udf(best, "double")(weights, values, capacity, price)


def select_bounded(items: DataFrame, keys: Sequence[str], item: str, over: Oversize) -> DataFrame:
    """Chosen (keys, item) rows of large groups, exactly and with the tie rule of the one-row form.

    The items near the one at which the capacity ends, taken in order of value per weight, give a good choice;
    running sums and two grouped sums give the bounds. Undecided items are solved in one task per group: lists of undominated
    choices that can still reach the good one. A group with more than UNDECIDED of them, or whose lists grow beyond
    CHOICES, stops with an error; it never gets another algorithm.
    """
    keys = list(keys)
    taken, undecided = decide(items, keys, item, over)
    undecided = checkpoint(undecided)
    largest = undecided.groupBy(*keys).count().filter(F.col("count") > UNDECIDED).first()
    if largest is not None:
        raise ValueError(f"{largest['count']} undecided items in group {[largest[k] for k in keys]}: too many to choose exactly")
    kinds = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in [*keys, item])

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(item)
        r = group.iloc[0]
        hit = bounded_subset(group["weight"].to_numpy(np.int64), group["value"].to_numpy(float), int(r["capacity"]), float(r["price"]), float(r["least"]))
        return group.loc[hit, [*keys, item]]

    return taken.unionByName(undecided.groupBy(*keys).applyInPandas(solve, kinds))
