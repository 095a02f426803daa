"""Bounds decide most items of a large group; the choice is that of the one-row form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import bounded_choice as bc
from spanforge.operators import groundtruth as gt
from spanforge.operators.ordered import find_oversize

ITEMS = "dataset string, video_id string, shot_idx long, weight long, value double, capacity long"


@pytest.mark.parametrize("seed", range(40))
def test_undecided_items_are_solved_with_the_tie_rule(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    weights, values = rng.integers(1, 20, n), rng.integers(1, 12, n).astype(float)
    if seed % 4 == 0:
        values = weights.astype(float)  # every item has the same rate
    capacity = int(rng.integers(1, weights.sum() + 2))
    want = gt._best_subset(weights, values, capacity)
    for price in (0.0, 0.7, 2.0):
        got = bc.bounded_subset(weights, values, capacity, price, float(values[want].sum()) - 3.0)
        assert (got == want).all()


def test_groups_by_bounds_choose_as_in_one_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(24):
        n = int(rng.integers(1, 60))
        weights = rng.integers(0 if g % 3 == 0 else 1, 15, n)
        values = weights.astype(float) if g % 4 == 0 else rng.integers(-1, 12, n).astype(float)
        capacity = 0 if g == 5 else int(rng.integers(1, max(2, weights.sum() + 3)))
        rows += [("d", f"g{g}", i, int(weights[i]), float(values[i]), capacity) for i in range(n)]
    items = spark.createDataFrame(rows, ITEMS).repartition(3)
    want = sorted(map(tuple, gt.select_under_budget(items).collect()))
    monkeypatch.setattr(bc, "NEAR", 3)
    assert sorted(map(tuple, bc.select_bounded(items, gt.KEYS, "shot_idx", find_oversize(items)).collect())) == want
    monkeypatch.setattr(gt, "FOLD_ROWS", 10)
    assert sorted(map(tuple, gt.select_under_budget(items).collect())) == want


def test_many_items_of_distinct_weights(spark):
    n = 120_000
    items = spark.range(n).select(
        F.lit("d").alias("dataset"),
        F.lit("v").alias("video_id"),
        F.col("id").alias("shot_idx"),
        (F.pmod(F.col("id") * 7_919, F.lit(n)) + 1).alias("weight"),
        F.pmod(F.xxhash64("id"), F.lit(1_000_000)).cast("double").alias("value"),
    ).withColumn("capacity", F.lit(n * (n + 1) // 2 * 15 // 100))
    got = gt.select_under_budget(items)
    weight, value = items.join(got, ["dataset", "video_id", "shot_idx"]).agg(F.sum("weight"), F.sum("value")).first()
    capacity = n * (n + 1) // 2 * 15 // 100
    rows = np.array(items.select("weight", "value").collect())
    assert weight <= capacity
    assert value == pytest.approx(best_value(rows[:, 0].astype(np.int64), rows[:, 1], capacity, value), abs=0.01)


def best_value(weights, values, capacity, known):
    """A second way: every set of items that leave the side of their margin, by depth, cut where it can't beat what is known."""
    rate = values / weights
    order = np.argsort(-rate)
    price = rate[order[int(np.searchsorted(np.cumsum(weights[order]), capacity, side="right"))]]
    margin = values - price * weights
    base = int(weights[margin > 0].sum())
    flips = np.argsort(np.abs(margin), kind="stable")[:400]
    loss, change = np.abs(margin)[flips].tolist(), np.where(margin[flips] > 0, -weights[flips], weights[flips]).tolist()
    best = float("inf")

    def search(at, lost, weight):
        nonlocal best
        if weight <= capacity:
            best = min(best, lost + price * (capacity - weight))
        for i in range(at, len(loss)):
            if lost + loss[i] >= best:
                return
            search(i + 1, lost + loss[i], weight + change[i])

    bound = np.maximum(margin, 0).sum() + price * capacity
    best = bound - known + 0.25
    search(0, 0.0, base)
    assert loss[-1] > best
    return bound - best


def test_too_many_undecided_items_raise(spark, monkeypatch):
    monkeypatch.setattr(bc, "UNDECIDED", 5)
    items = spark.createDataFrame([("d", "v", i, 2, 2.0, 21) for i in range(50)], ITEMS)
    with pytest.raises(ValueError, match="undecided"):
        bc.select_bounded(items, gt.KEYS, "shot_idx", find_oversize(items))
