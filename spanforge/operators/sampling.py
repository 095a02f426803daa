"""Deterministic sampling, shuffling and thinning inside groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import index
from spanforge.operators.ordered import (
    KEYS,
    Oversize,
    find_oversize,
    first_rows,
    running_sum,
    with_position,
)


def draw_key(*parts: str | int, columns: Sequence[str]) -> Column:
    """The md5 that orders draws; the same on every run and in every engine."""
    return F.md5(F.concat_ws(":", *[F.lit(str(p)) for p in parts], *[F.col(c) for c in columns]))


def sample_per_group(
    df: DataFrame,
    n: int,
    seed: int,
    order: Sequence[Column],
    keys: Sequence[str] = KEYS,
    salt_columns: Sequence[str] = KEYS,
    item: str = "item_key",
) -> DataFrame:
    """n items per group without replacement, numbered in their original order.

    Adds ``n_items`` and 0-based ``orig_pos``. Groups are cut to n before the
    shuffle, so the later windows see at most n rows each.
    """
    # The last key differs most; sorts that begin with it seldom look at the others.
    keys = list(reversed(keys))
    drawn = first_rows(df, keys, [draw_key(seed, columns=[*salt_columns, item]), F.col(item)], n).drop("_rank")
    w = Window.partitionBy(*keys)
    return drawn.withColumns(
        {
            "n_items": F.count(F.lit(1)).over(w),
            "orig_pos": F.row_number().over(w.orderBy(*order)).cast("long") - 1,
        }
    )


def shuffle_per_group(
    sampled: DataFrame, seed: int, keys: Sequence[str] = KEYS, item: str = "item_key"
) -> DataFrame:
    """Add the 1-based display position; with ``orig_pos`` it is its own inverse map."""
    w = Window.partitionBy(*reversed(keys)).orderBy(draw_key("shuffle", seed, columns=[*KEYS, item]), item)
    return sampled.withColumn("display_pos", F.row_number().over(w).cast("long"))


def to_original(predictions: DataFrame, shuffled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Replace answered display labels by original positions."""
    back = shuffled.select(*keys, F.col("display_pos").alias("pred_id"), "orig_pos")
    return predictions.join(back, [*keys, "pred_id"])


def thin_uniform(df: DataFrame, k: Column, pos: str, n: str) -> DataFrame:
    """Keep k evenly spaced of n positions; everything when n <= k. Adds ``slot``."""
    slot = index.uniform_slot(F.col(pos), F.col(n), k)
    return df.withColumn("slot", slot).filter(F.col("slot").isNotNull())


def thin_stride(df: DataFrame, k: Column, pos: str, n: str, pad: bool = True) -> DataFrame:
    """Exactly k positions ``floor(i*n/k)``; short groups repeat their last row."""
    p, size = F.col(pos), F.col(n)
    tail = F.sequence(p, k - 1) if pad else F.array(p)
    slots = (
        F.when(size > k, F.array_compact(F.array(index.stride_slot(p, size, k))))
        .when(p < size - 1, F.array(p))
        .otherwise(tail)
    )
    return df.withColumn("slot", F.explode(slots))


def thin_truncate(df: DataFrame, k: Column, pos: str) -> DataFrame:
    """The first k positions."""
    return df.filter(F.col(pos) < k)


def global_cap(shots: DataFrame, limit: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Frames per shot when a group may show ``limit`` frames in all.

    Groups within the limit are kept whole; others give each shot the same share.
    """
    totals = shots.groupBy(*keys).agg(F.sum("n_sampled").alias("_total"), F.count(F.lit(1)).alias("_shots"))
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_shots"))).cast("long")
    take = F.when(F.col("_total") > limit, F.least("n_sampled", share)).otherwise(F.col("n_sampled"))
    return shots.join(totals, list(keys)).withColumn("take", take).drop("_total", "_shots")


def global_budget_truncate(
    shots: DataFrame, limit: int, keys: Sequence[str] = KEYS, over: Oversize | None = None
) -> DataFrame:
    """Fill shots in order until the budget is gone; every later shot keeps one frame."""
    summed = running_sum(shots, keys, [F.col("shot_idx")], {"_to": F.col("n_sampled")}, over)
    left = F.greatest(F.lit(1), F.lit(limit) - (F.col("_to") - F.col("n_sampled")))
    return summed.withColumn("take", F.least(F.col("n_sampled"), left).cast("long")).drop("_to")


def global_budget_share(shots: DataFrame, limit: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Split the budget in proportion to shot length, at least one frame each."""
    totals = shots.groupBy(*keys).agg(F.sum("n_sampled").alias("_total"))
    share = F.greatest(
        F.lit(1), index.half_even(F.col("n_sampled") / F.col("_total").cast("double") * F.lit(float(limit)))
    )
    take = F.when(F.col("_total") <= limit, F.col("n_sampled")).otherwise(F.least(F.col("n_sampled"), share))
    return shots.join(totals, list(keys)).withColumn("take", take.cast("long")).drop("_total")


def representatives(frames: DataFrame, shots: DataFrame, pct: float = 0.20) -> DataFrame:
    """Evenly spaced frames of every shot; an empty shot gives one row of score 0.

    ``frames`` carries ``shot_idx`` and ``shot_pos`` (0-based within the shot);
    ``shots`` lists every shot with ``n_sampled``.
    """
    k = F.greatest(F.lit(1).cast("long"), index.portion_ceil(pct, F.col("n_sampled")))
    joined = shots.select(*KEYS, "shot_idx", "n_sampled").join(
        frames.select(*KEYS, "shot_idx", "shot_pos", "pick", "gtscore"), [*KEYS, "shot_idx"], "left"
    )
    slot = F.when(F.col("n_sampled") == 0, F.lit(0).cast("long")).otherwise(
        index.uniform_slot(F.col("shot_pos"), F.col("n_sampled"), k)
    )
    return (
        joined.withColumn("slot", slot)
        .filter(F.col("slot").isNotNull())
        .select(
            *KEYS,
            "shot_idx",
            "slot",
            F.coalesce("pick", F.lit(-1)).alias("pick"),
            F.coalesce("gtscore", F.lit(0.0)).alias("gtscore"),
        )
    )


def topk_of_submitted(submitted: DataFrame, portion: float = 0.15, over: Oversize | None = None) -> DataFrame:
    """Mark the best ceil(portion * n) submitted rows, earlier rows first on ties."""
    over = over or find_oversize(submitted, KEYS)
    sizes = submitted.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    ranked = with_position(submitted, KEYS, [F.desc("gtscore"), F.col("pos")], "_rank", over)
    k = F.greatest(F.lit(1).cast("long"), index.portion_ceil(portion, F.col("_n")))
    marked = ranked.join(sizes, list(KEYS)).withColumn("is_gt", (F.col("_rank") < k).cast("int"))
    return marked.drop("_rank", "_n")


def dedup_keep_first(ids: Column, low: int | Column, high: Column, n: Column | None = None) -> Column:
    """Distinct in-range ids in order of first mention, cut to n."""
    kept = F.array_distinct(F.filter(ids, lambda x: (x >= low) & (x <= high)))
    return kept if n is None else F.slice(kept, F.lit(1), n.cast("int"))


def thirds(pos: Column, n: Column) -> Column:
    """FIRST, MIDDLE or LAST for a 0-based position."""
    return (
        F.when(pos < F.floor(n / 3), "first_third")
        .when(pos < F.floor(2 * n / 3), "middle_third")
        .otherwise("last_third")
    )


def batches_by_length(df: DataFrame, length: str, tie: Sequence[str], size: int) -> DataFrame:
    """Fixed-size batches of rows of similar length."""
    order = [F.col(length), *[F.col(c) for c in tie]]
    return with_position(df, [], order, "_p").withColumn("batch", F.floor(F.col("_p") / size).cast("long")).drop("_p")


def run_centers(votes: DataFrame, n: str, over: Oversize | None = None) -> DataFrame:
    """Centres of runs of consecutive selected frames, as a share of the length.

    ``votes`` holds the selected frames only: one row per (group, user, frame).
    """
    keys = [*KEYS, "user_id"]
    placed = with_position(votes, keys, [F.col("frame")], "_p", over)
    runs = placed.groupBy(*keys, (F.col("frame") - F.col("_p")).alias("_run")).agg(
        F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.max(n).alias(n)
    )
    center = (F.col("start") + F.col("stop")) / F.lit(2.0) / F.col(n)
    return runs.select(*keys, "start", "stop", center.alias("center"))


def stride_from_picks(frames: DataFrame, single: int = index.SINGLE_FRAME_STRIDE) -> DataFrame:
    """Distance of the first two picks of a group; a fixed value for one pick."""
    at = lambda i: F.max(F.when(F.col("step") == i, F.col("pick")))
    return frames.groupBy(*KEYS).agg(F.coalesce(at(1) - at(0), F.lit(single)).cast("long").alias("stride"))
