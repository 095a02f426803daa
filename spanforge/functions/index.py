"""Column functions for frame numbers and evenly spaced positions.

All spacing is done in doubles as ``i * step`` with the last point pinned; the
algebraically equal ``i * (n - 1) / (k - 1)`` lands on other integers for some sizes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pick distance when none is stored, stride of a one-frame video.
DEFAULT_PICK_DISTANCE = 15
SINGLE_FRAME_STRIDE = 30


def half_even(c: Column) -> Column:
    """Round half to even, as a long."""
    return F.bround(c.cast("double"), 0).cast("long")


def portion_floor(portion: float, n: Column) -> Column:
    return F.floor(F.lit(float(portion)) * n.cast("double")).cast("long")


def portion_ceil(portion: float, n: Column) -> Column:
    return F.ceil(n.cast("double") * F.lit(float(portion))).cast("long")


def linspace_point(i: Column, n: Column, k: Column) -> Column:
    """The i-th of k evenly spaced points on 0..n-1, as a double."""
    step = (n - 1).cast("double") / F.when(k > 1, (k - 1).cast("double"))
    return F.when(k == 1, F.lit(0.0)).when(i == k - 1, (n - 1).cast("double")).otherwise(i.cast("double") * step)


def uniform_slot(pos: Column, n: Column, k: Column) -> Column:
    """Which of k truncated evenly spaced points falls on ``pos``; NULL if none.

    For k < n every position is met at most once, so the slot is found next to
    ``pos / step`` and no join with the list of points is needed.
    """
    near = F.when(k > 1, F.ceil(pos.cast("double") * (k - 1).cast("double") / (n - 1).cast("double"))).otherwise(0)
    near = near.cast("long")
    tries = F.array(near - 1, near, near + 1)
    hit = F.filter(
        tries, lambda i: (i >= 0) & (i < k) & (F.floor(linspace_point(i, n, k)).cast("long") == pos)
    )
    return F.when(n <= k, pos).otherwise(F.get(hit, F.lit(0)))


def stride_slot(pos: Column, n: Column, k: Column) -> Column:
    """Which of the k positions ``floor(i * n / k)`` falls on ``pos``, for n > k."""
    near = F.ceil(pos.cast("double") * k.cast("double") / n.cast("double")).cast("long")
    tries = F.array(near - 1, near, near + 1)
    hit = F.filter(
        tries,
        lambda i: (i >= 0)
        & (i < k)
        & (F.floor((i * n).cast("double") / k.cast("double")).cast("long") == pos),
    )
    return F.get(hit, F.lit(0))


def shot_budget(n: Column, pct: float, low: int, high: int, at_most_n: bool = False) -> Column:
    """Frames shown for a shot of n frames, between ``low`` and ``high``."""
    k = F.greatest(F.lit(low).cast("long"), F.least(F.lit(high).cast("long"), half_even(n.cast("double") * F.lit(pct))))
    return F.least(k, n.cast("long")) if at_most_n else k


def frames_in_context(context: Column, text_budget: int, tokens_per_frame: Column) -> Column:
    """Frames that fit a model's context beside the text; unknown context = 32768."""
    context = F.coalesce(context, F.lit(32768))
    return F.greatest(F.lit(1), F.floor((context - text_budget) / tokens_per_frame)).cast("long")
