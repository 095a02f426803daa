"""Votes to scores, scores to segments, segments to a budgeted selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import index
from spanforge.operators import kernel_blocks
from spanforge.operators.bounded_choice import select_bounded
from spanforge.operators.kernel_blocks import STRIP, alone_limit, cut_tiles, gap_tiles, mass_of
from spanforge.operators.ordered import KEYS, Oversize, find_oversize, running_sum, with_position
from spanforge.operators.priced_cuts import gains, priced_cuts
from spanforge.session import checkpoint, row_limit

# Distances that may be sorted at once when the middle one is looked for.
SORTED_GAPS = 1 << 22
# Steps squared times segments up to which the full recursion is as fast as prices, and steps of a sequence that one task may cut by prices.
FULL_CUTS, PRICED_STEPS = 1_000_000_000, 65_536
# Items of one group that are packed into a row and folded there.
FOLD_ROWS = 20_000
# Value-curve cells kept at once for the exact choice, the longest full curve, and the longest list of undominated choices.
KEPT_CELLS = 1 << 22
CURVE_CELLS = 10_000_000
UNDOMINATED = 20_000_000


# ---- scores ----------------------------------------------------------------

def votes_to_score(
    picks: DataFrame, votes: DataFrame, users: DataFrame, step: str = "step", frame: str = "pick"
) -> DataFrame:
    """Share of users who picked each step; users without a pick count as 0.

    ``users`` has one row per (group, user). The picks x users grid is never
    built: positive votes are counted and divided by the number of users.
    """
    n_users = users.groupBy(*KEYS).agg(F.count_distinct("user_id").alias("_users"))
    cast = (
        votes.filter(F.col("selected") > 0)
        .select(*KEYS, "user_id", F.col("frame").alias(frame))
        .distinct()
        .groupBy(*KEYS, frame)
        .agg(F.count(F.lit(1)).alias("_votes"))
    )
    counted = picks.join(cast, [*KEYS, frame], "left").join(n_users, list(KEYS))
    score = F.coalesce(F.col("_votes"), F.lit(0)) / F.col("_users")
    return counted.select(*KEYS, step, frame, score.alias("gtscore"))


def project_votes(picks: DataFrame, votes: DataFrame, n_frames: DataFrame) -> DataFrame:
    """Selected original frames as steps.

    Picks beyond the annotated length are dropped and the kept ones move up; the
    freed steps at the end stay unselected. Only selected (user, step) rows return.
    """
    valid = picks.join(n_frames, list(KEYS)).filter(F.col("pick") < F.col("n_frames"))
    packed = with_position(valid, KEYS, [F.col("step")], "packed_step")
    chosen = votes.filter(F.col("selected") > 0).select(*KEYS, "user_id", F.col("frame").alias("pick"))
    return packed.join(chosen, [*KEYS, "pick"]).select(*KEYS, "user_id", F.col("packed_step").alias("step"))


# ---- segments --------------------------------------------------------------

def with_group_size(df: DataFrame, name: str, over: Oversize | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Add the group size: a window beside ordinary groups, a join for oversize ones."""
    over = over or find_oversize(df, keys)
    if over.empty:
        return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), list(keys))


def with_group_total(
    df: DataFrame, value: str, name: str, over: Oversize | None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add the group's sum of an integer column, in the same way."""
    over = over or find_oversize(df, keys)
    if over.empty:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys)))
    return df.join(df.groupBy(*keys).agg(F.sum(value).alias(name)), list(keys))


def segment_uniform(
    frames: DataFrame, steps_per_segment: int = 10, over: Oversize | None = None
) -> DataFrame:
    """Equal blocks; the last one takes the rest. Adds ``n_steps`` and ``shot_idx``."""
    sized = with_group_size(frames, "n_steps", over)
    n_segments = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_steps") / steps_per_segment))
    size = F.floor(F.col("n_steps") / n_segments)
    return sized.withColumn("shot_idx", F.least(F.floor(F.col("step") / size), n_segments - 1).cast("long"))


def segment_score(frames: DataFrame, segments: DataFrame, at: str = "step") -> DataFrame:
    """Mean score and length of given segments; an empty one scores 0 with length 1."""
    from spanforge.operators.joins import interval_hits

    hits = interval_hits(segments, frames.select(*KEYS, at, "gtscore"), at)
    found = hits.groupBy(*KEYS, "shot_idx").agg(F.avg("gtscore").alias("score"), F.count(at).alias("length"))
    out = segments.select(*KEYS, "shot_idx").join(found, [*KEYS, "shot_idx"], "left")
    return out.select(
        *KEYS,
        "shot_idx",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.greatest(F.coalesce("length", F.lit(0)), F.lit(1)).cast("long").alias("length"),
    )


def kernel_sum(x: np.ndarray, sigma: float) -> float:
    """Sum of the Gaussian kernel over all pairs of rows, in tiles."""
    return mass_of(cut_tiles(x), None, sigma)


def _gap_strips(x: np.ndarray) -> Iterator[np.ndarray]:
    """Non-zero distances of all pairs, one tile of the triangle at a time."""
    return gap_tiles(cut_tiles(x))


def _median_gap(x: np.ndarray) -> float:
    """Exact median of the non-zero distances; 1 if there is none.

    Positive doubles sort like their bits, so the middle is found digit by digit: every pass counts the next 16 bits
    of the distances that are still candidates, until few enough are left to be sorted.
    """
    low, high, shift, below = 0, 0xFFFF, 48, 0
    total = None
    while True:
        counts = np.zeros(high - low + 1, np.int64)
        for gaps in _gap_strips(x):
            digits = (gaps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) - low
            counts += np.bincount(digits[(digits >= 0) & (digits < len(counts))], minlength=len(counts))
        if total is None:
            total = int(counts.sum())
            if total == 0:
                return 1.0
        ends = below + np.cumsum(counts)
        first, last = (int(np.searchsorted(ends, r, side="right")) for r in ((total - 1) // 2, total // 2))
        if first != last or shift == 0 or counts[first] <= SORTED_GAPS:
            break
        below = int(ends[first] - counts[first])
        low, high, shift = (low + first) << 16, ((low + first) << 16) + 0xFFFF, shift - 16
    below = int(ends[first] - counts[first])
    kept = []
    for gaps in _gap_strips(x):
        digits = (gaps.view(np.uint64) >> np.uint64(shift)).astype(np.int64) - low
        kept.append(gaps[(digits == first) | (digits == last)])
    kept = np.concatenate(kept)
    spots = [(total - 1) // 2 - below, total // 2 - below - int(counts[first + 1 : last].sum())]
    kept.partition(spots)
    return float((kept[spots[0]] + kept[spots[1]]) / 2)


def median_bandwidth(frames: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Median non-zero distance between the vectors of a group, over all pairs.

    Pairs are looked at in tiles inside a task and never become rows; a group above ``kernel_blocks.ALONE`` rows is spread over
    tasks of two blocks of vectors, with the same result. With ``sample`` only so
    many steps of a group are drawn, in md5 order and before the shuffle.
    """
    from spanforge.operators.sampling import draw_key

    own = frames.select(*KEYS, "step", "feature")
    if sample is not None:
        w = Window.partitionBy(*KEYS).orderBy(draw_key(seed, columns=[*KEYS, "step"]), "step")
        own = own.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= sample)

    own = own.select(*KEYS, "step", "feature")
    over = find_oversize(own, KEYS, alone_limit(own.sparkSession))
    rest, big = over.split(own, KEYS)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(group.sort_values("step")["feature"].to_numpy()).astype("float64")
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in KEYS}, "sigma": [_median_gap(x)]})

    out = None
    if rest is not None:
        out = rest.groupBy(*KEYS).applyInPandas(one, "dataset string, video_id string, sigma double")
    if big is not None:
        spread = kernel_blocks.median_gap_by_blocks(big, over)
        out = spread if out is None else out.unionByName(spread)
    return out


def best_cuts(x: np.ndarray, sigma: float, n_segments: int, min_len: int = 1) -> list[int]:
    """Starts of the segments that maximize the sum of kernel mass over length.

    Quadratic in time for each number of segments, by definition; the memory is steps times segments.
    """
    n = len(x)
    best = np.full((n_segments, n + 1), -np.inf)
    origin = np.zeros((n_segments, n + 1), dtype=np.int32)
    for end, gain in gains(x, sigma):
        usable = end - min_len + 1
        if usable <= 0:
            continue
        best[0, end] = gain[0]
        for k in range(1, n_segments, 64):  # some numbers of segments at a time
            through = best[k - 1 : min(k + 63, n_segments - 1), :usable] + gain[:usable]
            at = through.argmax(axis=1)
            origin[k : k + len(at), end] = at
            best[k : k + len(at), end] = through[np.arange(len(at)), at]
    cuts, end = [], n
    for k in range(n_segments - 1, 0, -1):
        end = int(origin[k, end])
        cuts.append(end)
    return [0, *reversed(cuts)]


def _cuts(x: np.ndarray, sigma: float, n_segments: int, min_len: int, full: bool) -> list[int] | None:
    """The starts of :func:`best_cuts`; without ``full``, None where prices leave too many segments open."""
    small = n_segments * len(x) ** 2 <= FULL_CUTS
    starts = None if full and small else priced_cuts(x, sigma, n_segments, min_len)
    return best_cuts(x, sigma, n_segments, min_len) if full and starts is None else starts


def segment_by_kernel(
    frames: DataFrame, steps_per_segment: int = 10, min_len: int = 1, block: int | None = None
) -> DataFrame:
    """Change points of vector sequences; inclusive [start, end] per segment.

    Sequences of any length are solved as one. Those above ``kernel_blocks.ALONE`` steps have a task of their own up to ``PRICED_STEPS``; longer
    ones, and those that prices leave undecided, are solved by blocks over several tasks. Only where
    the caller asks for ``block`` are cuts forced at every so many steps.
    """
    spark = frames.sparkSession
    sized = frames.select(*KEYS, "step", "feature").join(median_bandwidth(frames), list(KEYS))
    part = F.lit(0) if block is None else F.floor(F.col("step") / block)
    sized = sized.withColumn("block", part.cast("long"))
    parts = [*KEYS, "block"]
    over = find_oversize(sized, parts, alone_limit(spark))
    sized, big = over.split(sized, parts)

    def solver(full: bool):
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("step")
            x = np.stack(group["feature"].to_numpy()).astype("float64")
            n, fixed = len(x), {k: group[k].iloc[0] for k in parts}
            starts = _cuts(x, float(group["sigma"].iloc[0]), max(1, min(n // steps_per_segment, n // min_len)), min_len, full)
            if starts is None:
                return pd.DataFrame({**fixed, "start": [-1], "end": [-1]})
            base = int(group["step"].iloc[0])
            return pd.DataFrame({**fixed, "start": np.array(starts) + base, "end": np.array([*starts[1:], n]) - 1 + base})

        return one

    schema = "dataset string, video_id string, block long, start long, end long"
    pieces = None
    if sized is not None:
        pieces = sized.groupBy(*parts).applyInPandas(solver(True), schema).drop("block")
    if big is not None:
        longest = find_oversize(big, parts, max(over.limit, min(PRICED_STEPS, row_limit(spark))))
        priced, big = longest.split(big, parts)
        if priced is not None:
            # Ranges of groups, so that no two long ones wait for each other in one task.
            apart = priced.repartitionByRange(min(4 * over.n_groups, 2_000), *parts)
            solved = checkpoint(apart.groupBy(*parts).applyInPandas(solver(False), schema))
            undecided = solved.filter("start < 0").select(*parts)
            if not undecided.isEmpty():
                left = priced.join(undecided, parts, "left_semi")
                big = left if big is None else big.unionByName(left)
            solved = solved.filter("start >= 0").drop("block")
            pieces = solved if pieces is None else pieces.unionByName(solved)
    if big is not None:
        # Forced blocks are sequences of their own, named apart while they are solved.
        apart = F.concat_ws("#", F.col("block"), F.col("video_id"))
        named = big.withColumn("video_id", apart)
        base = named.groupBy(*KEYS).agg(F.min("step").alias("_base"))
        cut = kernel_blocks.cuts_by_blocks(named.drop("block"), steps_per_segment, min_len, find_oversize(named, KEYS))
        cut = cut.join(base, list(KEYS)).select(
            "dataset",
            F.expr("substring(video_id, instr(video_id, '#') + 1)").alias("video_id"),
            (F.col("start") + F.col("_base")).alias("start"),
            (F.col("end") + F.col("_base")).alias("end"),
        )
        pieces = cut if pieces is None else pieces.unionByName(cut)
    return with_position(pieces, KEYS, [F.col("start")], "shot_idx")


def segment_kernel_mass(frames: DataFrame, shots_per_task: int = 64) -> DataFrame:
    """Kernel mass over length of given segments: all frame pairs inside a segment.

    ``frames`` carries ``shot_idx``, ``feature`` and ``sigma``. Pairs live inside tiles of a
    matrix product and are never emitted as rows; a segment above ``kernel_blocks.ALONE`` rows is many tasks.
    """
    shots = [*KEYS, "shot_idx"]
    over = find_oversize(frames, shots, alone_limit(frames.sparkSession))
    frames, big = over.split(frames, shots)
    spread = None if big is None else kernel_blocks.mass_by_blocks(big, over)
    if frames is None:
        return spread
    cut = frames.withColumn("_part", F.floor(F.col("shot_idx") / shots_per_task).cast("long"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for shot, part in group.groupby("shot_idx"):
            x = np.stack(part["feature"].to_numpy()).astype("float64")
            mass = kernel_sum(x, float(part["sigma"].iloc[0]))
            rows.append((*[part[k].iloc[0] for k in KEYS], int(shot), len(x), float(mass / len(x))))
        return pd.DataFrame(rows, columns=[*KEYS, "shot_idx", "length", "mass"])

    out = cut.select(*KEYS, "_part", "shot_idx", "feature", "sigma").groupBy(*KEYS, "_part").applyInPandas(
        one, "dataset string, video_id string, shot_idx long, length long, mass double"
    )
    return out if spread is None else out.unionByName(spread)


# ---- budgeted selection ----------------------------------------------------

def fold_limit(spark: SparkSession) -> int:
    return min(FOLD_ROWS, row_limit(spark))


def _best_subset(weights: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """0/1 choice of maximal value; of equal choices the later item stays out.

    The best value for every capacity is a step function. Short ones are kept as full curves, long ones as lists of the
    weights at which they rise; both give the same choice. Only every s-th function is kept and those between
    are redone on the way back, so memory grows with the square root of the item count.
    """
    n = len(weights)
    chosen = np.zeros(n, dtype=bool)
    capacity = min(int(capacity), int(weights.sum())) if n else 0
    if capacity <= 0:
        return chosen
    unit = int(np.gcd.reduce(weights[weights > 0]))
    weights, capacity = weights // unit, capacity // unit
    full = capacity < CURVE_CELLS
    add = _add_item if full else lambda steps, w, v: _add_step(steps, w, v, capacity)
    at = (lambda c, left: c[left]) if full else lambda c, left: c[1][np.searchsorted(c[0], left, side="right") - 1]
    cells = n * (capacity + 1) if full else 1 << 62
    stride = n if cells <= KEPT_CELLS else max(1, int(np.sqrt(n)))
    curve = np.zeros(capacity + 1) if full else (np.zeros(1, np.int64), np.zeros(1))
    kept, rows = {}, [curve]
    for i in range(n):
        if i % stride == 0:
            kept[i], rows = curve, [curve]
        curve = add(curve, weights[i], values[i])
        rows.append(curve)
    left = capacity
    for base in sorted(kept, reverse=True):
        stop = min(base + stride, n)
        if stop < n:
            rows = [kept[base]]
            for i in range(base, stop):
                rows.append(add(rows[-1], weights[i], values[i]))
        for i in range(stop - 1, base - 1, -1):
            if at(rows[i - base + 1], left) != at(rows[i - base], left):
                chosen[i] = True
                left -= int(weights[i])
    return chosen


def _add_item(curve: np.ndarray, weight: int, value: float) -> np.ndarray:
    after = curve.copy()
    if weight < len(curve):
        np.maximum(curve[weight:], curve[: len(curve) - weight] + value, out=after[weight:])
    return after


def _add_step(steps: tuple[np.ndarray, np.ndarray], weight: int, value: float, capacity: int):
    """The list of (weight, value) pairs that no lighter pair beats, with one more item."""
    fits = steps[0] <= capacity - weight
    w = np.concatenate([steps[0], steps[0][fits] + weight])
    v = np.concatenate([steps[1], steps[1][fits] + value])
    order = np.lexsort((-v, w))
    w, v = w[order], v[order]
    rises = np.append(True, v[1:] > np.maximum.accumulate(v)[:-1])
    if rises.sum() > UNDOMINATED:
        raise ValueError(f"more than {UNDOMINATED} undominated choices: this group can't be solved exactly")
    return w[rises], v[rises]


def exact_ids(items: str, weights: str, values: str, capacity: str) -> Column:
    """Chosen ids of one group's arrays; rows of many groups share an Arrow batch."""

    def choose(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for ids, w, v, cap in batches:
            rows = zip(ids, w, v, cap, strict=True)
            yield pd.Series(
                [
                    np.asarray(i)[_best_subset(np.asarray(x, "int64"), np.asarray(y, "float64"), int(c))].tolist()
                    for i, x, y, c in rows
                ]
            )

    udf = F.pandas_udf(choose, "array<bigint>")
    return udf(items, weights, values, capacity)


def _in_one_row(items: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(item, "weight", "value")))
    return items.groupBy(*keys).agg(F.first("capacity").alias("capacity"), packed.alias("_items"))


def select_under_budget(
    items: DataFrame, keys: Sequence[str] = KEYS, item: str = "shot_idx", over: Oversize | None = None, values: bool = False
) -> DataFrame:
    """Exact 0/1 selection per group: the chosen (group, item) rows, with their ``weight`` and ``value`` if ``values``.

    ``items`` has integer ``weight``, ``value`` and the group's ``capacity``. In an oversize
    group bounds decide most items by running sums, and what is left is solved in one task: see
    :func:`spanforge.operators.bounded_choice.select_bounded`. Groups whose undecided items are too many stop
    with an error; they never get another algorithm. A group with no capacity gets nothing.
    """
    over = over or find_oversize(items, keys, fold_limit(items.sparkSession))
    rest, big = over.split(items, keys)
    spread = None if big is None else select_bounded(big, keys, item, over)
    if spread is not None and values:
        spread = big.select(*keys, item, "weight", "value").join(spread, [*keys, item])
    if rest is None:
        return spread
    rows = _in_one_row(rest.select(*keys, item, "weight", "value", "capacity"), keys, item)
    chosen = exact_ids(f"_items.{item}", "_items.weight", "_items.value", "capacity")
    if values:
        held = F.filter("_items", lambda x: F.array_contains("_chosen", x[item]))
        out = rows.withColumn("_chosen", chosen).select(*keys, F.explode(held).alias("_x")).select(*keys, "_x.*")
    else:
        out = rows.select(*keys, F.explode(chosen).alias(item))
    return out if spread is None else out.unionByName(spread)


def _efficiency(value: Column, weight: Column) -> Column:
    # Fixed value: the guard added to the weight before dividing.
    return value / (weight + F.lit(1e-8))


def greedy_ids(items: Column, capacity: Column) -> Column:
    """Ids taken from one group's array of (i, w, v), best value per weight first."""
    keyed = F.transform(
        items, lambda x: F.struct(_efficiency(x["v"], x["w"]).alias("e"), x["i"].alias("i"), x["w"].alias("w"))
    )
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def take(state: Column, row: Column) -> Column:
        used = state["used"] + row["w"]
        grown = F.struct(used.alias("used"), F.concat(state["ids"], F.array(row["i"])).alias("ids"))
        return F.when(used <= capacity, grown).otherwise(state)

    return F.aggregate(F.sort_array(keyed, asc=False), start, take, lambda s: s["ids"])


def select_greedy(
    items: DataFrame, keys: Sequence[str] = KEYS, item: str = "shot_idx", over: Oversize | None = None
) -> DataFrame:
    """Take items by value per weight while they fit; skip the ones that do not.

    Ordinary groups are folded inside the JVM. Oversize groups go through
    :func:`_greedy_rounds`.
    """
    over = over or find_oversize(items, keys, fold_limit(items.sparkSession))
    rest, big = over.split(items.filter(F.col("capacity") > 0), keys)
    out = None
    if rest is not None:
        out = _fold_greedy(rest, keys, item)
    if big is not None:
        picked = _greedy_rounds(big.select(*keys, item, "weight", "value", "capacity"), keys, item, over)
        out = picked if out is None else out.unionByName(picked)
    return out


def _fold_greedy(items: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    row = F.struct(F.col(item).alias("i"), F.col("weight").alias("w"), F.col("value").alias("v"))
    packed = items.groupBy(*keys).agg(F.first("capacity").alias("capacity"), F.collect_list(row).alias("_items"))
    return packed.select(*keys, F.explode(greedy_ids(F.col("_items"), F.col("capacity"))).alias(item))


def _greedy_rounds(items: DataFrame, keys: Sequence[str], item: str, over: Oversize) -> DataFrame:
    """The greedy rule for groups too large to fold.

    In the best-first order every item up to the first that does not fit is
    taken at once, by a distributed running sum. What is left of the group is
    what comes after that item, still fits the remaining capacity and can still be reached; it goes into the next
    round, or is folded as soon as it is small. Each round shrinks the capacity below the item that blocked it.
    """
    order = [F.desc("_e"), F.desc(item)]
    limit = over.limit
    work = items.withColumn("_e", _efficiency(F.col("value"), F.col("weight"))).filter(F.col("weight") <= F.col("capacity"))
    taken: list[DataFrame] = []
    while True:
        summed = running_sum(work, keys, order, {"_to": F.col("weight")}, over)
        summed = checkpoint(summed)
        blocked = summed.filter(F.col("_to") > F.col("capacity"))
        stop = blocked.groupBy(*keys).agg(
            F.max(F.struct("_e", F.col(item).alias("_i"))).alias("_stop")
        )
        fit = summed.filter(F.col("_to") <= F.col("capacity"))
        taken.append(fit.select(*keys, item))
        used = fit.groupBy(*keys).agg(F.sum("weight").alias("_used"))
        rest = (
            blocked.join(stop, list(keys))
            .filter(F.struct("_e", F.col(item).alias("_i")) < F.col("_stop"))
            .join(used, list(keys), "left")
            .withColumn("capacity", F.col("capacity") - F.coalesce("_used", F.lit(0)))
            .filter(F.col("weight") <= F.col("capacity"))
            .select(*items.columns, "_e")
        )
        # The rule takes a prefix of the items of one weight, of at most floor(capacity / weight) of them.
        placed = with_position(rest, [*keys, "weight"], order, "_r")
        work = checkpoint(placed.filter((F.col("_r") + 1) * F.col("weight") <= F.col("capacity")).drop("_r"))
        over = find_oversize(work, keys, limit)
        if over.empty:
            taken.append(_fold_greedy(work, keys, item))
            break
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out


def force_best_if_empty(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Where a group selected nothing and has positive scores, take its first best segment.

    ``scored`` has ``shot_idx``, ``score`` and 0/1 ``selected``. The group facts are plain
    aggregates, so no group is gathered.
    """
    facts = scored.groupBy(*keys).agg(
        F.sum("selected").alias("_k"),
        F.sum("score").alias("_s"),
        F.max(F.struct("score", (-F.col("shot_idx")).alias("_i"))).alias("_best"),
    )
    forced = (F.col("_k") == 0) & (F.col("_s") > 0) & (F.col("shot_idx") == -F.col("_best._i"))
    out = scored.join(facts, list(keys))
    return out.withColumn("selected", F.when(forced, 1).otherwise(F.col("selected"))).drop("_k", "_s", "_best")


# ---- key frames ------------------------------------------------------------

def topk_frames(frames: DataFrame, portion: float = 0.15, over: Oversize | None = None) -> DataFrame:
    """Add 0/1 ``gtframe`` for the best share of steps, later steps first on ties."""
    over = over or find_oversize(frames, KEYS)
    sized = with_group_size(frames, "n_steps", over)
    ranked = with_position(sized, KEYS, [F.desc("gtscore"), F.desc("step")], "_rank", over)
    k = F.greatest(F.lit(1).cast("long"), index.half_even(F.col("n_steps").cast("double") * F.lit(float(portion))))
    k = F.least(k, F.col("n_steps"))
    return ranked.withColumn("gtframe", (F.col("_rank") < k).cast("int")).drop("_rank")


def argmax_per_shot(shot_frames: DataFrame) -> DataFrame:
    """The best step of each shot, lowest step on ties."""
    best = F.max(F.struct("gtscore", (-F.col("step")).alias("_s")))
    return shot_frames.groupBy(*KEYS, "shot_idx").agg(best.alias("_b")).select(
        *KEYS, "shot_idx", (-F.col("_b._s")).alias("step"), F.col("_b.gtscore").alias("gtscore")
    )


def _flag_in_one_row(segments: DataFrame, exact: bool) -> DataFrame:
    """Choose inside one row per ordinary group: no join back, no further shuffle."""
    fields = [c for c in segments.columns if c not in (*KEYS, "capacity")]
    row = segments.groupBy(*KEYS).agg(
        F.first("capacity").alias("capacity"), F.sort_array(F.collect_list(F.struct("shot_idx", *fields[1:]))).alias("_g")
    )
    if exact:
        ids = exact_ids("_g.shot_idx", "_g.weight", "_g.score", "capacity")
    else:
        items = F.transform(
            "_g", lambda x: F.struct(x["shot_idx"].alias("i"), x["weight"].alias("w"), x["score"].alias("v"))
        )
        ids = greedy_ids(items, F.col("capacity"))
    best = F.array_max(F.transform("_g", lambda x: F.struct(x["score"].alias("s"), (-x["shot_idx"]).alias("i"))))
    total = F.aggregate("_g", F.lit(0.0), lambda a, x: a + x["score"])
    row = row.withColumn("_ids", ids)
    row = row.withColumn(
        "_ids", F.when((F.size("_ids") == 0) & (total > 0), F.array(-best["i"])).otherwise(F.col("_ids"))
    )
    out = row.select(*KEYS, "_ids", F.explode("_g").alias("_x")).select(*KEYS, "_ids", "_x.*")
    return out.withColumn("selected", F.array_contains("_ids", F.col("shot_idx")).cast("int"))


def annotation_limit(spark: SparkSession) -> int:
    """Steps of a group whose ten-step segments still fold in one row."""
    return min(10 * FOLD_ROWS, row_limit(spark))


def annotate_ground_truth(
    frames: DataFrame, portion: float = 0.15, exact: bool = False, over: Oversize | None = None
) -> DataFrame:
    """Segments of every sequence with score, selection flag and key frame.

    ``frames`` has ``step``, ``pick`` and ``gtscore``. One row per segment: ``start``/``end`` in steps,
    ``start_pick``/``end_pick`` in original frames, ``selected`` and ``key_pick`` (selected
    segments only). While no group is oversize, every stage reuses the exchange of the frames.
    """
    over = over or find_oversize(frames, KEYS, annotation_limit(frames.sparkSession))
    cut = segment_uniform(frames, over=over)
    segments = cut.groupBy(*KEYS, "shot_idx").agg(
        F.min("step").alias("start"),
        F.max("step").alias("end"),
        F.min("pick").alias("start_pick"),
        F.max("pick").alias("end_pick"),
        F.count(F.lit(1)).alias("weight"),
        F.avg("gtscore").alias("score"),
        F.max("n_steps").alias("n_steps"),
        F.max(F.struct("gtscore", (-F.col("step")).alias("s"), F.col("pick").alias("p"))).alias("_peak"),
    )
    capacity = index.portion_floor(portion, F.col("n_steps"))
    if over.empty:
        flagged = _flag_in_one_row(segments.withColumn("capacity", capacity), exact)
    else:
        items = segments.select(
            *KEYS, "shot_idx", "weight", F.col("score").alias("value"), capacity.alias("capacity")
        )
        pick = select_under_budget if exact else select_greedy
        chosen = pick(items, over=over).withColumn("selected", F.lit(1))
        flagged = segments.join(chosen, [*KEYS, "shot_idx"], "left")
        flagged = force_best_if_empty(flagged.withColumn("selected", F.coalesce("selected", F.lit(0))))
    return flagged.select(
        *KEYS,
        "shot_idx",
        "start",
        "end",
        "start_pick",
        "end_pick",
        F.col("weight").alias("n_sampled"),
        "score",
        "selected",
        F.when(F.col("selected") == 1, F.col("_peak.p")).alias("key_pick"),
    )
