"""Joins of sequences, segments, sentences and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators.ordered import (
    KEYS,
    Oversize,
    carry_forward,
    find_oversize,
    running_sum,
    with_position,
)
from spanforge.session import BROADCAST_BYTES, BROADCAST_ROWS


# Items of a sampled task whose pairs may be spelled out.
MAX_PAIRED = 64


def fits_broadcast(side: DataFrame) -> bool:
    """Whether a side has few rows and few bytes; no more than the rows allowed are looked at."""
    size = F.octet_length(F.to_json(F.struct(*side.columns)))
    rows, used = side.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and used <= BROADCAST_BYTES


def lookup_join(
    rows: DataFrame,
    videos: DataFrame,
    keys: Sequence[str] = KEYS,
    default: dict[str, Column] | None = None,
    small: bool = False,
) -> DataFrame:
    """Attach the one matching row of ``videos``.

    Without defaults unmatched rows are dropped. ``small`` asks for a broadcast, granted only
    after rows and bytes of the side have been counted.
    """
    if small and fits_broadcast(videos):
        videos = F.broadcast(videos)
    if default is None:
        return rows.join(videos, list(keys))
    joined = rows.join(videos, list(keys), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) for c, v in default.items()})


def positional_join(
    left: DataFrame, right: DataFrame, left_order: Sequence[Column], right_order: Sequence[Column]
) -> DataFrame:
    """Zip two ordered tables per group, stopping at the shorter one."""
    a = with_position(left, KEYS, left_order, "pos")
    b = with_position(right, KEYS, right_order, "pos")
    return a.join(b, [*KEYS, "pos"])


def interval_hits(segments: DataFrame, points: DataFrame, at: str, width: int = 64) -> DataFrame:
    """(group, shot_idx) with every point for which ``start <= at <= end``.

    The equality is on (group, level, bucket), so a single group spreads over many tasks and never meets all its points at
    once. Buckets of level 0 have ``width`` numbers, those of each further level eight times as many; a segment takes the
    level at which it touches at most five buckets, however long it is. Points have a row for each level that some segment
    takes, normally one. A width near the mean length of a segment keeps the points of a bucket few.
    """
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0)) + 1
    level = F.greatest(F.ceil(F.log2(length / F.lit(4.0 * width)) / 3), F.lit(0)).cast("int")
    bucket = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(8.0), F.col("_level")))).cast("long")
    levelled = segments.select(*KEYS, "shot_idx", "start", "end").withColumn("_level", level)
    levels = levelled.agg(F.collect_set("_level")).scalar()
    spread = levelled.withColumn(
        "_b", F.explode(F.when(F.col("end") >= F.col("start"), F.sequence(bucket("start"), bucket("end"))).otherwise(F.array(bucket("start"))))
    )
    placed = points.withColumn("_level", F.explode(levels)).withColumn("_b", bucket(at))
    return spread.join(placed, [*KEYS, "_level", "_b"]).filter((F.col(at) >= F.col("start")) & (F.col(at) <= F.col("end"))).drop(
        "_level", "_b", "start", "end"
    )


def interval_join(segments: DataFrame, points: DataFrame, at: str, width: int = 64) -> DataFrame:
    """Segments with their :func:`interval_hits`; empty segments stay."""
    return segments.join(interval_hits(segments, points, at, width), [*KEYS, "shot_idx"], "left")


def count_per_shot(segments: DataFrame, picks: DataFrame) -> DataFrame:
    """Number of sampled frames per segment, zero for empty ones; hits are counted before they meet the segments again."""
    spans = segments.select(*KEYS, "shot_idx", "start", "end")
    counted = interval_hits(spans, picks.select(*KEYS, "pick"), "pick").groupBy(*KEYS, "shot_idx").agg(F.count(F.lit(1)).alias("n"))
    out = spans.select(*KEYS, "shot_idx").join(counted, [*KEYS, "shot_idx"], "left")
    return out.select(*KEYS, "shot_idx", F.coalesce("n", F.lit(0)).cast("long").alias("n_sampled"))


def position_to_shot(
    positions: DataFrame, shots: DataFrame, over: Oversize | None = None, width: int = 64
) -> DataFrame:
    """1-based frame positions to the distinct shots that hold them."""
    summed = running_sum(shots, KEYS, [F.col("shot_idx")], {"_hi": F.col("n_sampled")}, over)
    spans = summed.filter(F.col("n_sampled") > 0).select(
        *KEYS,
        "shot_idx",
        (F.col("_hi") - F.col("n_sampled")).alias("start"),
        (F.col("_hi") - 1).alias("end"),
    )
    wanted = positions.select(*KEYS, (F.col("pos") - 1).alias("at")).distinct()
    hit = interval_hits(spans, wanted, "at", width)
    return hit.select(*KEYS, "shot_idx").distinct()


def representative_shots(positions: DataFrame, n_shots: DataFrame) -> DataFrame:
    """Answered frames where every shot shows one frame: frame i stands for shot i - 1, in range and once.

    ``n_shots`` has one row per group with ``n_shots``.
    """
    shot = positions.select(*KEYS, (F.col("pos") - 1).alias("shot_idx")).distinct()
    inside = shot.join(n_shots, list(KEYS)).filter((F.col("shot_idx") >= 0) & (F.col("shot_idx") < F.col("n_shots")))
    return inside.select(*KEYS, "shot_idx")


def band_semi_join(picks: DataFrame, selected: DataFrame, tolerance: int = 15) -> DataFrame:
    """Picks with any selected frame within ``tolerance``, per user.

    Frames fall into buckets of the tolerance; a pick looks in three buckets, so the join
    stays an equi-join of bounded fan-out. Repeated selections fall together with the hits, once, and are
    not made distinct before: that would keep all selections of a task in memory again.
    """
    bucket = F.floor(F.col("frame") / tolerance)
    sel = selected.select(*KEYS, "user_id", "frame", bucket.alias("_b"))
    home = F.floor(F.col("pick") / tolerance)
    near = picks.select(*KEYS, "step", "pick", F.explode(F.array(home - 1, home, home + 1)).alias("_b"))
    return (
        near.join(sel, [*KEYS, "_b"])
        .filter(F.abs(F.col("pick") - F.col("frame")) <= tolerance)
        .select(*KEYS, "user_id", "step", "pick")
        .distinct()
    )


def overlap_join(summaries: DataFrame, documents: DataFrame) -> DataFrame:
    """Summary and document sentences sharing a shot; ``doc_id`` NULL without a match."""
    left = summaries.select(*KEYS, F.col("sentence_id"), F.explode_outer("shot_ids").alias("shot"))
    right = documents.select(*KEYS, F.col("sentence_id").alias("doc_id"), F.explode("shot_ids").alias("shot"))
    pairs = left.join(right, [*KEYS, "shot"]).select(*KEYS, "sentence_id", "doc_id").distinct()
    return summaries.select(*KEYS, "sentence_id").join(pairs, [*KEYS, "sentence_id"], "left")


def first_match_join(rows: DataFrame, candidates: DataFrame, on: Sequence[str], order: str, value: str) -> DataFrame:
    """Attach ``value`` of the first candidate per key; NULL where there is none."""
    first = candidates.groupBy(*on).agg(F.min_by(value, order).alias(value))
    return rows.join(first, list(on), "left")


def subset_semi_join(full: DataFrame, subset: DataFrame, on: Sequence[str]) -> DataFrame:
    """Every row of ``full`` with a 0/1 ``in_subset`` flag."""
    member = subset.select(*on).distinct().withColumn("_m", F.lit(1))
    return full.join(member, list(on), "left").withColumn("in_subset", F.coalesce("_m", F.lit(0))).drop("_m")


def pending_anti_join(todo: DataFrame, done: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return todo.join(done, list(keys), "left_anti")


def pair_rows(sampled: DataFrame) -> DataFrame:
    """All i < j pairs of a sampled task in combination order.

    ``sampled`` comes from ``sample_per_group``, so a group holds a handful of items: a
    group becomes one row and its pairs are spelled from two loops over that array. A
    group of more than ``MAX_PAIRED`` items stops with an error.
    """
    one = sampled.groupBy(*KEYS).agg(
        F.sort_array(F.collect_list(F.struct("orig_pos", "item_key", "score"))).alias("_x")
    )
    many = F.concat(F.lit("too many items for pairs in group "), *[F.concat(F.col(k), F.lit(" ")) for k in KEYS])
    one = one.withColumn("_x", F.when(F.size("_x") > MAX_PAIRED, F.raise_error(many).cast(one.schema["_x"].dataType)).otherwise(F.col("_x")))
    pairs = F.flatten(
        F.transform(
            F.col("_x"),
            lambda a: F.transform(
                F.filter(F.col("_x"), lambda b: b["orig_pos"] > a["orig_pos"]),
                lambda b: F.struct(a.alias("a"), b.alias("b")),
            ),
        )
    )
    return one.select(*KEYS, F.posexplode(pairs).alias("pair_idx", "_p")).select(
        *KEYS,
        F.col("pair_idx").cast("long"),
        F.col("_p.a.orig_pos").alias("i"),
        F.col("_p.b.orig_pos").alias("j"),
        F.col("_p.a.item_key").alias("item_i"),
        F.col("_p.b.item_key").alias("item_j"),
        F.col("_p.a.score").alias("score_i"),
        F.col("_p.b.score").alias("score_j"),
    )


def chain_join(sentence_docs: DataFrame, doc_clips: DataFrame) -> DataFrame:
    """Distinct clips reached from each sentence through its documents."""
    return sentence_docs.join(doc_clips, [*KEYS, "doc_id"]).select(*KEYS, "sentence_id", "clip_id").distinct()


def nearest_valid_fill(frames: DataFrame, over: Oversize | None = None) -> DataFrame:
    """Bad captions take the nearest good one, the earlier on equal distance.

    ``status`` 0 is good. Rows of a group without any good caption get a fixed text.
    """
    over = over or find_oversize(frames, KEYS)
    good = F.when(F.col("status") == 0, F.struct("step", "description"))
    d = carry_forward(frames, KEYS, [F.col("step")], "_before", good, over)
    d = carry_forward(d, KEYS, [F.desc("step")], "_after", good, over)
    back = F.col("step") - F.col("_before.step")
    ahead = F.col("_after.step") - F.col("step")
    nearest = F.when(
        F.col("_before").isNotNull() & (F.col("_after").isNull() | (back <= ahead)), F.col("_before.description")
    ).otherwise(F.col("_after.description"))
    filled = F.when(F.col("status") == 0, F.col("description")).otherwise(
        F.coalesce(nearest, F.lit(text.NO_DESCRIPTION))
    )
    return d.withColumn("filled", filled).drop("_before", "_after")


def category_join(names: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a label, one row with the match rate)."""
    matched = names.join(categories, ["video_name"])
    flagged = names.join(categories.select("video_name", F.lit(1).alias("_m")), ["video_name"], "left")
    rate = flagged.agg(F.count(F.lit(1)).alias("n_total"), F.count("_m").alias("n_matched"))
    return matched, rate.withColumn("match_rate", F.try_divide(F.col("n_matched").cast("double"), F.col("n_total")))


def dense_reindex(chosen: DataFrame, ids: DataFrame, over: Oversize | None = None) -> DataFrame:
    """Renumber chosen shots 0..k-1 and map answered numbers back.

    ``ids`` has ``new_id``; numbers outside the range are dropped by the join.
    """
    mapping = with_position(chosen.select(*KEYS, "shot_idx"), KEYS, [F.col("shot_idx")], "new_id", over)
    return ids.join(mapping, [*KEYS, "new_id"])


def remap_to_original(segments: DataFrame, frames: DataFrame) -> DataFrame:
    """Segment borders from steps to original frame numbers."""
    first = frames.select(*KEYS, F.col("step").alias("start"), F.col("pick").alias("start_pick"))
    last = frames.select(*KEYS, F.col("step").alias("end"), F.col("pick").alias("end_pick"))
    return segments.join(first, [*KEYS, "start"]).join(last, [*KEYS, "end"])


def gt_frame_set(frames: DataFrame, shots: DataFrame, over: Oversize | None = None) -> DataFrame:
    """Picks inside selected shots, found by prefix sums of the shot sizes."""
    summed = running_sum(shots, KEYS, [F.col("shot_idx")], {"_hi": F.col("n_sampled")}, over)
    spans = summed.filter((F.col("shot_level_gt") == 1) & (F.col("n_sampled") > 0)).select(
        *KEYS, "shot_idx", (F.col("_hi") - F.col("n_sampled")).alias("start"), (F.col("_hi") - 1).alias("end")
    )
    hit = interval_hits(spans, frames.select(*KEYS, "step", "pick"), "step")
    return hit.select(*KEYS, "shot_idx", "step", "pick")


