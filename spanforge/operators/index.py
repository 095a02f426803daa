"""Frame numbering and label clean-up on the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import index, text
from spanforge.operators.ordered import KEYS


def _steps(videos: DataFrame, n: Column) -> DataFrame:
    return videos.filter(n > 0).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))


def picks_linspace(videos: DataFrame, identity_if_short: bool = False) -> DataFrame:
    """n evenly spaced picks out of ``n_total`` frames, rounded half to even."""
    n, total = F.col("n"), F.col("n_total")
    out = _steps(videos.filter(total > 0), F.least(n, total) if identity_if_short else n)
    spaced = index.half_even(index.linspace_point(F.col("step"), total, n))
    pick = F.when(n >= total, F.col("step")).otherwise(spaced) if identity_if_short else spaced
    return out.withColumn("pick", pick)


def picks_fps(videos: DataFrame) -> DataFrame:
    """One pick per second of video, clamped to the last frame."""
    at = F.floor(F.col("step").cast("double") * F.col("fps")).cast("long")
    out = _steps(videos, F.col("n"))
    return out.withColumns(
        {
            "pick": F.greatest(F.lit(0).cast("long"), F.least(at, F.col("n_total") - 1)),
            "stride": index.half_even(F.col("fps")),
        }
    )


def picks_stride(videos: DataFrame, target: float) -> DataFrame:
    """Every max(1, round(fps / target))-th frame."""
    stride = F.greatest(F.lit(1).cast("long"), index.half_even(F.col("fps") / F.lit(float(target))))
    every = F.sequence(F.lit(0).cast("long"), F.col("n_total") - 1, stride)
    return videos.filter(F.col("n_total") > 0).select("*", F.posexplode(every).alias("step", "pick"))


def picks_default(frames: DataFrame) -> DataFrame:
    return frames.withColumn("pick", F.coalesce("pick", F.col("step") * index.DEFAULT_PICK_DISTANCE))


def detect_index_space(segments: DataFrame, need_two_steps: bool = True) -> DataFrame:
    """1 where segment borders are original frame numbers, else 0."""
    beyond = F.max("end") >= F.max("n_steps")
    if need_two_steps:
        beyond = beyond & (F.max("n_steps") > 1)
    return segments.groupBy(*KEYS).agg(beyond.cast("int").alias("original_space"))


def coalesce_labels(records: DataFrame) -> DataFrame:
    """Frame label, summary label under either name, and a usable frame count."""
    summary = F.coalesce("gtsummary", "gt_summary")
    size = lambda c: F.nullif(F.size(c), F.lit(-1)).cast("long")
    n = F.coalesce(F.nullif(F.col("n_frames"), F.lit(0)), size("gtscore"), size(summary))
    return records.withColumns({"gt_label": F.coalesce(F.col("gtframe"), summary), "n_frames": n})


def usable_shots(segments: DataFrame) -> DataFrame:
    return segments.filter(F.col("n_sampled") > 0)


def gt_filter(rows: DataFrame, label: str = "shot_level_gt") -> DataFrame:
    return rows.filter(F.col(label) > 0)


def expand_shot_range(rows: DataFrame, tag: str = "tag") -> DataFrame:
    """``[Shots X-Y]`` or ``[Shot X]`` to one row per shot."""
    pattern = r"(?i)\[Shots?\s+(\d+)(?:-(\d+))?\]"
    first = F.regexp_extract(tag, pattern, 1).try_cast("bigint")
    last = F.coalesce(F.nullif(F.regexp_extract(tag, pattern, 2), F.lit("")).try_cast("bigint"), first)
    run = F.when(last >= first, F.sequence(first, last))
    return rows.withColumn("shot_id", F.explode(run))


def reconstruct_picks(paths: DataFrame, pattern: str = r"frame_?(\d+)\.jpg", offset: int = 0) -> DataFrame:
    """Frame numbers read back out of file names; other files are dropped."""
    number = F.regexp_extract("path", pattern, 1)
    return paths.filter(number != "").withColumn("pick", number.cast("long") + offset)


def valid_rows(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(text.valid_text(F.col(column)))


def nested_get(c: Column, *path: str) -> Column:
    """A value at a key path; NULL as soon as a key is missing."""
    for key in path:
        c = c.getField(key)
    return c
