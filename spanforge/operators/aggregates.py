"""Dataset statistics, run summaries and text tables.

Every statistic is a two-level aggregation: first per video (map-side combined), then per
dataset. Ratios guard their divisor; NULL means "nothing to average".
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators.ordered import KEYS, Oversize, quantiles, with_position


def ratio(a: Column | str, b: Column | str, default: float | None = 0.0) -> Column:
    """a / b in doubles; ``default`` when b is 0 or NULL."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(default))


# ---- statistics ------------------------------------------------------------

def frame_stats_by_video(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("num_frames"),
        F.count_if(F.col("gtframe") == 1).alias("num_gt_frames"),
        F.count_if(F.col("status") == 1).alias("num_filtered_frames"),
    )


def frame_stats(frames: DataFrame) -> DataFrame:
    """Totals, averages per video and the share of filtered frames, per dataset."""
    total = frame_stats_by_video(frames).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("total_videos"),
        F.sum("num_frames").alias("total_frames"),
        F.sum("num_gt_frames").alias("total_gt_frames"),
        F.sum("num_filtered_frames").alias("total_filtered_frames"),
    )
    averages = {
        f"avg_{k}_per_video": ratio(f"total_{k}", "total_videos") for k in ("frames", "gt_frames", "filtered_frames")
    }
    averages["filtered_percentage"] = ratio("total_filtered_frames", "total_frames") * 100
    return total.withColumns(averages)


def shot_stats_by_video(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Shot figures per video; videos without shots are left out."""
    gt = F.col("shot_level_gt") == 1
    described = text.valid_text(F.col("description"))
    per = segments.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("num_shots"),
        F.count_if(gt).alias("num_gt_shots"),
        F.sum("n_sampled").alias("_frames"),
        F.avg("n_sampled").alias("avg_frames_per_shot"),
        F.min("n_sampled").alias("min_frames_per_shot"),
        F.max("n_sampled").alias("max_frames_per_shot"),
        F.coalesce(F.avg(F.when(gt, F.col("n_sampled"))), F.lit(0.0)).alias("avg_gt_frames_per_shot"),
        F.coalesce(F.sum(F.when(gt, F.col("n_sampled"))), F.lit(0)).alias("total_frames_in_gt_shots"),
        F.coalesce(F.avg(F.when(described, F.length("description"))), F.lit(0.0)).alias("avg_desc_len_nonempty"),
        F.coalesce(F.sum(F.when(described, F.length("description"))), F.lit(0)).alias("_desc"),
    )
    sizes = frames.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("total_frames"))
    joined = per.join(sizes, list(KEYS), "left").withColumn("total_frames", F.coalesce("total_frames", F.lit(0)))
    return joined.withColumn("gt_frames_percentage", ratio("total_frames_in_gt_shots", "total_frames") * 100)


def shot_stats(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Shot figures per dataset; every video counts in ``total_videos``."""
    videos = frames.select(*KEYS).distinct().groupBy("dataset").agg(F.count(F.lit(1)).alias("total_videos"))
    per = shot_stats_by_video(frames, segments)
    total = per.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("videos_with_shots"),
        F.sum("num_shots").alias("total_shots"),
        F.sum("num_gt_shots").alias("total_gt_shots"),
        F.sum("total_frames").alias("total_frames"),
        F.sum("total_frames_in_gt_shots").alias("total_frames_in_gt_shots"),
        F.sum("_frames").alias("_frames"),
        F.min("min_frames_per_shot").alias("min_frames_per_shot"),
        F.max("max_frames_per_shot").alias("max_frames_per_shot"),
        F.sum("_desc").alias("_desc"),
    )
    figures = {
        "avg_shots_per_video": ratio("total_shots", "videos_with_shots"),
        "avg_gt_shots_per_video": ratio("total_gt_shots", "videos_with_shots"),
        "avg_frames_per_shot": ratio("_frames", "total_shots"),
        "avg_gt_frames_per_shot": ratio("total_frames_in_gt_shots", "total_gt_shots"),
        "avg_total_gt_frames_per_video": ratio("total_frames_in_gt_shots", "videos_with_shots"),
        "gt_frames_percentage": ratio("total_frames_in_gt_shots", "total_frames") * 100,
        "avg_desc_len_all": ratio("_desc", "total_shots"),
    }
    return videos.join(total, "dataset", "left").withColumns(figures).drop("_frames", "_desc")


def sentence_alignment(sentences: DataFrame, segments: DataFrame) -> DataFrame:
    """Words of each sentence and of the clips of the shots it names (one clip per shot)."""
    clip = segments.groupBy(*KEYS, F.col("shot_idx").alias("shot")).agg(
        F.max(text.word_count(F.col("description"))).alias("clip_words")
    )
    named = sentences.select(*KEYS, "block", "sentence_id", F.explode("shot_ids").alias("shot"))
    covered = named.join(clip, [*KEYS, "shot"]).groupBy(*KEYS, "block", "sentence_id").agg(
        F.sum("clip_words").alias("aligned_words")
    )
    out = sentences.select(
        *KEYS,
        "block",
        "sentence_id",
        text.word_count(F.col("text")).alias("n_words"),
        F.size("shot_ids").cast("long").alias("n_shots"),
    ).join(covered, [*KEYS, "block", "sentence_id"], "left")
    aligned = F.coalesce("aligned_words", F.lit(0)).cast("long")
    out = out.withColumn("aligned_words", aligned)
    return out.withColumn("compression", ratio("n_words", "aligned_words", None) * 100)


def document_stats_by_video(sentences: DataFrame, segments: DataFrame) -> DataFrame:
    """Length and compression of each document and summary.

    Documents are compared with all shots of the video, summaries with its selected shots.
    """
    shots = segments.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(F.col("shot_level_gt") == 1).alias("_gt")
    )
    per = sentence_alignment(sentences, segments).groupBy(*KEYS, "block").agg(
        F.count(F.lit(1)).alias("num_sentences"),
        F.sum("n_shots").alias("num_shots_aligned"),
        F.sum("n_words").alias("num_words"),
        F.sum("aligned_words").alias("aligned_words"),
        F.sum("compression").alias("_c"),
        F.count("compression").alias("_nc"),
    )
    base = F.when(F.col("block") == "document", F.col("_all")).otherwise(F.col("_gt"))
    return (
        per.join(shots, list(KEYS), "left")
        .withColumns(
            {
                "avg_shots_per_sentence": ratio("num_shots_aligned", "num_sentences"),
                "avg_words_per_sentence": ratio("num_words", "num_sentences"),
                "sentence_compression_vs_shots": ratio(F.col("num_sentences"), base) * 100,
                "word_compression_vs_shots": ratio("num_words", "aligned_words") * 100,
            }
        )
        .drop("_all", "_gt")
    )


def document_stats(sentences: DataFrame, segments: DataFrame) -> DataFrame:
    """The same figures per dataset and block, with the summary/document word ratio."""
    per = document_stats_by_video(sentences, segments)
    total = per.groupBy("dataset", "block").agg(
        F.count(F.lit(1)).alias("videos"),
        F.sum("num_sentences").alias("total_sentences"),
        F.sum("num_shots_aligned").alias("total_shots_aligned"),
        F.sum("num_words").alias("total_words"),
        F.sum("aligned_words").alias("aligned_shots_total_words"),
        F.sum("_c").alias("_c"),
        F.sum("_nc").alias("_nc"),
    )
    pair = per.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("block") == "summary", F.col("num_words"))).alias("_s"),
        F.sum(F.when(F.col("block") == "document", F.col("num_words"))).alias("_d"),
    )
    versus = pair.groupBy("dataset").agg(
        F.coalesce(F.avg(ratio("_s", "_d", None) * 100), F.lit(0.0)).alias("avg_summary_vs_document")
    )
    return (
        total.withColumns(
            {
                "avg_shots_per_sentence": ratio("total_shots_aligned", "total_sentences"),
                "avg_words_per_sentence": ratio("total_words", "total_sentences"),
                "avg_sentence_compression_vs_shots": ratio("_c", "_nc"),
                "overall_word_compression_vs_shots": ratio("total_words", "aligned_shots_total_words") * 100,
            }
        )
        .drop("_c", "_nc")
        .join(versus, "dataset")
    )


def vocabulary_size(texts: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct lower-cased tokens; tokens are made distinct before the shuffle."""
    tokens = texts.select(*by, F.explode(text.words(F.lower(column))).alias("token"))
    return tokens.groupBy(*by).agg(F.count_distinct("token").alias("vocabulary_size"))


def dataset_overview(frames: DataFrame, segments: DataFrame, documents: DataFrame) -> DataFrame:
    """The overview row of each dataset: sizes, label ratios, text lengths, vocabulary.

    ``frames``: n_frames, gtframe, description; ``segments``: n_sampled, shot_level_gt,
    description; ``documents``: block, raw_text, num_sentences.
    """
    gt_frame, gt_shot = F.col("gtframe") > 0, F.col("shot_level_gt") > 0
    said = F.coalesce(F.col("description"), F.lit("")) != ""
    desc_words = F.when(said, text.word_count(F.col("description")))
    desc_sents = F.when(said, text.sentence_count(F.col("description")))

    def sums(prefix: str, gt: Column) -> list[Column]:
        return [
            F.sum(desc_words).alias(f"_{prefix}_words"),
            F.sum(desc_sents).alias(f"_{prefix}_sents"),
            F.count(desc_words).alias(f"_{prefix}_n"),
            F.sum(F.when(gt, desc_words)).alias(f"_{prefix}_gt_words"),
            F.count(F.when(gt, desc_words)).alias(f"_{prefix}_gt_n"),
        ]

    per_video = frames.groupBy(*KEYS).agg(
        F.coalesce(F.nullif(F.max("n_frames"), F.lit(0)), F.count(F.lit(1))).alias("n_frames"),
        F.count(F.lit(1)).alias("n_sampled_frames"),
        F.count_if(gt_frame).alias("n_gt_frames"),
        *sums("frame", gt_frame),
    )
    per_shots = segments.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n_shots"),
        F.count_if(gt_shot).alias("n_gt_shots"),
        F.sum(F.when(gt_shot, F.col("n_sampled"))).alias("in_gt"),
        *sums("shot", gt_shot),
    )
    joined = per_video.join(per_shots, list(KEYS), "left")
    level = joined.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("num_videos"),
        F.avg("n_frames").alias("avg_frames"),
        F.avg("n_sampled_frames").alias("avg_sampled_frames"),
        F.avg("n_shots").alias("avg_shots"),
        F.avg("n_gt_frames").alias("avg_gt_frames"),
        F.avg("n_gt_shots").alias("avg_gt_shots"),
        F.avg(ratio("in_gt", "n_gt_shots", None)).alias("avg_frames_per_gt_shot"),
        F.avg(ratio("n_gt_frames", "n_sampled_frames", None)).alias("gt_frame_ratio"),
        F.avg(ratio("n_gt_shots", "n_shots", None)).alias("gt_shot_ratio"),
        F.avg(F.when(F.col("n_gt_shots") > 0, ratio("in_gt", "n_sampled_frames", None))).alias("gt_shot_frame_ratio"),
        F.sum("n_gt_frames").alias("_gt_frames"),
        *[
            F.sum(f"_{p}_{k}").alias(f"_{p}_{k}")
            for p in ("frame", "shot")
            for k in ("words", "sents", "n", "gt_words", "gt_n")
        ],
    )
    spoken = documents.filter(F.coalesce(F.col("raw_text"), F.lit("")) != "")
    n_sents = F.coalesce(F.col("num_sentences"), text.sentence_count(F.col("raw_text")))
    blocks = spoken.groupBy("dataset").agg(
        *[
            F.avg(F.when(F.col("block") == block, value)).alias(f"avg_{short}_{unit}")
            for block, short in (("document", "doc"), ("summary", "summary"))
            for unit, value in (("words", text.word_count(F.col("raw_text"))), ("sentences", n_sents))
        ]
    )
    texts = (
        frames.select("dataset", F.col("description").alias("t"))
        .unionByName(segments.select("dataset", F.col("description").alias("t")))
        .unionByName(documents.select("dataset", F.col("raw_text").alias("t")))
    )
    vocabulary = vocabulary_size(texts, "t", ["dataset"])
    figures = {
        "avg_frames_per_shot": ratio("avg_sampled_frames", "avg_shots", None),
        "avg_frame_desc_words": ratio("_frame_words", "_frame_n", None),
        "avg_frame_desc_sentences": ratio("_frame_sents", "_frame_n", None),
        "avg_shot_desc_words": ratio("_shot_words", "_shot_n", None),
        "avg_shot_desc_sentences": ratio("_shot_sents", "_shot_n", None),
        "avg_gt_frame_desc_words": ratio("_frame_gt_words", "_gt_frames", None),
        "avg_gt_shot_desc_words": ratio("_shot_gt_words", "_shot_gt_n", None),
        "compression_ratio_words": ratio("avg_doc_words", "avg_summary_words", None),
        "compression_ratio_sentences": ratio("avg_doc_sentences", "avg_summary_sentences", None),
    }
    out = level.join(blocks, "dataset", "left").join(vocabulary, "dataset", "left").withColumns(figures)
    return out.select([c for c in out.columns if not c.startswith("_")])


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, population deviation, range and p25 / p75 / p99.9."""
    probs = {"median": 0.5, "percentile_25": 0.25, "percentile_75": 0.75, "percentile_99_9": 0.999}
    return quantiles(df, list(by), value, probs, facts=True)


def compression_ratio(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*KEYS).agg(F.avg("gtscore").alias("compression_ratio"))


def kts_summary(segments: DataFrame, selected: bool = False) -> DataFrame:
    """Totals of a segmentation: videos, frames, segments and frames per segment."""
    per = segments.groupBy(*KEYS).agg(
        F.sum("n_sampled").alias("_f"),
        F.count(F.lit(1)).alias("_s"),
        F.count_if(F.col("shot_level_gt") == 1).alias("_g"),
    )
    out = per.agg(
        F.count(F.lit(1)).alias("total_videos"),
        F.sum("_f").alias("total_frames"),
        F.sum("_s").alias("total_segments"),
        F.sum("_g").alias("selected_segments"),
    )
    out = out.withColumn("avg_ratio", ratio("total_frames", "total_segments"))
    return out.withColumn("selected_share", ratio("selected_segments", "total_segments")) if selected else out.drop(
        "selected_segments"
    )


# ---- run summaries ---------------------------------------------------------

def win_counts(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Wins per item; undecided pairs count for nobody, items without a win stay.

    Undecided pairs are counted for a position that no item has; a filter would be tested ahead of the columns it is made of,
    and judge every pair again.
    """
    place = F.when(F.col("winner") == "A", F.col("i")).when(F.col("winner") == "B", F.col("j"))
    won = pairs.select(*KEYS, F.coalesce(place.cast("long"), F.lit(-1).cast("long")).alias("orig_pos"))
    counts = won.groupBy(*KEYS, "orig_pos").agg(F.count(F.lit(1)).alias("wins"))
    joined = items.select(*KEYS, "orig_pos").join(counts, [*KEYS, "orig_pos"], "left")
    return joined.withColumn("wins", F.coalesce("wins", F.lit(0)).cast("long"))


def macro_avg(units: DataFrame, metrics: Sequence[str], run_keys: Sequence[str], group_keys: Sequence[str] = KEYS) -> DataFrame:
    """Unit values to a mean per video to a mean per run; NULLs are skipped."""
    names = [k for k in group_keys if k not in run_keys]
    per = units.groupBy(*run_keys, *names).agg(*[F.avg(m).alias(m) for m in metrics])
    return per.groupBy(*run_keys).agg(*[F.avg(m).alias(m) for m in metrics])


def run_counters(outputs: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many answers succeeded, parsed, kept the format, and by which parse mode."""
    return outputs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("error").isNull()).alias("n_success"),
        F.count_if(F.col("error").isNotNull()).alias("n_error"),
        F.count_if(F.col("parse_ok")).alias("n_parsed"),
        F.count_if(F.col("format_ok")).alias("n_format_ok"),
        F.count_if(F.col("parse_mode") == "line").alias("n_line_mode"),
        F.count_if(F.col("parse_mode") == "sentence_fallback").alias("n_fallback"),
        F.count_if(F.col("was_output_truncated")).alias("n_truncated"),
    )


def failure_histogram(outputs: DataFrame, by: Sequence[str], reason: str = "failure_reason") -> DataFrame:
    failed = outputs.filter(F.col(reason).isNotNull())
    return failed.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def most_common(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The most frequent value, the smaller on a tie."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("_n", -F.col(value))).alias(name))


def position_bias(predictions: DataFrame, shuffled: DataFrame) -> DataFrame:
    """Display position and original index of the item each answer puts first."""
    top = predictions.filter(F.col("pos") == 1).select(*KEYS, F.col("pred_id").alias("display_pos"))
    return top.join(shuffled.select(*KEYS, "display_pos", "orig_pos"), [*KEYS, "display_pos"]).select(
        *KEYS, F.col("display_pos").alias("top1_display_position"), F.col("orig_pos").alias("top1_original_index")
    )


def token_usage(outputs: DataFrame, by: Sequence[str]) -> DataFrame:
    return outputs.groupBy(*by).agg(
        F.sum(F.coalesce("n_input_tokens", F.lit(0))).alias("total_input_tokens"),
        F.sum(F.coalesce("n_output_tokens", F.lit(0))).alias("total_output_tokens"),
        F.min("n_input_tokens").alias("min_input_tokens"),
        F.max("n_input_tokens").alias("max_input_tokens"),
        F.avg("n_input_tokens").alias("mean_input_tokens"),
    )


# ---- text tables -----------------------------------------------------------

def ordered_text_agg(
    rows: DataFrame,
    order: Sequence[Column],
    column: str,
    label: str = "Frame {}: ",
    empty: str = "[no description]",
    glue: str = "\n",
    lines_per_page: int = 1000,
    keys: Sequence[str] = KEYS,
    over: Oversize | None = None,
) -> DataFrame:
    """Numbered lines joined in order, with a placeholder for empty text.

    ``{}`` in the label becomes the 1-based number. A group longer than a page gives several
    numbered pages; together they are the whole text, and no row grows without bound.
    """
    placed = with_position(rows, keys, order, "_p", over)
    before, _, after = label.partition("{}")
    number = (F.col("_p") + 1).cast("string") if "{}" in label else F.lit("")
    body = F.when(text.is_blank(F.col(column)), F.lit(empty)).otherwise(F.col(column))
    line = F.concat(F.lit(before), number, F.lit(after), body)
    paged = placed.withColumns({"_line": line, "page": F.floor(F.col("_p") / lines_per_page).cast("long")})
    packed = F.sort_array(F.collect_list(F.struct("_p", "_line")))
    return paged.groupBy(*keys, "page").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.array_join(F.transform(packed, lambda x: x["_line"]), glue).alias("block_text"),
    )
