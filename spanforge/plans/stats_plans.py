"""Dataset statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import aggregates as ag
from spanforge.operators import groundtruth as gt
from spanforge.operators.ordered import KEYS
from spanforge.plans.registry import R6, query, r6, with_ctes
from spanforge.sources import views
from spanforge.sources.views import FRAMES, SEGMENTS, SENTENCES, SHOT_FRAMES

GTFRAMES = """
gt_frames AS (
  SELECT *, n_steps * 15 AS n_frames, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY gtscore DESC, step DESC)
    <= least(n_steps, greatest(1, CAST(round_even(n_steps * CAST(0.15 AS DOUBLE), 0) AS BIGINT))) THEN 1 ELSE 0 END AS gtframe
  FROM frames)
"""

SOME_SEGMENTS = """
some_shots AS (SELECT video_id, shot_idx, n_sampled, CASE WHEN shot_idx % 3 = 0 THEN 1 ELSE 0 END AS shot_level_gt,
  CASE shot_idx % 4 WHEN 0 THEN description || ' in the yard. It rains!' WHEN 1 THEN '[CONTENT_FILTERED]' WHEN 2 THEN '' ELSE description END AS description
  FROM segments WHERE video_id NOT LIKE '%3')
"""


def labelled_frames(spark, sf, over=None):
    over = over or views.event_groups(spark, sf)
    f = gt.topk_frames(views.frames(spark, sf, over), over=over)
    return f.withColumn("n_frames", F.col("n_steps") * 15)


def some_segments(spark, sf, gaps=True, over=None):
    k = F.col("shot_idx") % 4
    said = (
        F.when(k == 0, F.concat("description", F.lit(" in the yard. It rains!")))
        .when(k == 1, "[CONTENT_FILTERED]")
        .when(k == 2, "")
        .otherwise(F.col("description"))
    )
    s = views.segments(spark, sf, over)
    s = s.filter(~F.col("video_id").endswith("3")) if gaps else s
    return s.select(*KEYS, "shot_idx", "n_sampled", (F.col("shot_idx") % 3 == 0).cast("int").alias("shot_level_gt"), said.alias("description"))


def rounded(df, *keep):
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


@query(
    "frame_stats_by_video",
    with_ctes(
        FRAMES,
        GTFRAMES,
        body="""SELECT video_id, count(*) AS num_frames, count(*) FILTER (WHERE gtframe = 1) AS num_gt_frames,
        count(*) FILTER (WHERE status = 1) AS num_filtered_frames FROM gt_frames GROUP BY video_id""",
    ),
)
def frame_stats_by_video(spark, sf):
    return ag.frame_stats_by_video(labelled_frames(spark, sf)).drop("dataset")


@query(
    "frame_stats",
    with_ctes(
        FRAMES,
        GTFRAMES,
        body=f"""SELECT dataset, count(DISTINCT video_id) AS total_videos, count(*) AS total_frames, CAST(sum(gtframe) AS BIGINT) AS total_gt_frames,
        CAST(sum(status) AS BIGINT) AS total_filtered_frames, {R6("count(*) / count(DISTINCT video_id)")} AS avg_frames_per_video,
        {R6("sum(gtframe) / count(DISTINCT video_id)")} AS avg_gt_frames_per_video,
        {R6("sum(status) / count(DISTINCT video_id)")} AS avg_filtered_frames_per_video,
        {R6("sum(status) / count(*) * 100")} AS filtered_percentage FROM gt_frames GROUP BY dataset""",
    ),
)
def frame_stats(spark, sf):
    return rounded(ag.frame_stats(labelled_frames(spark, sf)))


PER_SHOT_VIDEO = """
per AS (
  SELECT video_id, count(*) AS num_shots, sum(shot_level_gt) AS num_gt_shots, sum(n_sampled) AS nf, avg(n_sampled) AS af,
    min(n_sampled) AS mn, max(n_sampled) AS mx, coalesce(avg(n_sampled) FILTER (WHERE shot_level_gt = 1), 0) AS ag,
    coalesce(sum(n_sampled) FILTER (WHERE shot_level_gt = 1), 0) AS in_gt,
    coalesce(avg(length(description)) FILTER (WHERE description NOT IN ('', '[CONTENT_FILTERED]')), 0) AS dl,
    coalesce(sum(length(description)) FILTER (WHERE description NOT IN ('', '[CONTENT_FILTERED]')), 0) AS dsum
  FROM some_shots GROUP BY video_id),
sizes AS (SELECT video_id, count(*) AS total_frames FROM frames GROUP BY video_id)
"""


@query(
    "shot_stats_by_video",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        SOME_SEGMENTS,
        PER_SHOT_VIDEO,
        body=f"""SELECT video_id, num_shots, CAST(num_gt_shots AS BIGINT) AS num_gt_shots, {R6("af")} AS avg_frames_per_shot, mn AS min_frames_per_shot,
        mx AS max_frames_per_shot, {R6("ag")} AS avg_gt_frames_per_shot, CAST(in_gt AS BIGINT) AS total_frames_in_gt_shots, total_frames,
        {R6("in_gt / total_frames * 100")} AS gt_frames_percentage, {R6("dl")} AS avg_desc_len_nonempty FROM per JOIN sizes USING (video_id)""",
    ),
)
def shot_stats_by_video(spark, sf):
    over = views.event_groups(spark, sf)
    out = ag.shot_stats_by_video(views.frames(spark, sf, over), some_segments(spark, sf, over=over))
    return rounded(out.drop("dataset", "_frames", "_desc"))


@query(
    "shot_stats",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        SOME_SEGMENTS,
        PER_SHOT_VIDEO,
        body=f"""SELECT 'events' AS dataset, (SELECT count(DISTINCT video_id) FROM frames) AS total_videos, count(*) AS videos_with_shots,
        CAST(sum(num_shots) AS BIGINT) AS total_shots, CAST(sum(num_gt_shots) AS BIGINT) AS total_gt_shots, CAST(sum(total_frames) AS BIGINT) AS total_frames,
        CAST(sum(in_gt) AS BIGINT) AS total_frames_in_gt_shots, min(mn) AS min_frames_per_shot, max(mx) AS max_frames_per_shot,
        {R6("sum(num_shots) / count(*)")} AS avg_shots_per_video, {R6("sum(num_gt_shots) / count(*)")} AS avg_gt_shots_per_video,
        {R6("sum(nf) / sum(num_shots)")} AS avg_frames_per_shot, {R6("sum(in_gt) / sum(num_gt_shots)")} AS avg_gt_frames_per_shot,
        {R6("sum(in_gt) / count(*)")} AS avg_total_gt_frames_per_video, {R6("sum(in_gt) / sum(total_frames) * 100")} AS gt_frames_percentage,
        {R6("sum(dsum) / sum(num_shots)")} AS avg_desc_len_all FROM per JOIN sizes USING (video_id)""",
    ),
)
def shot_stats(spark, sf):
    over = views.event_groups(spark, sf)
    return rounded(ag.shot_stats(views.frames(spark, sf, over), some_segments(spark, sf, over=over)))


TALK_SHOTS = """
talk_shots AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS shot_idx, len(regexp_extract_all(text, '\\S+')) AS w,
  CASE WHEN role = 'user' THEN 1 ELSE 0 END AS shot_level_gt, text AS description FROM conversations),
aligned AS (
  SELECT s.video_id, block, sentence_id, any_value(len(regexp_extract_all(s.text, '\\S+'))) AS n_words, any_value(len(s.shot_ids)) AS n_shots,
    coalesce(sum(t.w), 0) AS aligned_words
  FROM sentences s LEFT JOIN talk_shots t ON t.video_id = s.video_id AND list_contains(s.shot_ids, t.shot_idx)
  GROUP BY s.video_id, block, sentence_id),
docs AS (
  SELECT video_id, block, count(*) AS num_sentences, CAST(sum(n_shots) AS BIGINT) AS num_shots_aligned, CAST(sum(n_words) AS BIGINT) AS num_words,
    CAST(sum(aligned_words) AS BIGINT) AS aligned_words, sum(n_words / aligned_words * 100) FILTER (WHERE aligned_words > 0) AS c,
    count(*) FILTER (WHERE aligned_words > 0) AS nc FROM aligned GROUP BY video_id, block),
shots AS (SELECT video_id, count(*) AS all_shots, sum(shot_level_gt) AS gt_shots FROM talk_shots GROUP BY video_id)
"""


def talk_shots(spark, sf):
    t = views.table(spark, sf, "conversations")
    return t.select(
        F.lit("talks").alias("dataset"),
        F.col("conv_id").cast("string").alias("video_id"),
        F.col("turn").alias("shot_idx"),
        (F.col("role") == "user").cast("int").alias("shot_level_gt"),
        F.col("text").alias("description"),
    )


def g0(a: str, b: str) -> str:
    return R6(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END")


@query(
    "document_stats_by_video",
    with_ctes(
        SENTENCES,
        TALK_SHOTS,
        body=f"""SELECT video_id, block, num_sentences, num_shots_aligned, num_words, aligned_words,
        {g0("num_shots_aligned", "num_sentences")} AS avg_shots_per_sentence, {g0("num_words", "num_sentences")} AS avg_words_per_sentence,
        {g0("num_sentences * 100.0::DOUBLE", "(CASE block WHEN 'document' THEN all_shots ELSE gt_shots END)")} AS sentence_compression_vs_shots,
        {g0("num_words * 100.0::DOUBLE", "aligned_words")} AS word_compression_vs_shots FROM docs JOIN shots USING (video_id)""",
    ),
)
def document_stats_by_video(spark, sf):
    out = ag.document_stats_by_video(views.sentences(spark, sf), talk_shots(spark, sf))
    return rounded(out.drop("dataset", "_c", "_nc"))


@query(
    "document_stats",
    with_ctes(
        SENTENCES,
        TALK_SHOTS,
        """versus AS (SELECT avg(s.num_words / d.num_words * 100) AS v FROM docs s JOIN docs d ON s.video_id = d.video_id
           AND s.block = 'summary' AND d.block = 'document' WHERE d.num_words > 0)""",
        body=f"""SELECT 'talks' AS dataset, block, count(*) AS videos, CAST(sum(num_sentences) AS BIGINT) AS total_sentences,
        CAST(sum(num_shots_aligned) AS BIGINT) AS total_shots_aligned, CAST(sum(num_words) AS BIGINT) AS total_words,
        CAST(sum(aligned_words) AS BIGINT) AS aligned_shots_total_words, {R6("sum(num_shots_aligned) / sum(num_sentences)")} AS avg_shots_per_sentence,
        {R6("sum(num_words) / sum(num_sentences)")} AS avg_words_per_sentence, {R6("sum(c) / sum(nc)")} AS avg_sentence_compression_vs_shots,
        {R6("sum(num_words) / sum(aligned_words) * 100")} AS overall_word_compression_vs_shots,
        {R6("(SELECT v FROM versus)")} AS avg_summary_vs_document FROM docs GROUP BY block""",
    ),
)
def document_stats(spark, sf):
    return rounded(ag.document_stats(views.sentences(spark, sf), talk_shots(spark, sf)))


W = lambda c: f"len(regexp_extract_all({c}, '[^ \\t\\n\\r\\x0b\\x0c]+'))"
S = lambda c: f"len(list_filter(regexp_split_to_array({c}, '[.!?]+'), lambda x: trim(x, ' \t\n\r') <> ''))"


@query(
    "dataset_overview",
    with_ctes(
        FRAMES,
        GTFRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        SOME_SEGMENTS.replace(" WHERE video_id NOT LIKE '%3'", ""),
        """documents_long AS (SELECT 'document' AS block, text AS raw_text FROM documents)""",
        """blocks AS (SELECT CASE WHEN doc_id % 4 = 0 THEN 'summary' ELSE 'document' END AS block, text AS raw_text FROM documents)""",
        f"""pf AS (SELECT video_id, count(*) AS ns, max(n_frames) AS nf, sum(gtframe) AS g FROM gt_frames GROUP BY video_id)""",
        f"""ps AS (SELECT video_id, count(*) AS sh, sum(shot_level_gt) AS gs, coalesce(sum(n_sampled) FILTER (WHERE shot_level_gt = 1), 0) AS in_gt FROM some_shots GROUP BY video_id)""",
        f"""fw AS (SELECT avg({W("description")}) AS w, avg({S("description")}) AS s, sum({W("description")}) FILTER (WHERE gtframe = 1) AS gw FROM gt_frames WHERE description <> '')""",
        f"""sw AS (SELECT avg({W("description")}) AS w, avg({S("description")}) AS s, avg({W("description")}) FILTER (WHERE shot_level_gt = 1) AS gw FROM some_shots WHERE description <> '')""",
        f"""bw AS (SELECT avg({W("raw_text")}) FILTER (WHERE block = 'document') AS dw, avg({S("raw_text")}) FILTER (WHERE block = 'document') AS ds,
              avg({W("raw_text")}) FILTER (WHERE block = 'summary') AS sw, avg({S("raw_text")}) FILTER (WHERE block = 'summary') AS ss FROM blocks WHERE raw_text <> '')""",
        """vocab AS (SELECT count(DISTINCT w) AS v FROM (SELECT unnest(regexp_extract_all(lower(t), '[^ \\t\\n\\r\\x0b\\x0c]+')) AS w FROM
              (SELECT description AS t FROM frames UNION ALL SELECT description FROM some_shots UNION ALL SELECT raw_text FROM blocks)))""",
        """lv AS (SELECT count(*) AS n, avg(nf) AS nf, avg(ns) AS ns, avg(sh) AS sh, avg(g) AS g, avg(gs) AS gs, sum(g) AS gsum,
              avg(CASE WHEN gs > 0 THEN in_gt / gs END) AS fpg, avg(g / ns) AS gr, avg(gs / sh) AS sr, avg(CASE WHEN gs > 0 THEN in_gt / ns END) AS sfr
              FROM pf LEFT JOIN ps USING (video_id))""",
        body="SELECT 'events' AS dataset, n AS num_videos, "
        + ", ".join(
            f"{R6(e)} AS {n}"
            for n, e in {
                "avg_frames": "nf",
                "avg_sampled_frames": "ns",
                "avg_shots": "sh",
                "avg_gt_frames": "g",
                "avg_gt_shots": "gs",
                "avg_frames_per_gt_shot": "fpg",
                "gt_frame_ratio": "gr",
                "gt_shot_ratio": "sr",
                "gt_shot_frame_ratio": "sfr",
                "avg_frames_per_shot": "ns / sh",
                "avg_frame_desc_words": "fw.w",
                "avg_frame_desc_sentences": "fw.s",
                "avg_shot_desc_words": "sw.w",
                "avg_shot_desc_sentences": "sw.s",
                "avg_gt_frame_desc_words": "fw.gw / gsum",
                "avg_gt_shot_desc_words": "sw.gw",
                "avg_doc_words": "bw.dw",
                "avg_doc_sentences": "bw.ds",
                "avg_summary_words": "bw.sw",
                "avg_summary_sentences": "bw.ss",
                "compression_ratio_words": "bw.dw / bw.sw",
                "compression_ratio_sentences": "bw.ds / bw.ss",
            }.items()
        )
        + ", v AS vocabulary_size FROM lv, fw, sw, bw, vocab",
    ),
)
def dataset_overview(spark, sf):
    docs = views.documents(spark, sf).select(
        F.lit("events").alias("dataset"),
        F.when(F.col("doc_id") % 4 == 0, "summary").otherwise("document").alias("block"),
        F.col("text").alias("raw_text"),
        F.lit(None).cast("long").alias("num_sentences"),
    )
    over = views.event_groups(spark, sf)
    out = ag.dataset_overview(labelled_frames(spark, sf, over), some_segments(spark, sf, gaps=False, over=over), docs)
    return rounded(out)


@query(
    "word_and_sentence_count",
    f"SELECT doc_id, {W('text')} AS n_words, {S('text')} AS n_sentences FROM documents",
)
def word_and_sentence_count(spark, sf):
    from spanforge.functions import text

    d = views.documents(spark, sf)
    return d.select(
        "doc_id",
        text.word_count(F.col("text")).alias("n_words"),
        text.sentence_count(F.col("text")).alias("n_sentences"),
    )


@query(
    "vocabulary_size",
    """SELECT lang, count(DISTINCT w) AS vocabulary_size FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM documents) GROUP BY lang""",
)
def vocabulary_size(spark, sf):
    return ag.vocabulary_size(views.documents(spark, sf), "text", ["lang"])


DESCRIBE = ", ".join(
    f"{R6(e)} AS {n}"
    for n, e in {
        "mean": "avg(v)",
        "median": "quantile_cont(v, 0.5)",
        "std": "stddev_pop(v)",
        "min": "min(v)",
        "max": "max(v)",
        "percentile_25": "quantile_cont(v, 0.25)",
        "percentile_75": "quantile_cont(v, 0.75)",
        "percentile_99_9": "quantile_cont(v, 0.999)",
    }.items()
)


@query("describe", f"SELECT count(v) AS n, {DESCRIBE} FROM (SELECT l_extendedprice AS v FROM lineitem)")
def describe(spark, sf):
    return rounded(ag.describe(views.table(spark, sf, "lineitem"), "l_extendedprice"))


@query("describe_by", f"SELECT k, count(v) AS n, {DESCRIBE} FROM (SELECT l_returnflag AS k, l_quantity AS v FROM lineitem) GROUP BY k")
def describe_by(spark, sf):
    out = ag.describe(views.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "k"), "l_quantity", ["k"])
    return rounded(out)


@query("compression_ratio", with_ctes(FRAMES, body=f"SELECT video_id, {R6('avg(gtscore)')} AS compression_ratio FROM frames GROUP BY video_id"))
def compression_ratio(spark, sf):
    return rounded(ag.compression_ratio(views.frames(spark, sf)).drop("dataset"))


KTS = f"""SELECT count(DISTINCT video_id) AS total_videos, CAST(sum(n_sampled) AS BIGINT) AS total_frames, count(*) AS total_segments,
  {R6("sum(n_sampled) / count(*)")} AS avg_ratio"""


@query("kts_summary", with_ctes(FRAMES, SHOT_FRAMES, SEGMENTS, body=f"{KTS} FROM segments"))
def kts_summary(spark, sf):
    return rounded(ag.kts_summary(views.segments(spark, sf)))


@query(
    "selection_summary",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body=f"{KTS}, CAST(sum(shot_level_gt) AS BIGINT) AS selected_segments, {R6('sum(shot_level_gt) / count(*)')} AS selected_share FROM segments",
    ),
)
def selection_summary(spark, sf):
    return rounded(ag.kts_summary(views.segments(spark, sf), selected=True))


@query(
    "ordered_text_agg",
    with_ctes(
        FRAMES,
        body="""SELECT video_id, step // 40 AS page, count(*) AS n_lines, string_agg('Frame ' || (step + 1) || ': ' ||
        CASE WHEN status = 1 THEN '[no description]' ELSE description END, chr(10) ORDER BY step) AS block_text FROM frames GROUP BY video_id, step // 40""",
    ),
)
def ordered_text_agg(spark, sf):
    f = views.frames(spark, sf).withColumn("description", F.when(F.col("status") == 0, F.col("description")))
    out = ag.ordered_text_agg(f, [F.col("step")], "description", lines_per_page=40)
    return out.drop("dataset")


@query(
    "document_text",
    with_ctes(
        SENTENCES,
        body="""SELECT video_id, block, sentence_id // 1000 AS page, count(*) AS n_lines, string_agg((sentence_id + 1) || '. ' || text, chr(10) ORDER BY sentence_id) AS block_text
        FROM sentences GROUP BY video_id, block, sentence_id // 1000""",
    ),
)
def document_text(spark, sf):
    s = views.sentences(spark, sf)
    out = ag.ordered_text_agg(
        s, [F.col("sentence_id")], "text", label="{}. ", empty="[no content]", keys=[*KEYS, "block"]
    )
    return out.drop("dataset")
