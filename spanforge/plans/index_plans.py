"""Frame numbering and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators import index as ops
from spanforge.operators import joins
from spanforge.operators.ordered import KEYS
from spanforge.plans.registry import query, with_ctes
from spanforge.sources import views
from spanforge.sources.views import FRAMES, SEGMENTS, SENTENCES, SHOT_FRAMES


def clip_sizes(spark, sf):
    """Orders as clips: n sampled frames, n_total frames, frames per second."""
    return views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("long")).alias("n_total"),
        (F.lit(1.5) + F.max("l_tax") * 100).alias("fps"),
    ).withColumnRenamed("l_orderkey", "clip")


CLIPS = """
clips AS (
  SELECT l_orderkey AS clip, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n_total,
         CAST(1.5 AS DOUBLE) + max(l_tax) * 100 AS fps
  FROM lineitem GROUP BY l_orderkey)
"""

STEPS = """
steps AS (SELECT *, unnest(range(n)) AS step FROM clips)
"""


@query("normalize_id", "SELECT c_custkey, regexp_replace('video' || c_custkey || '_' || c_name, 'video([0-9]+)', 'video_\\1') AS video_id FROM customer")
def normalize_id(spark, sf):
    raw = F.concat(F.lit("video"), F.col("c_custkey").cast("string"), F.lit("_"), F.col("c_name"))
    return views.table(spark, sf, "customer").select("c_custkey", text.normalize_id(raw).alias("video_id"))


POINT = "CASE WHEN step = 0 THEN 0.0::DOUBLE WHEN step = n - 1 THEN CAST(n_total - 1 AS DOUBLE) ELSE CAST(step AS DOUBLE) * (CAST(n_total - 1 AS DOUBLE) / (n - 1)) END"


@query(
    "picks_linspace",
    with_ctes(CLIPS, STEPS, body=f"SELECT clip, step, CAST(round_even({POINT}, 0) AS BIGINT) AS pick FROM steps"),
)
def picks_linspace(spark, sf):
    return ops.picks_linspace(clip_sizes(spark, sf)).select("clip", "step", "pick")


@query(
    "picks_linspace_or_all",
    with_ctes(
        CLIPS,
        STEPS,
        body=f"""SELECT clip, step, CASE WHEN n >= n_total THEN step ELSE CAST(round_even({POINT}, 0) AS BIGINT) END AS pick
        FROM steps WHERE step < n_total""",
    ),
)
def picks_linspace_or_all(spark, sf):
    return ops.picks_linspace(clip_sizes(spark, sf), identity_if_short=True).select("clip", "step", "pick")


@query(
    "picks_fps",
    with_ctes(
        CLIPS,
        STEPS,
        body="""SELECT clip, step, greatest(0, least(CAST(floor(CAST(step AS DOUBLE) * fps) AS BIGINT), n_total - 1)) AS pick,
        CAST(round_even(fps, 0) AS BIGINT) AS stride FROM steps""",
    ),
)
def picks_fps(spark, sf):
    return ops.picks_fps(clip_sizes(spark, sf)).select("clip", "step", "pick", "stride")


@query(
    "picks_stride",
    with_ctes(
        CLIPS,
        """strided AS (SELECT clip, n_total, greatest(1, CAST(round_even(fps / 2.0::DOUBLE, 0) AS BIGINT)) AS stride FROM clips)""",
        body="SELECT clip, pick // stride AS step, pick FROM (SELECT clip, stride, unnest(range(0, n_total, stride)) AS pick FROM strided)",
    ),
)
def picks_stride(spark, sf):
    out = ops.picks_stride(clip_sizes(spark, sf), target=2.0)
    return out.select("clip", F.col("step").cast("long").alias("step"), "pick")


@query(
    "picks_default",
    with_ctes(FRAMES, body="SELECT video_id, step, CASE WHEN status = 1 THEN step * 15 ELSE step * 30 END AS pick FROM frames"),
)
def picks_default(spark, sf):
    f = views.frames(spark, sf).withColumn("pick", F.when(F.col("status") == 0, F.col("step") * 30))
    return ops.picks_default(f).select("video_id", "step", "pick")


@query(
    "remap_to_original",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body="""SELECT s.video_id, shot_idx, a.pick AS start_pick, b.pick AS end_pick FROM segments s
        JOIN frames a ON a.video_id = s.video_id AND a.step = s."start"
        JOIN frames b ON b.video_id = s.video_id AND b.step = s."end" """,
    ),
)
def remap_to_original(spark, sf):
    out = joins.remap_to_original(views.segments(spark, sf), views.frames(spark, sf))
    return out.select("video_id", "shot_idx", "start_pick", "end_pick")


@query(
    "detect_index_space",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body="""SELECT video_id, CAST(max("end" * CASE WHEN substr(md5(video_id), 1, 1) < '8' THEN 15 ELSE 1 END) >= max(n_steps)
        AND max(n_steps) > 1 AS INT) AS original_space FROM segments GROUP BY video_id""",
    ),
)
def detect_index_space(spark, sf):
    scale = F.when(views.tag() < "8", 15).otherwise(1)
    s = views.segments(spark, sf).withColumn("end", F.col("end") * scale)
    return ops.detect_index_space(s).select("video_id", "original_space")


@query(
    "coalesce_labels",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1) THEN 3 WHEN o_orderkey % 5 IN (2, 3) THEN 2 END AS gt_label_size,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 + 1 WHEN o_orderkey % 5 = 4 THEN NULL
         WHEN o_orderkey % 2 = 0 THEN 4 WHEN o_orderkey % 5 IN (1, 2, 3) THEN 2 ELSE NULL END AS n_frames FROM orders""",
)
def coalesce_labels(spark, sf):
    k = F.col("o_orderkey")
    ones = lambda n: F.array_repeat(F.lit(1), n)
    raw = views.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(k % 3 == 0, k % 7 + 1).when(k % 3 == 1, F.lit(0)).alias("n_frames"),
        F.when((k % 2 == 0) & (k % 5 != 4), ones(4)).alias("gtscore"),
        F.when(k % 5 < 2, ones(3)).alias("gtframe"),
        F.when(k % 5 == 2, ones(2)).alias("gtsummary"),
        F.when((k % 5 == 3) | (k % 5 == 1), ones(2)).alias("gt_summary"),
    )
    out = ops.coalesce_labels(raw)
    return out.select(
        "o_orderkey", F.nullif(F.size("gt_label"), F.lit(-1)).alias("gt_label_size"), "n_frames"
    )


@query(
    "encode_status",
    "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS status FROM events",
)
def encode_status(spark, sf):
    raw = (
        F.when(F.col("event_type") == "view", "ok")
        .when(F.col("event_type") == "click", "OK")
        .when(F.col("event_type") == "error", "filtered")
    )
    return views.table(spark, sf, "events").select("event_id", text.encode_status(raw).alias("status"))


@query(
    "valid_text",
    """SELECT doc_id, length(t) AS n FROM (SELECT doc_id, CASE substr(md5(CAST(doc_id AS VARCHAR)), 1, 1)
      WHEN '0' THEN NULL WHEN '1' THEN '' WHEN '2' THEN ' \t ' WHEN '3' THEN '[CONTENT_FILTERED]' WHEN '4' THEN 'NaN'
      ELSE text END AS t FROM documents)
    WHERE t IS NOT NULL AND trim(t, ' \t\n\r') <> '' AND t NOT IN ('[CONTENT_FILTERED]', 'NaN')""",
)
def valid_text(spark, sf):
    t = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1)
    raw = (
        F.when(t == "0", None)
        .when(t == "1", "")
        .when(t == "2", " \t ")
        .when(t == "3", text.FILTERED)
        .when(t == "4", "NaN")
        .otherwise(F.col("text"))
    )
    d = views.table(spark, sf, "documents").select("doc_id", raw.alias("t"))
    return ops.valid_rows(d, "t").select("doc_id", F.length("t").cast("long").alias("n"))


@query(
    "gt_filter",
    with_ctes(FRAMES, SHOT_FRAMES, SEGMENTS, body="SELECT video_id, shot_idx FROM segments WHERE shot_level_gt = 1"),
)
def gt_filter(spark, sf):
    return ops.gt_filter(views.segments(spark, sf)).select("video_id", "shot_idx")


@query(
    "nested_get",
    """SELECT event_type, count(v) AS n, avg(v) AS mean_k FROM (SELECT event_type,
    CASE WHEN event_type = 'view' THEN NULL ELSE CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) END AS v FROM events)
    GROUP BY event_type""",
)
def nested_get(spark, sf):
    e = views.table(spark, sf, "events")
    inner = F.from_json("props", "k BIGINT")
    wrapped = F.when(F.col("event_type") != "view", F.struct(inner.alias("eval")))
    value = ops.nested_get(wrapped, "eval", "k")
    return e.select("event_type", value.alias("v")).groupBy("event_type").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean_k")
    )


@query(
    "usable_shots",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        body="""SELECT video_id, shot_idx, n_sampled FROM (SELECT video_id, shot_idx, count(*) FILTER (WHERE status = 1) AS n_sampled
        FROM shot_frames GROUP BY video_id, shot_idx) WHERE n_sampled > 0""",
    ),
)
def usable_shots(spark, sf):
    s = views.shot_frames(spark, sf).groupBy("video_id", "shot_idx").agg(F.count_if(F.col("status") == 1).alias("n_sampled"))
    return ops.usable_shots(s)


@query(
    "expand_shot_range",
    with_ctes(
        SENTENCES,
        body="""SELECT video_id, block, sentence_id, unnest(CASE WHEN sentence_id % 2 = 0 THEN [shot_ids[1], shot_ids[2], shot_ids[2] + 1]
        ELSE [shot_ids[1]] END) AS shot_id FROM sentences""",
    ),
)
def expand_shot_range(spark, sf):
    x, y = F.col("shot_ids")[0].cast("string"), (F.col("shot_ids")[1] + 1).cast("string")
    tag = F.when(F.col("sentence_id") % 2 == 0, F.concat(F.lit("[Shots "), x, F.lit("-"), y, F.lit("] a"))).otherwise(
        F.concat(F.lit("[shot "), x, F.lit("] b"))
    )
    s = views.sentences(spark, sf).withColumn("tag", tag)
    return ops.expand_shot_range(s).select("video_id", "block", "sentence_id", "shot_id")


@query(
    "reconstruct_picks",
    with_ctes(FRAMES, body="SELECT video_id, step, pick FROM frames WHERE status = 0"),
)
def reconstruct_picks(spark, sf):
    f = views.frames(spark, sf)
    ending = F.when(F.col("status") == 0, ".jpg").otherwise(".png")
    path = F.concat(F.lit("user1/"), "video_id", F.lit("/frame"), (F.col("pick") + 1).cast("string"), ending)
    out = ops.reconstruct_picks(f.select(*KEYS, "step", path.alias("path")), offset=-1)
    return out.select("video_id", "step", "pick")
