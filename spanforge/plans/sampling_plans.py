"""Sampling, shuffling, thinning and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import index, text
from spanforge.operators import groundtruth as gt
from spanforge.operators import parsing as ps
from spanforge.operators import sampling as sm
from spanforge.operators.ordered import KEYS
from spanforge.plans.registry import R6, query, with_ctes
from spanforge.plans.stats_plans import rounded
from spanforge.plans.text_plans import INDEX_ANSWERS, ORDER_CTES, RANK_IDS, index_answers, joined
from spanforge.sources import views
from spanforge.sources.views import FRAMES, ORDER_LINES, SEGMENTS, SENTENCES, SHOT_FRAMES, TASK_ITEMS


@query("sample_per_group", with_ctes(ORDER_LINES, TASK_ITEMS, body="SELECT video_id, item_key, n_items, orig_pos FROM task_items"))
def sample_per_group(spark, sf):
    return views.task_items(spark, sf).select("video_id", "item_key", "n_items", "orig_pos")


@query(
    "sample_per_group_video_salt",
    with_ctes(
        SENTENCES,
        """drawn AS (SELECT *, row_number() OVER (PARTITION BY video_id, block ORDER BY md5(concat_ws(':', '7', video_id, sentence_id)), sentence_id) AS r FROM sentences)""",
        body="""SELECT video_id, block, sentence_id, row_number() OVER (PARTITION BY video_id, block ORDER BY sentence_id) - 1 AS orig_pos FROM drawn WHERE r <= 3""",
    ),
)
def sample_per_group_video_salt(spark, sf):
    out = sm.sample_per_group(
        views.sentences(spark, sf), 3, 7, [F.col("sentence_id")], [*KEYS, "block"], ["video_id"], "sentence_id"
    )
    return out.select("video_id", "block", "sentence_id", "orig_pos")


@query("shuffle_per_group", with_ctes(ORDER_LINES, TASK_ITEMS, body="SELECT video_id, orig_pos, display_pos FROM task_items"))
def shuffle_per_group(spark, sf):
    return views.task_items(spark, sf).select("video_id", "orig_pos", "display_pos")


@query(
    "unshuffle_answers",
    with_ctes(
        *ORDER_CTES,
        RANK_IDS,
        """p AS (SELECT video_id, CAST(unnest(said) AS BIGINT) AS display_pos, generate_subscripts(said, 1) AS pos FROM judged WHERE failure_reason IS NULL)""",
        body="SELECT video_id, pos, orig_pos FROM p JOIN task_items USING (video_id, display_pos)",
    ),
)
def unshuffle_answers(spark, sf):
    said = ps.explode_predictions(ps.parse_ranking_reasoned(views.ranking_answers(spark, sf)))
    return sm.to_original(said, views.task_items(spark, sf)).select("video_id", "pos", "orig_pos")


def uniform_sql(rows: str, key: str, n: str, pos: str, k: str) -> str:
    """Rows at the points of a truncated even spacing, found by generating the points."""
    return f"""
sizes AS (SELECT DISTINCT {key}, {n} AS n, {k} AS k FROM {rows}),
points AS (SELECT {key}, n, k, unnest(range(0, least(n, k))) AS slot FROM sizes),
targets AS (SELECT {key}, slot, CASE WHEN n <= k THEN slot WHEN k = 1 THEN 0 WHEN slot = k - 1 THEN n - 1
  ELSE CAST(floor(CAST(slot AS DOUBLE) * (CAST(n - 1 AS DOUBLE) / (k - 1))) AS BIGINT) END AS {pos} FROM points)
"""


@query(
    "thin_uniform",
    with_ctes(FRAMES, uniform_sql("frames", "video_id", "n_steps", "step", "23"), body="SELECT video_id, slot, pick FROM targets JOIN frames USING (video_id, step)"),
)
def thin_uniform(spark, sf):
    f = gt.with_group_size(views.frames(spark, sf), "n_steps", None)
    return sm.thin_uniform(f, F.lit(23).cast("long"), "step", "n_steps").select("video_id", "slot", "pick")


SHOT_POS = """
shot_pos AS (SELECT video_id, shot_idx, pick, gtscore, row_number() OVER (PARTITION BY video_id, shot_idx ORDER BY step) - 1 AS pos,
  count(*) OVER (PARTITION BY video_id, shot_idx) AS n FROM shot_frames)
"""


def shot_positions(spark, sf):
    """Frames with position and size inside their shot; blocks start at a multiple of their size."""
    f = views.shot_frames(spark, sf)
    n_segments = F.greatest(F.lit(1).cast("long"), F.floor(F.col("n_steps") / 10))
    size = F.floor(F.col("n_steps") / n_segments)
    n = F.when(F.col("shot_idx") == n_segments - 1, F.col("n_steps") - size * (n_segments - 1)).otherwise(size)
    return f.withColumns({"shot_pos": F.col("step") - F.col("shot_idx") * size, "n_in_shot": n})


@query(
    "thin_uniform_per_shot",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SHOT_POS,
        uniform_sql("shot_pos", "video_id, shot_idx", "n", "pos", "4"),
        body="SELECT video_id, shot_idx, slot, pick FROM targets JOIN shot_pos USING (video_id, shot_idx, pos)",
    ),
)
def thin_uniform_per_shot(spark, sf):
    out = sm.thin_uniform(shot_positions(spark, sf), F.lit(4).cast("long"), "shot_pos", "n_in_shot")
    return out.select("video_id", "shot_idx", "slot", "pick")


@query(
    "thin_stride",
    with_ctes(
        FRAMES,
        """points AS (SELECT DISTINCT video_id, n_steps, unnest(range(0, 64)) AS slot FROM frames)""",
        """t AS (SELECT video_id, slot, CASE WHEN n_steps <= 64 THEN least(slot, n_steps - 1) ELSE CAST(floor(CAST(slot * n_steps AS DOUBLE) / 64) AS BIGINT) END AS step FROM points)""",
        body="SELECT video_id, slot, pick FROM t JOIN frames USING (video_id, step)",
    ),
)
def thin_stride(spark, sf):
    f = gt.with_group_size(views.frames(spark, sf), "n_steps", None)
    return sm.thin_stride(f, F.lit(64).cast("long"), "step", "n_steps").select("video_id", "slot", "pick")


@query("thin_truncate", with_ctes(FRAMES, body="SELECT video_id, step FROM frames WHERE step < 40"))
def thin_truncate(spark, sf):
    return sm.thin_truncate(views.frames(spark, sf), F.lit(40), "step").select("video_id", "step")


@query(
    "shot_frame_budget",
    """SELECT l_orderkey, n, greatest(4, least(8, CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT))) AS standard,
    greatest(1, least(4, CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT))) AS compact,
    least(n, greatest(1, least(1, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS BIGINT)))) AS single
    FROM (SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) % 45 AS n FROM lineitem GROUP BY l_orderkey)""",
)
def shot_frame_budget(spark, sf):
    n = F.col("n")
    shots = views.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum(F.col("l_quantity").cast("long")) % 45).alias("n"))
    return shots.select(
        "l_orderkey",
        "n",
        index.shot_budget(n, 0.30, 4, 8).alias("standard"),
        index.shot_budget(n, 0.30, 1, 4).alias("compact"),
        index.shot_budget(n, 0.10, 1, 1, at_most_n=True).alias("single"),
    )


@query(
    "global_cap",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body="""SELECT video_id, shot_idx, CASE WHEN sum(n_sampled) OVER w > 65 THEN least(n_sampled, greatest(1, 65 // count(*) OVER w)) ELSE n_sampled END AS take
        FROM segments WINDOW w AS (PARTITION BY video_id)""",
    ),
)
def global_cap(spark, sf):
    return sm.global_cap(views.segments(spark, sf), 65).select("video_id", "shot_idx", "take")


@query(
    "global_budget_truncate",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        """o AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS k FROM segments)""",
        """walk AS (SELECT video_id, -1::BIGINT AS shot_idx, 35::BIGINT AS remaining, 0::BIGINT AS take FROM segments GROUP BY video_id
          UNION ALL SELECT w.video_id, s.shot_idx, greatest(0, w.remaining - least(s.n_sampled, greatest(1, w.remaining))), least(s.n_sampled, greatest(1, w.remaining))
          FROM walk w JOIN o s ON s.video_id = w.video_id AND s.shot_idx = w.shot_idx + 1)""",
        body="SELECT video_id, shot_idx, take FROM walk WHERE shot_idx >= 0",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def global_budget_truncate(spark, sf):
    return sm.global_budget_truncate(views.segments(spark, sf), 35).select("video_id", "shot_idx", "take")


@query(
    "global_budget_share",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body="""SELECT video_id, shot_idx, CASE WHEN sum(n_sampled) OVER w <= 55 THEN n_sampled ELSE least(n_sampled, greatest(1,
        CAST(round_even(CAST(n_sampled AS DOUBLE) / sum(n_sampled) OVER w * 55, 0) AS BIGINT))) END AS take FROM segments WINDOW w AS (PARTITION BY video_id)""",
    ),
)
def global_budget_share(spark, sf):
    return sm.global_budget_share(views.segments(spark, sf), 55).select("video_id", "shot_idx", "take")


@query(
    "budget_from_context",
    "SELECT p_partkey, greatest(1, (coalesce(CASE WHEN p_size % 5 > 0 THEN p_size * 1000 END, 32768) - 500) // (200 + p_partkey % 90)) AS max_frames FROM part",
)
def budget_from_context(spark, sf):
    context = F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 1000)
    frames = index.frames_in_context(context, 500, F.col("p_partkey") % 90 + 200)
    return views.table(spark, sf, "part").select("p_partkey", frames.alias("max_frames"))


@query(
    "representatives",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SHOT_POS,
        """all_shots AS (SELECT video_id, shot_idx, n, 0 AS empty FROM shot_pos GROUP BY ALL UNION ALL SELECT video_id, 100, 0, 1 FROM shot_pos GROUP BY video_id)""",
        """sizes AS (SELECT video_id, shot_idx, n, greatest(1, CAST(ceil(n * CAST(0.2 AS DOUBLE)) AS BIGINT)) AS k FROM all_shots)""",
        """points AS (SELECT *, unnest(range(0, k)) AS slot FROM sizes)""",
        """targets AS (SELECT *, CASE WHEN n <= k OR k = 1 THEN slot WHEN slot = k - 1 THEN n - 1 ELSE CAST(floor(slot * (CAST(n - 1 AS DOUBLE) / (k - 1))) AS BIGINT) END AS pos FROM points)""",
        body="""SELECT t.video_id, t.shot_idx, slot, coalesce(pick, -1) AS pick, coalesce(gtscore, 0) AS gtscore FROM targets t
        LEFT JOIN shot_pos s ON s.video_id = t.video_id AND s.shot_idx = t.shot_idx AND s.pos = t.pos""",
    ),
)
def representatives(spark, sf):
    return reps(spark, sf).drop("dataset")


def reps(spark, sf):
    f = shot_positions(spark, sf)
    shots = f.groupBy(*KEYS, "shot_idx").agg(F.count(F.lit(1)).alias("n_sampled"))
    empty = shots.select(*KEYS).distinct().select(*KEYS, F.lit(100).cast("long").alias("shot_idx"), F.lit(0).cast("long").alias("n_sampled"))
    return sm.representatives(f, shots.unionByName(empty))


@query(
    "topk_of_submitted",
    with_ctes(
        FRAMES,
        """s AS (SELECT video_id, step // 2 AS pos, round(gtscore / 20) AS g FROM frames WHERE step % 2 = 0)""",
        """r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY g DESC, pos) AS r, count(*) OVER (PARTITION BY video_id) AS n FROM s)""",
        body="SELECT video_id, pos, CASE WHEN r <= greatest(1, CAST(ceil(n * CAST(0.15 AS DOUBLE)) AS BIGINT)) THEN 1 ELSE 0 END AS is_gt FROM r",
    ),
)
def topk_of_submitted(spark, sf):
    f = views.frames(spark, sf).filter("step % 2 = 0")
    sent = f.select(*KEYS, F.floor(F.col("step") / 2).alias("pos"), F.round(F.col("gtscore") / 20).alias("gtscore"))
    return sm.topk_of_submitted(sent).select("video_id", "pos", "is_gt")


@query(
    "dedup_keep_first",
    with_ctes(
        *ORDER_CTES,
        INDEX_ANSWERS,
        """raws AS (SELECT video_id, n_items, n_select, regexp_extract_all(raw, '\\b\\d+\\b') AS said FROM index_answers)""",
        """firsts AS (SELECT video_id, n_select, x, row_number() OVER (PARTITION BY video_id ORDER BY p) AS r FROM (SELECT video_id, n_items, n_select, CAST(x AS BIGINT) AS x, min(p) AS p
             FROM (SELECT video_id, n_items, n_select, unnest(said) AS x, generate_subscripts(said, 1) AS p FROM raws) WHERE CAST(x AS BIGINT) BETWEEN 1 AND n_items GROUP BY ALL))""",
        body="SELECT video_id, string_agg(CAST(x AS VARCHAR), ',' ORDER BY r) AS ids FROM firsts WHERE r <= n_select GROUP BY video_id",
    ),
)
def dedup_keep_first(spark, sf):
    ids = text.integers(F.col("raw_output"), r"\b\d+\b")
    kept = sm.dedup_keep_first(ids, 1, F.col("n_items"), F.col("n_select"))
    out = index_answers(spark, sf).withColumn("kept", kept).filter(F.size("kept") > 0)
    return out.select("video_id", joined("kept").alias("ids"))


@query(
    "thirds",
    with_ctes(FRAMES, body="""SELECT video_id, step, CASE WHEN step < n_steps // 3 THEN 'first_third' WHEN step < 2 * n_steps // 3 THEN 'middle_third' ELSE 'last_third' END AS part FROM frames"""),
)
def thirds(spark, sf):
    f = gt.with_group_size(views.frames(spark, sf), "n_steps", None)
    return f.select("video_id", "step", sm.thirds(F.col("step"), F.col("n_steps")).alias("part"))


@query(
    "stride_from_picks",
    """SELECT l_orderkey, CASE WHEN count(*) > 1 THEN max(CASE WHEN r = 2 THEN c END) - max(CASE WHEN r = 1 THEN c END) ELSE 30 END AS stride FROM
    (SELECT l_orderkey, l_partkey AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) GROUP BY l_orderkey""",
)
def stride_from_picks(spark, sf):
    from spanforge.operators.ordered import with_position

    lines = views.order_lines(spark, sf)
    placed = with_position(lines, KEYS, [F.col(c) for c in views.LINE_ORDER], "step")
    out = sm.stride_from_picks(placed.withColumn("pick", F.col("l_partkey")))
    return out.select(F.col("video_id").cast("long").alias("l_orderkey"), "stride")


@query(
    "batches_by_length",
    "SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id) - 1) // 16 AS batch FROM documents",
)
def batches_by_length(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id", "n_chars")
    return sm.batches_by_length(docs, "n_chars", ["doc_id"], 16).select("doc_id", "batch")


@query(
    "run_centers",
    with_ctes(
        FRAMES,
        """v AS (SELECT video_id, step AS frame, step % 3 AS user_id, n_steps AS n FROM frames WHERE gtscore > 20),
        w AS (SELECT video_id, frame // 3 AS frame, user_id, n FROM v)""",
        """g AS (SELECT *, frame - row_number() OVER (PARTITION BY video_id, user_id ORDER BY frame) AS run FROM w)""",
        body=f"""SELECT video_id, user_id, min(frame) AS start, max(frame) + 1 AS stop, {R6("(min(frame) + max(frame) + 1) / 2.0::DOUBLE / max(n)")} AS center
        FROM g GROUP BY video_id, user_id, run""",
    ),
)
def run_centers(spark, sf):
    f = gt.with_group_size(views.frames(spark, sf), "n_steps", None).filter("gtscore > 20")
    votes = f.select(
        *KEYS, (F.col("step") % 3).alias("user_id"), F.floor(F.col("step") / 3).alias("frame"), F.col("n_steps").alias("n")
    )
    return rounded(sm.run_centers(votes, "n").drop("dataset"))
