"""Scores, segments, budgeted selection and key frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.functions import index
from spanforge.operators import groundtruth as gt
from spanforge.operators import joins
from spanforge.operators.ordered import KEYS, find_oversize
from spanforge.plans.registry import R6, query, r6, with_ctes
from spanforge.sources import views
from spanforge.sources.views import FEATURE_FRAMES, FRAMES, ORDER_LINES, SEGMENTS, SHOT_FRAMES, VOTES


# Steps that one row spells out.
STEP_BLOCK = 65_536


@query(
    "votes_to_score",
    with_ctes(
        VOTES,
        """picks AS (SELECT video_id, unnest(range(0, last + 1)) AS pick FROM (SELECT video_id, max(frame) AS last FROM votes GROUP BY video_id))""",
        """users AS (SELECT video_id, count(DISTINCT user_id) AS n FROM votes GROUP BY video_id)""",
        body=f"""SELECT p.video_id, p.pick, {R6("count(v.user_id) / any_value(u.n)")} AS gtscore FROM picks p
        JOIN users u USING (video_id) LEFT JOIN votes v ON v.video_id = p.video_id AND v.frame = p.pick GROUP BY p.video_id, p.pick""",
    ),
)
def votes_to_score(spark, sf):
    votes = views.votes(spark, sf)
    grid = F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("step")
    picks = views.last_frames(votes).select(*KEYS, grid).withColumn("pick", F.col("step"))
    out = gt.votes_to_score(picks, votes, votes.select(*KEYS, "user_id"))
    return out.select("video_id", "pick", r6("gtscore").alias("gtscore"))


@query(
    "project_votes",
    with_ctes(
        VOTES,
        """lasts AS (SELECT video_id, max(frame) AS last FROM votes GROUP BY video_id)""",
        """picks AS (SELECT video_id, last, unnest(range(0, last + 1)) AS step FROM lasts)""",
        """valid AS (SELECT video_id, (step * 37) % (last + 101) AS pick,
             row_number() OVER (PARTITION BY video_id ORDER BY step) - 1 AS packed FROM picks WHERE (step * 37) % (last + 101) <= last)""",
        body="""SELECT v.video_id, user_id, packed AS step FROM valid v JOIN votes o ON o.video_id = v.video_id AND o.frame = v.pick""",
    ),
)
def project_votes(spark, sf):
    votes = views.votes(spark, sf)
    lasts = views.last_frames(votes)
    # The few rows of the groups would meet in one task, and all their steps with them, so blocks of steps are dealt out first.
    blocks = lasts.select(*KEYS, "last", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), F.lit(STEP_BLOCK))).alias("first"))
    steps = F.sequence(F.col("first"), F.least(F.col("first") + STEP_BLOCK - 1, F.col("last")))
    grid = blocks.repartition(*KEYS, "first").select(*KEYS, "last", F.explode(steps).alias("step"))
    # Picks in another order than the steps, some beyond the annotated length.
    picks = grid.select(*KEYS, "step", (F.col("step") * 37 % (F.col("last") + 101)).alias("pick"))
    out = gt.project_votes(picks, votes, lasts.select(*KEYS, (F.col("last") + 1).alias("n_frames")))
    return out.select("video_id", "user_id", "step")


@query(
    "segment_uniform",
    with_ctes(FRAMES, SHOT_FRAMES, body="SELECT video_id, step, n_steps, shot_idx FROM shot_frames"),
)
def segment_uniform(spark, sf):
    return views.shot_frames(spark, sf).select("video_id", "step", "n_steps", "shot_idx")


@query(
    "segment_score",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body=f"""SELECT s.video_id, s.shot_idx, {R6("coalesce(avg(f.gtscore), 0)")} AS score, greatest(count(f.step), 1) AS length
        FROM segments s LEFT JOIN frames f ON f.video_id = s.video_id AND f.step BETWEEN s."start" + 3 AND s."end" - s.shot_idx * 2
        GROUP BY s.video_id, s.shot_idx""",
    ),
)
def segment_score(spark, sf):
    over = views.event_groups(spark, sf)
    s = views.segments(spark, sf, over).select(
        *KEYS, "shot_idx", (F.col("start") + 3).alias("start"), (F.col("end") - F.col("shot_idx") * 2).alias("end")
    )
    out = gt.segment_score(views.frames(spark, sf, over), s)
    return out.select("video_id", "shot_idx", r6("score").alias("score"), "length")


LINE_ITEMS = """
items AS (
  SELECT dataset, video_id, row_number() OVER (PARTITION BY video_id ORDER BY l_linenumber, l_partkey, l_suppkey, cents) - 1 AS shot_idx,
         weight, score AS value, CAST(floor(CAST(0.4 AS DOUBLE) * CAST(sum(weight) OVER (PARTITION BY video_id) AS DOUBLE)) AS BIGINT) AS capacity,
         count(*) OVER (PARTITION BY video_id) AS n
  FROM order_lines)
"""


def line_items(spark, sf):
    """Order lines as weighted items with a budget of 40 % of the total weight."""
    from spanforge.operators.ordered import with_position

    lines = views.order_lines(spark, sf)
    limit = gt.fold_limit(spark)
    over = find_oversize(views.table(spark, sf, "lineitem"), ["l_orderkey"], limit)
    over = over if over.empty else find_oversize(lines, KEYS, limit)
    placed = with_position(lines, KEYS, [F.col(c) for c in views.LINE_ORDER], "shot_idx", over)
    sized = gt.with_group_total(placed, "weight", "_w", over)
    items = sized.select(
        *KEYS, "shot_idx", "weight", F.col("score").alias("value"), index.portion_floor(0.4, F.col("_w")).alias("capacity")
    )
    return items, over


@query(
    "select_under_budget",
    with_ctes(
        ORDER_LINES,
        LINE_ITEMS,
        """RECURSIVE_MARK""",
        body="",
    ).replace("WITH ", "WITH RECURSIVE ", 1).replace(
        "RECURSIVE_MARK",
        """walk AS (
      SELECT video_id, 0 AS k, 0::BIGINT AS w, 0::DOUBLE AS v, 0::BIGINT AS taken, any_value(n) AS n, any_value(capacity) AS capacity FROM items GROUP BY video_id
      UNION ALL
      SELECT x.video_id, x.k + 1, x.w + t.take * i.weight, x.v + t.take * i.value, x.taken + t.take * (1::BIGINT << x.k), x.n, x.capacity
      FROM walk x JOIN items i ON i.video_id = x.video_id AND i.shot_idx = x.k
      CROSS JOIN (VALUES (0), (1)) t(take)
      WHERE x.w + t.take * i.weight <= x.capacity OR t.take = 0),
    ended AS (SELECT *, max(v) OVER (PARTITION BY video_id) AS most FROM walk WHERE k = n),
    best AS (SELECT video_id, min(taken) AS taken FROM ended WHERE v = most AND most > 0 GROUP BY video_id)""",
    )
    + """SELECT video_id, shot_idx, value FROM items JOIN best USING (video_id) WHERE (taken >> shot_idx) & 1 = 1""",
)
def select_under_budget(spark, sf):
    items, over = line_items(spark, sf)
    return gt.select_under_budget(items, over=over, values=True).select("video_id", "shot_idx", "value")


@query(
    "select_greedy",
    with_ctes(
        ORDER_LINES,
        LINE_ITEMS,
        """sorted AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY value / (weight + 1e-8) DESC, shot_idx DESC) AS r FROM items)""",
        """walk AS (
          SELECT video_id, 0::BIGINT AS r, 0::BIGINT AS used, -1::BIGINT AS shot_idx, false AS took FROM items GROUP BY video_id
          UNION ALL
          SELECT w.video_id, s.r, CASE WHEN w.used + s.weight <= s.capacity THEN w.used + s.weight ELSE w.used END,
                 s.shot_idx, w.used + s.weight <= s.capacity
          FROM walk w JOIN sorted s ON s.video_id = w.video_id AND s.r = w.r + 1)""",
        body="SELECT video_id, shot_idx FROM walk WHERE took",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def select_greedy(spark, sf):
    items, over = line_items(spark, sf)
    return gt.select_greedy(items, over=over).select("video_id", "shot_idx")


FLAGGED = """
flagged AS (SELECT video_id, shot_idx, score, CASE WHEN score > 65 THEN 1 ELSE 0 END AS selected FROM segments)
"""


@query(
    "force_best_if_empty",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        FLAGGED,
        body="""SELECT video_id, shot_idx, CASE WHEN sum(selected) OVER (PARTITION BY video_id) = 0 AND sum(score) OVER (PARTITION BY video_id) > 0
        AND row_number() OVER (PARTITION BY video_id ORDER BY score DESC, shot_idx) = 1 THEN 1 ELSE selected END AS selected FROM flagged""",
    ),
)
def force_best_if_empty(spark, sf):
    s = views.segments(spark, sf).withColumn("selected", (F.col("score") > 65).cast("int"))
    return gt.force_best_if_empty(s).select("video_id", "shot_idx", "selected")


@query(
    "topk_frames",
    with_ctes(
        FRAMES,
        body="""SELECT video_id, step, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY gtscore DESC, step DESC)
        <= least(n_steps, greatest(1, CAST(round_even(n_steps * CAST(0.15 AS DOUBLE), 0) AS BIGINT))) THEN 1 ELSE 0 END AS gtframe FROM frames""",
    ),
)
def topk_frames(spark, sf):
    over = views.event_groups(spark, sf)
    return gt.topk_frames(views.frames(spark, sf, over), over=over).select("video_id", "step", "gtframe")


@query(
    "argmax_per_shot",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        body="""SELECT video_id, shot_idx, step, gtscore FROM (SELECT *, row_number() OVER (PARTITION BY video_id, shot_idx
        ORDER BY gtscore DESC, step) AS rn FROM shot_frames) WHERE rn = 1""",
    ),
)
def argmax_per_shot(spark, sf):
    return gt.argmax_per_shot(views.shot_frames(spark, sf)).select("video_id", "shot_idx", "step", "gtscore")


@query(
    "gt_frame_set",
    with_ctes(FRAMES, SHOT_FRAMES, SEGMENTS, body="""SELECT f.video_id, f.pick, f.shot_idx FROM shot_frames f
    JOIN segments s USING (video_id, shot_idx) WHERE s.shot_level_gt = 1"""),
)
def gt_frame_set(spark, sf):
    over = views.event_groups(spark, sf)
    out = joins.gt_frame_set(views.frames(spark, sf, over), views.segments(spark, sf, over), over)
    return out.select("video_id", "pick", "shot_idx")


ANNOTATED = """
peaks AS (SELECT video_id, shot_idx, pick, row_number() OVER (PARTITION BY video_id, shot_idx ORDER BY gtscore DESC, step) AS rn FROM shot_frames),
sorted AS (SELECT *, CAST(floor(CAST(0.15 AS DOUBLE) * CAST(n_steps AS DOUBLE)) AS BIGINT) AS capacity,
  row_number() OVER (PARTITION BY video_id ORDER BY score / (n_sampled + 1e-8) DESC, shot_idx DESC) AS r FROM segments),
walk AS (
  SELECT video_id, 0::BIGINT AS r, 0::BIGINT AS used, -1::BIGINT AS shot_idx, false AS took FROM segments GROUP BY video_id
  UNION ALL
  SELECT w.video_id, s.r, CASE WHEN w.used + s.n_sampled <= s.capacity THEN w.used + s.n_sampled ELSE w.used END,
         s.shot_idx, w.used + s.n_sampled <= s.capacity AND s.capacity > 0
  FROM walk w JOIN sorted s ON s.video_id = w.video_id AND s.r = w.r + 1),
chosen AS (SELECT s.*, CASE WHEN w.took THEN 1 ELSE 0 END AS sel FROM segments s JOIN walk w ON w.video_id = s.video_id AND w.shot_idx = s.shot_idx),
final AS (SELECT *, CASE WHEN sum(sel) OVER (PARTITION BY video_id) = 0 AND sum(score) OVER (PARTITION BY video_id) > 0
  AND row_number() OVER (PARTITION BY video_id ORDER BY score DESC, shot_idx) = 1 THEN 1 ELSE sel END AS selected FROM chosen)
"""


@query(
    "annotate_ground_truth",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        ANNOTATED,
        body=f"""SELECT f.video_id, f.shot_idx, "start", "end", "start" * 15 AS start_pick, "end" * 15 AS end_pick, n_sampled,
        {R6("score")} AS score, selected, CASE WHEN selected = 1 THEN p.pick END AS key_pick
        FROM final f JOIN peaks p ON p.video_id = f.video_id AND p.shot_idx = f.shot_idx AND p.rn = 1""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def annotate_ground_truth(spark, sf):
    limit = gt.annotation_limit(spark)
    over = find_oversize(views.table(spark, sf, "events"), ["user_id"], limit)
    over = find_oversize(views.frames(spark, sf), KEYS, limit) if not over.empty else over
    out = gt.annotate_ground_truth(views.frames(spark, sf, over), over=over)
    return out.drop("dataset").withColumn("score", r6("score"))


@query(
    "annotate_ground_truth_exact",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        """ordered AS (SELECT *, CAST(floor(CAST(0.15 AS DOUBLE) * CAST(n_steps AS DOUBLE)) AS BIGINT) AS capacity,
             count(*) OVER (PARTITION BY video_id) AS n FROM segments)""",
        """walk AS (
      SELECT video_id, 0 AS k, 0::BIGINT AS w, 0::DOUBLE AS v, 0::BIGINT AS taken, any_value(n) AS n FROM ordered GROUP BY video_id
      UNION ALL
      SELECT x.video_id, x.k + 1, x.w + t.take * i.n_sampled, x.v + t.take * i.score, x.taken + t.take * (1::BIGINT << x.k), x.n
      FROM walk x JOIN ordered i ON i.video_id = x.video_id AND i.shot_idx = x.k CROSS JOIN (VALUES (0), (1)) t(take)
      WHERE x.w + t.take * i.n_sampled <= i.capacity OR t.take = 0)""",
        """ended AS (SELECT *, max(v) OVER (PARTITION BY video_id) AS most FROM walk WHERE k = n)""",
        """best AS (SELECT video_id, min(taken) AS taken, any_value(most) AS most FROM ended WHERE v = most GROUP BY video_id)""",
        """peak AS (SELECT video_id, arg_min(shot_idx, (-score, shot_idx)) AS shot_idx FROM segments GROUP BY video_id HAVING sum(score) > 0)""",
        body=f"""SELECT s.video_id, s.shot_idx, {R6("score")} AS score FROM segments s JOIN best b USING (video_id) LEFT JOIN peak p ON p.video_id = s.video_id
        WHERE CASE WHEN most > 0 THEN (taken >> s.shot_idx) & 1 = 1 ELSE s.shot_idx = p.shot_idx END""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def annotate_ground_truth_exact(spark, sf):
    limit = gt.annotation_limit(spark)
    over = find_oversize(views.table(spark, sf, "events"), ["user_id"], limit)
    over = find_oversize(views.frames(spark, sf), KEYS, limit) if not over.empty else over
    out = gt.annotate_ground_truth(views.frames(spark, sf, over), exact=True, over=over)
    return out.filter("selected = 1").select("video_id", "shot_idx", r6("score").alias("score"))


# ---- kernels ---------------------------------------------------------------

GAPS = """
gaps AS (SELECT a.video_id, sqrt(list_sum(list_transform(list_zip(a.feature, b.feature), lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS d
  FROM feature_frames a JOIN feature_frames b ON a.video_id = b.video_id AND a.step <> b.step),
sigmas AS (SELECT video_id, median(d) AS sigma FROM gaps WHERE d > 0 GROUP BY video_id)
"""


@query("median_bandwidth", with_ctes(FEATURE_FRAMES, GAPS, body=f"SELECT video_id, {R6('sigma')} AS sigma FROM sigmas"))
def median_bandwidth(spark, sf):
    out = gt.median_bandwidth(views.feature_frames(spark, sf))
    return out.select("video_id", r6("sigma").alias("sigma"))


@query(
    "pairwise_kernel",
    with_ctes(
        FEATURE_FRAMES,
        GAPS,
        """cut AS (SELECT *, least(step // (n_steps // greatest(1, n_steps // 10)), greatest(1, n_steps // 10) - 1) AS shot_idx FROM feature_frames)""",
        """pairs AS (SELECT a.video_id, a.shot_idx, a.step, exp(-list_sum(list_transform(list_zip(a.feature, b.feature),
             lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) / (2 * sigma * sigma)) AS k
             FROM cut a JOIN cut b ON a.video_id = b.video_id AND a.shot_idx = b.shot_idx JOIN sigmas s ON s.video_id = a.video_id)""",
        body=f"""SELECT video_id, shot_idx, count(DISTINCT step) AS length, {R6("sum(k) / count(DISTINCT step)")} AS mass
        FROM pairs GROUP BY video_id, shot_idx""",
    ),
)
def pairwise_kernel(spark, sf):
    f = views.feature_frames(spark, sf)
    cut = gt.segment_uniform(f).join(gt.median_bandwidth(f), list(KEYS))
    out = gt.segment_kernel_mass(cut)
    return out.select("video_id", "shot_idx", "length", r6("mass").alias("mass"))


def cuts_sql(steps: int, least: int) -> str:
    """Best cuts by a recursion over the number of segments; each row carries the best (value, starts) for every end."""
    return with_ctes(
        FEATURE_FRAMES,
        GAPS,
        f"""sized AS (SELECT video_id, any_value(n_steps) AS n, greatest(1, least(any_value(n_steps) // {steps}, any_value(n_steps) // {least})) AS k FROM feature_frames GROUP BY video_id)""",
        """pairs AS (SELECT a.video_id, a.step AS i, b.step AS j, exp(-list_sum(list_transform(list_zip(a.feature, b.feature),
             lambda p: power(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))) / (2 * sigma * sigma)) AS g
             FROM feature_frames a JOIN feature_frames b USING (video_id) JOIN sigmas USING (video_id))""",
        # Sums over the corner [0, e) x [0, s) give the mass of every segment.
        """corners AS (SELECT video_id, i, j, sum(r) OVER (PARTITION BY video_id, j ORDER BY i) AS c
             FROM (SELECT video_id, i, j, sum(g) OVER (PARTITION BY video_id, i ORDER BY j) AS r FROM pairs))""",
        """sq AS (SELECT video_id, i + 1 AS e, j + 1 AS s, c FROM corners)""",
        """spans AS (SELECT video_id, s, unnest(range(s + 1, n + 1)) AS e FROM (SELECT video_id, n, unnest(range(0, n)) AS s FROM sized))""",
        f"""gains AS (SELECT t.video_id, t.s, t.e, (ee.c + coalesce(ss.c, 0) - 2 * coalesce(es.c, 0)) / (t.e - t.s) AS v
             FROM spans t JOIN sq ee ON ee.video_id = t.video_id AND ee.e = t.e AND ee.s = t.e
             LEFT JOIN sq ss ON ss.video_id = t.video_id AND ss.e = t.s AND ss.s = t.s
             LEFT JOIN sq es ON es.video_id = t.video_id AND es.e = t.e AND es.s = t.s
             WHERE t.e - t.s >= {least})""",
        """by_end AS (SELECT video_id, e, list({'s': s, 'v': v} ORDER BY s) AS g FROM gains GROUP BY video_id, e)""",
        """lists AS (SELECT z.video_id, any_value(z.n) AS n, any_value(z.k) AS k, list(coalesce(b.g, []) ORDER BY t.e) AS ends
             FROM sized z JOIN (SELECT video_id, unnest(range(1, n + 1)) AS e FROM sized) t USING (video_id)
             LEFT JOIN by_end b ON b.video_id = z.video_id AND b.e = t.e GROUP BY z.video_id)""",
        """walk AS (
          SELECT video_id, n, k, 1 AS done, ends, list_transform(ends, lambda g: CASE WHEN len(g) > 0 THEN {'v': g[1].v, 'starts': [0]} END) AS best FROM lists
          UNION ALL
          SELECT video_id, n, k, done + 1, ends, list_transform(ends, lambda g: list_max(list_filter(list_transform(g, lambda x:
            CASE WHEN x.s > 0 AND best[x.s] IS NOT NULL THEN {'v': best[x.s].v + x.v, 'starts': list_append(best[x.s].starts, x.s)} END), lambda y: y IS NOT NULL)))
          FROM walk WHERE done < k)""",
        """final AS (SELECT video_id, n, best[n].starts AS starts FROM walk WHERE done = k)""",
        """cut AS (SELECT video_id, n, unnest(starts) AS "start", generate_subscripts(starts, 1) - 1 AS shot_idx FROM final)""",
        body="""SELECT video_id, shot_idx, "start", coalesce(lead("start") OVER (PARTITION BY video_id ORDER BY shot_idx), n) - 1 AS "end" FROM cut""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


@query("segment_by_kernel", cuts_sql(10, 1))
def segment_by_kernel(spark, sf):
    out = gt.segment_by_kernel(views.feature_frames(spark, sf))
    return out.select("video_id", "shot_idx", "start", "end")


@query("segment_by_kernel_min_len", cuts_sql(4, 2))
def segment_by_kernel_min_len(spark, sf):
    out = gt.segment_by_kernel(views.feature_frames(spark, sf), steps_per_segment=4, min_len=2)
    return out.select("video_id", "shot_idx", "start", "end")
