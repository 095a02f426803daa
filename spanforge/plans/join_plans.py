"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import joins
from spanforge.operators.ordered import KEYS
from spanforge.plans.registry import R6, query, r6, with_ctes
from spanforge.sources import views
from spanforge.sources.views import (
    FRAMES,
    ORDER_LINES,
    SEGMENTS,
    SENTENCES,
    SHOT_FRAMES,
    TASK_ITEMS,
    VOTES,
)


@query(
    "lookup_join",
    """SELECT o_orderkey, c_mktsegment AS label, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey""",
)
def lookup_join(spark, sf):
    orders = views.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    people = views.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    out = joins.lookup_join(orders, people, ["c_custkey"])
    nations = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = joins.lookup_join(out, nations, ["c_nationkey"], small=True)
    return out.select("o_orderkey", F.col("c_mktsegment").alias("label"), F.col("n_name").alias("nation"))


@query(
    "lookup_join_default",
    """SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)""",
)
def lookup_join_default(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id")
    labels = views.table(spark, sf, "labels").select("doc_id", "quality")
    return joins.lookup_join(docs, labels, ["doc_id"], default={"quality": F.lit(-1)})


@query(
    "positional_join",
    with_ctes(
        """users AS (SELECT max(user_id) + 1 AS n FROM events)""",
        """captions AS (SELECT CAST(conv_id % n AS VARCHAR) AS video_id, length(text) AS n_chars,
           row_number() OVER (PARTITION BY conv_id % n ORDER BY conv_id, turn) - 1 AS pos FROM conversations, users)""",
        FRAMES,
        body="SELECT video_id, pos, pick, n_chars FROM captions c JOIN frames f USING (video_id) WHERE c.pos = f.step",
    ),
)
def positional_join(spark, sf):
    n_users = views.table(spark, sf, "events").agg(F.max("user_id") + 1).first()[0]
    captions = views.table(spark, sf, "conversations").select(
        F.lit("events").alias("dataset"),
        (F.col("conv_id") % n_users).cast("string").alias("video_id"),
        "conv_id",
        "turn",
        F.length("text").cast("long").alias("n_chars"),
    )
    frames = views.frames(spark, sf).select(*KEYS, "step", "pick")
    out = joins.positional_join(captions, frames, [F.col("conv_id"), F.col("turn")], [F.col("step")])
    return out.select("video_id", "pos", "pick", "n_chars")


@query(
    "interval_join",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        body="""SELECT s.video_id, s.shot_idx, count(f.pick) AS n_sampled FROM segments s LEFT JOIN frames f ON f.video_id = s.video_id
        AND f.pick BETWEEN s."start" * 15 + 7 AND s."end" * 15 - s.shot_idx * 40 GROUP BY s.video_id, s.shot_idx""",
    ),
)
def interval_join(spark, sf):
    over = views.event_groups(spark, sf)
    s = views.segments(spark, sf, over)
    s = s.withColumns({"start": F.col("start") * 15 + 7, "end": F.col("end") * 15 - F.col("shot_idx") * 40})
    out = joins.count_per_shot(s, views.frames(spark, sf, over))
    return out.select("video_id", "shot_idx", "n_sampled")


@query(
    "position_to_shot",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        """spans AS (SELECT video_id, shot_idx, sum(n_sampled) OVER (PARTITION BY video_id ORDER BY shot_idx) AS hi, n_sampled FROM segments)""",
        body="""SELECT DISTINCT f.video_id, shot_idx FROM frames f JOIN spans s ON f.video_id = s.video_id
        AND f.step >= s.hi - s.n_sampled AND f.step < s.hi WHERE f.gtscore > 100""",
    ),
)
def position_to_shot(spark, sf):
    over = views.event_groups(spark, sf)
    picked = views.frames(spark, sf, over).filter(F.col("gtscore") > 100).withColumn("pos", F.col("step") + 1)
    return joins.position_to_shot(picked, views.segments(spark, sf, over), over).select("video_id", "shot_idx")


@query(
    "representative_shots",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        """sized AS (SELECT video_id, count(*) AS n FROM segments GROUP BY video_id)""",
        body="""SELECT DISTINCT video_id, step AS shot_idx FROM frames JOIN sized USING (video_id) WHERE gtscore > 20 AND step < n""",
    ),
)
def representative_shots(spark, sf):
    over = views.event_groups(spark, sf)
    answered = views.frames(spark, sf, over).filter("gtscore > 20").withColumn("pos", F.col("step") + 1)
    n_shots = views.segments(spark, sf, over).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_shots"))
    return joins.representative_shots(answered, n_shots).select("video_id", "shot_idx")


@query(
    "band_semi_join",
    with_ctes(
        VOTES,
        """grid AS (SELECT video_id, unnest(range(0, last + 30, 30)) AS pick FROM (SELECT video_id, max(frame) AS last FROM votes GROUP BY video_id))""",
        body="""SELECT g.video_id, pick, count(DISTINCT user_id) AS n_users FROM grid g JOIN votes v ON v.video_id = g.video_id
        AND v.frame BETWEEN g.pick - 15 AND g.pick + 15 GROUP BY g.video_id, pick""",
    ),
)
def band_semi_join(spark, sf):
    votes = views.votes(spark, sf, once=False)
    steps = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("last") / 30).cast("long"))).alias("step")
    picks = views.last_frames(votes).select(*KEYS, steps).withColumn("pick", F.col("step") * 30)
    near = joins.band_semi_join(picks, votes)
    return near.groupBy("video_id", "pick").agg(F.count(F.lit(1)).alias("n_users"))


@query(
    "overlap_join",
    with_ctes(
        SENTENCES,
        body="""SELECT s.video_id, s.sentence_id, d.sentence_id AS doc_id FROM sentences s LEFT JOIN sentences d
        ON d.video_id = s.video_id AND d.block = 'document' AND list_has_any(s.shot_ids, d.shot_ids) WHERE s.block = 'summary'""",
    ),
)
def overlap_join(spark, sf):
    s = views.sentences(spark, sf)
    out = joins.overlap_join(s.filter("block = 'summary'"), s.filter("block = 'document'"))
    return out.select("video_id", "sentence_id", "doc_id")


@query(
    "first_match_join",
    """SELECT o_orderkey, l_partkey AS first_part FROM orders LEFT JOIN
    (SELECT l_orderkey, arg_min(l_partkey, row(l_linenumber, l_partkey)) AS l_partkey FROM lineitem GROUP BY l_orderkey)
    ON o_orderkey = l_orderkey""",
)
def first_match_join(spark, sf):
    rows = views.table(spark, sf, "orders").select("o_orderkey")
    lines = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_partkey").alias("ord"),
        F.col("l_partkey").alias("first_part"),
    )
    return joins.first_match_join(rows, lines, ["o_orderkey"], "ord", "first_part")


@query(
    "subset_semi_join",
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 1 ELSE 0 END AS in_subset FROM documents",
)
def subset_semi_join(spark, sf):
    docs = views.table(spark, sf, "documents").select("doc_id")
    return joins.subset_semi_join(docs, views.table(spark, sf, "labels"), ["doc_id"])


@query(
    "pending_anti_join",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def pending_anti_join(spark, sf):
    done = views.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.pending_anti_join(views.table(spark, sf, "customer").select("c_custkey"), done, ["c_custkey"])


@query(
    "pair_self_join",
    with_ctes(
        ORDER_LINES,
        TASK_ITEMS,
        body="""SELECT a.video_id, row_number() OVER (PARTITION BY a.video_id ORDER BY a.orig_pos, b.orig_pos) - 1 AS pair_idx,
        a.orig_pos AS i, b.orig_pos AS j, a.item_key AS item_i, b.item_key AS item_j
        FROM task_items a JOIN task_items b ON a.video_id = b.video_id AND a.orig_pos < b.orig_pos""",
    ),
)
def pair_self_join(spark, sf):
    return joins.pair_rows(views.task_items(spark, sf)).select("video_id", "pair_idx", "i", "j", "item_i", "item_j")


@query(
    "chain_join",
    with_ctes(
        SENTENCES,
        body="""SELECT DISTINCT s.video_id, s.sentence_id, c.clip_id FROM sentences s JOIN sentences d ON d.video_id = s.video_id
        AND d.block = 'document' AND list_has_any(s.shot_ids, d.shot_ids)
        JOIN (SELECT video_id, sentence_id, unnest(shot_ids) AS clip_id FROM sentences WHERE block = 'document') c
          ON c.video_id = d.video_id AND c.sentence_id = d.sentence_id WHERE s.block = 'summary'""",
    ),
)
def chain_join(spark, sf):
    s = views.sentences(spark, sf)
    docs = s.filter("block = 'document'")
    linked = joins.overlap_join(s.filter("block = 'summary'"), docs)
    clips = docs.select(*KEYS, F.col("sentence_id").alias("doc_id"), F.explode("shot_ids").alias("clip_id"))
    return joins.chain_join(linked, clips).select("video_id", "sentence_id", "clip_id")


@query(
    "nearest_valid_fill",
    with_ctes(
        FRAMES,
        """bad AS (SELECT *, CASE WHEN event_type_bad THEN 1 ELSE 0 END AS st FROM
           (SELECT *, description <> 'purchase' OR video_id LIKE '7%' AS event_type_bad FROM frames))""",
        """near AS (SELECT b.video_id, b.step, b.description AS own, b.st, g.step AS gstep, g.gtscore AS gs,
             row_number() OVER (PARTITION BY b.video_id, b.step ORDER BY abs(b.step - g.step), g.step) AS rn
             FROM bad b LEFT JOIN bad g ON g.video_id = b.video_id AND g.st = 0)""",
        body="""SELECT video_id, step, CASE WHEN gs IS NULL THEN 'No description available'
        ELSE 'score ' || CAST(CAST(round(gs * 100) AS BIGINT) AS VARCHAR) END AS filled FROM near WHERE rn = 1""",
    ),
)
def nearest_valid_fill(spark, sf):
    f = views.frames(spark, sf)
    bad = (F.col("description") != "purchase") | F.col("video_id").startswith("7")
    spoken = F.concat(F.lit("score "), F.round(F.col("gtscore") * 100).cast("long").cast("string"))
    f = f.withColumns({"status": bad.cast("int"), "description": spoken})
    return joins.nearest_valid_fill(f).select("video_id", "step", "filled")


CATEGORY = """
categories AS (SELECT DISTINCT unnest(['v_' || c_name, c_name]) AS video_name, c_mktsegment AS label FROM customer WHERE c_acctbal > 0)
"""


@query(
    "category_join",
    with_ctes(
        CATEGORY,
        """names AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'v_' || c_name ELSE c_name END AS video_name FROM customer)""",
        body="""SELECT label, count(*) AS n FROM names JOIN categories USING (video_name) GROUP BY label""",
    ),
)
def category_join(spark, sf):
    return joins.category_join(*_names(spark, sf))[0].groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "category_match_rate",
    f"""SELECT count(*) AS n_total, count(*) FILTER (WHERE c_acctbal > 0) AS n_matched,
    {R6("count(*) FILTER (WHERE c_acctbal > 0) / count(*)")} AS match_rate FROM customer""",
)
def category_match_rate(spark, sf):
    rate = joins.category_join(*_names(spark, sf))[1]
    return rate.withColumn("match_rate", r6("match_rate"))


def _names(spark, sf):
    from spanforge.sources.records import category_keys

    people = views.table(spark, sf, "customer")
    cats = category_keys(
        people.filter("c_acctbal > 0").select(F.col("c_name").alias("id"), F.col("c_mktsegment").alias("label"))
    )
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("v_"), "c_name")).otherwise(F.col("c_name"))
    return people.select(name.alias("video_name")), cats


@query(
    "dense_reindex",
    with_ctes(
        FRAMES,
        SHOT_FRAMES,
        SEGMENTS,
        """m AS (SELECT video_id, shot_idx, row_number() OVER (PARTITION BY video_id ORDER BY shot_idx) - 1 AS new_id
           FROM segments WHERE score > 60)""",
        """ids AS (SELECT video_id, unnest([0, 2, 4, 9]) AS new_id FROM (SELECT DISTINCT video_id FROM segments))""",
        body="SELECT video_id, new_id, shot_idx FROM ids JOIN m USING (video_id, new_id)",
    ),
)
def dense_reindex(spark, sf):
    s = views.segments(spark, sf)
    wanted = F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 2, 4, 9)])).alias("new_id")
    ids = s.select(*KEYS).distinct().select(*KEYS, wanted)
    return joins.dense_reindex(s.filter("score > 60"), ids).select("video_id", "new_id", "shot_idx")
