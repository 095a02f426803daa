"""The long tables as views over the driver's parquet tables.

========== =====================================================================
frames      events; group = user, step = order by time, pick = 15 * step
segments    equal blocks of ten steps over ``frames``
task items  at most eight sampled lines per order, with a shuffled display order
sentences   conversation turns; assistant = document, user = summary
answers     model-like answer strings spelled from the task items
========== =====================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.groundtruth import segment_uniform
from spanforge.operators.ordered import KEYS, Oversize, find_oversize, with_position
from spanforge.operators.sampling import sample_per_group, shuffle_per_group

SEED = 42
N_ITEMS = 8
FEW_SPLITS = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for CPU-heavy work on a scan of few splits.

    A large input has many splits and is left as it is.
    """
    splits = df.rdd.getNumPartitions()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if splits < min(cores, FEW_SPLITS) else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def event_groups(spark: SparkSession, sf_dir: str) -> Oversize:
    """The groups of ``frames`` that are too large for a task, counted once on the narrow key column.

    It also serves everything that is derived from the frames by group, as that is never larger.
    """
    key = F.col("user_id").cast("string").alias("video_id")
    return find_oversize(table(spark, sf_dir, "events").select(F.lit("events").alias("dataset"), key), KEYS)


def frames(spark: SparkSession, sf_dir: str, over: Oversize | None = None) -> DataFrame:
    over = over or event_groups(spark, sf_dir)
    rows = table(spark, sf_dir, "events").select(
        F.lit("events").alias("dataset"),
        F.col("user_id").cast("string").alias("video_id"),
        "ts",
        "event_id",
        F.col("value").alias("gtscore"),
        F.col("event_type").alias("description"),
        (F.col("event_type") == "error").cast("int").alias("status"),
    )
    placed = with_position(rows, KEYS, [F.col("ts"), F.col("event_id")], "step", over)
    return placed.withColumn("pick", F.col("step") * 15).drop("ts", "event_id")


FRAMES = """
frames AS (
  SELECT 'events' AS dataset, CAST(user_id AS VARCHAR) AS video_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
         (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 15 AS pick,
         value AS gtscore, event_type AS description,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS status,
         count(*) OVER (PARTITION BY user_id) AS n_steps
  FROM events)
"""


def shot_frames(spark: SparkSession, sf_dir: str, over: Oversize | None = None) -> DataFrame:
    """Frames with ``n_steps`` and the equal-block ``shot_idx`` they fall in."""
    over = over or event_groups(spark, sf_dir)
    return segment_uniform(frames(spark, sf_dir, over), over=over)


SHOT_FRAMES = """
shot_frames AS (
  SELECT *, least(step // (n_steps // greatest(1, n_steps // 10)),
                  greatest(1, n_steps // 10) - 1) AS shot_idx
  FROM frames)
"""


def segments(spark: SparkSession, sf_dir: str, over: Oversize | None = None) -> DataFrame:
    """Equal blocks in step space and in pick space, with mean score and text."""
    return (
        shot_frames(spark, sf_dir, over)
        .groupBy(*KEYS, "shot_idx")
        .agg(
            F.min("step").alias("start"),
            F.max("step").alias("end"),
            F.count(F.lit(1)).alias("n_sampled"),
            F.avg("gtscore").alias("score"),
            F.min_by("description", "step").alias("description"),
            F.max("n_steps").alias("n_steps"),
            (F.sum("status") > 0).cast("int").alias("shot_level_gt"),
        )
        .withColumn("n_orig", (F.col("end") - F.col("start") + 1) * 15)
    )


SEGMENTS = """
segments AS (
  SELECT dataset, video_id, shot_idx, min(step) AS "start", max(step) AS "end",
         count(*) AS n_sampled, avg(gtscore) AS score, arg_min(description, step) AS description,
         max(n_steps) AS n_steps, max(status) AS shot_level_gt,
         (max(step) - min(step) + 1) * 15 AS n_orig
  FROM shot_frames GROUP BY dataset, video_id, shot_idx)
"""


def last_frames(votes: DataFrame) -> DataFrame:
    """The largest annotated frame of each group."""
    return votes.groupBy(*KEYS).agg(F.max("frame").cast("long").alias("last"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as scored items; the key columns complete the order of lines."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return spread(lines).select(
        F.lit("orders").alias("dataset"),
        F.col("l_orderkey").cast("string").alias("video_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", cents).alias("item_key"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        cents.alias("cents"),
        F.col("l_quantity").cast("long").alias("weight"),
        F.col("l_extendedprice").alias("score"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "cents"]

ORDER_LINES = """
order_lines AS (
  SELECT 'orders' AS dataset, CAST(l_orderkey AS VARCHAR) AS video_id,
         concat_ws('-', l_linenumber, l_partkey, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT)) AS item_key,
         l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(l_quantity AS BIGINT) AS weight, l_extendedprice AS score
  FROM lineitem)
"""


def task_items(spark: SparkSession, sf_dir: str, n: int = N_ITEMS) -> DataFrame:
    """Sampled items: ``orig_pos`` (0-based) and ``display_pos`` (1-based)."""
    lines = order_lines(spark, sf_dir)
    sampled = sample_per_group(lines, n, SEED, [F.col(c) for c in LINE_ORDER])
    return shuffle_per_group(sampled, SEED)


TASK_ITEMS = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, video_id
             ORDER BY md5(concat_ws(':', '42', dataset, video_id, item_key)), item_key) AS draw
  FROM order_lines),
task_items AS (
  SELECT *, count(*) OVER (PARTITION BY dataset, video_id) AS n_items,
         row_number() OVER (PARTITION BY dataset, video_id
             ORDER BY l_linenumber, l_partkey, l_suppkey, cents) - 1 AS orig_pos,
         row_number() OVER (PARTITION BY dataset, video_id
             ORDER BY md5(concat_ws(':', 'shuffle', '42', dataset, video_id, item_key)), item_key) AS display_pos
  FROM ranked WHERE draw <= 8)
"""


def tag(col: str = "video_id") -> Column:
    """One hexadecimal digit that picks the shape of a group's answer."""
    return F.substring(F.md5(F.col(col)), 1, 1)


def ranking_answers(spark: SparkSession, sf_dir: str, score: Column | None = None) -> DataFrame:
    """``Shot X > ...`` answers, one per order, in good and broken shapes.

    With ``score`` the row also lists the items' true scores by label.
    """
    items = task_items(spark, sf_dir)
    spoken = F.sort_array(
        F.collect_list(F.struct(F.md5(F.concat_ws(":", F.lit("says"), "video_id", "item_key")), "display_pos"))
    )
    if score is not None:
        by_label = F.transform(F.sort_array(F.collect_list(F.struct("display_pos", score.alias("s")))), lambda x: x["s"])
    one = items.groupBy(*KEYS).agg(
        F.max("n_items").alias("n_items"),
        F.transform(spoken, lambda s: s["display_pos"]).alias("said"),
        *([] if score is None else [by_label.alias("scores")]),
    )
    t = tag()
    labels = F.array_join(F.transform("said", lambda x: F.concat(F.lit("Shot "), x.cast("string"))), " > ")
    bare = F.array_join(F.transform("said", lambda x: x.cast("string")), " > ")
    cut = F.array_join(
        F.transform(F.expr("slice(said, 1, size(said) - 1)"), lambda x: F.concat(F.lit("Shot "), x.cast("string"))),
        " > ",
    )
    text = (
        F.when(t == "a", F.concat(labels, F.lit(" > Shot "), F.element_at("said", 1).cast("string")))
        .when(t == "b", cut)
        .when(t == "c", bare)
        .when(t == "d", F.lit("  "))
        .when(t == "e", F.lit("I cannot tell the order."))
        .when(t == "f", F.concat(F.lit("<think>maybe Shot 1 first</think>"), F.lower(labels)))
        .otherwise(labels)
    )
    return one.select(*KEYS, "n_items", text.alias("raw_output"), *([] if score is None else ["scores"]))


RANKING_ANSWERS = """
spoken AS (
  SELECT dataset, video_id, max(n_items) AS n_items, substr(md5(video_id), 1, 1) AS t,
         list(display_pos ORDER BY md5(concat_ws(':', 'says', video_id, item_key)), display_pos) AS said
  FROM task_items GROUP BY dataset, video_id),
ranking_answers AS (
  SELECT dataset, video_id, n_items,
    CASE t
      WHEN 'a' THEN array_to_string(list_transform(said, lambda x: 'Shot ' || x), ' > ') || ' > Shot ' || said[1]
      WHEN 'b' THEN coalesce(array_to_string(list_transform(said[1:len(said)-1], lambda x: 'Shot ' || x), ' > '), '')
      WHEN 'c' THEN array_to_string(said, ' > ')
      WHEN 'd' THEN '  '
      WHEN 'e' THEN 'I cannot tell the order.'
      WHEN 'f' THEN '<think>maybe Shot 1 first</think>' || lower(array_to_string(list_transform(said, lambda x: 'Shot ' || x), ' > '))
      ELSE array_to_string(list_transform(said, lambda x: 'Shot ' || x), ' > ')
    END AS raw_output
  FROM spoken)
"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as document and summary sentences; system turns dropped.

    A turn describes the shots ``turn`` and ``turn + 1``.
    """
    turns = table(spark, sf_dir, "conversations")
    block = F.when(F.col("role") == "assistant", "document").when(F.col("role") == "user", "summary")
    kept = turns.select(
        F.lit("talks").alias("dataset"),
        F.col("conv_id").cast("string").alias("video_id"),
        block.alias("block"),
        "turn",
        F.col("text"),
    ).filter(F.col("block").isNotNull())
    placed = with_position(kept, [*KEYS, "block"], [F.col("turn")], "sentence_id")
    return placed.select(
        *KEYS, "block", "sentence_id", "text", F.sequence("turn", F.col("turn") + 1).alias("shot_ids")
    )


SENTENCES = """
sentences AS (
  SELECT 'talks' AS dataset, CAST(conv_id AS VARCHAR) AS video_id,
         CASE role WHEN 'assistant' THEN 'document' ELSE 'summary' END AS block,
         row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS sentence_id,
         text, [turn, turn + 1] AS shot_ids
  FROM conversations WHERE role IN ('assistant', 'user'))
"""


def feature_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames: group = label, step = order of the vector id."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.lit("vectors").alias("dataset"),
        F.col("label").cast("string").alias("video_id"),
        "vec_id",
        F.col("embedding").alias("feature"),
    )
    return with_position(rows, KEYS, [F.col("vec_id")], "step").drop("vec_id")


FEATURE_FRAMES = """
feature_frames AS (
  SELECT 'vectors' AS dataset, CAST(label AS VARCHAR) AS video_id, embedding AS feature,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step,
         count(*) OVER (PARTITION BY label) AS n_steps
  FROM embeddings)
"""


def votes(spark: SparkSession, sf_dir: str, once: bool = True) -> DataFrame:
    """Suppliers voting for part numbers, grouped by the flag pair of the line; each vote ``once`` or as often as it was cast."""
    cast = table(spark, sf_dir, "lineitem").select(
        F.lit("votes").alias("dataset"),
        F.concat("l_returnflag", "l_linestatus").alias("video_id"),
        F.col("l_suppkey").alias("user_id"),
        F.col("l_partkey").alias("frame"),
    )
    return (cast.distinct() if once else cast).withColumn("selected", F.lit(1))


VOTES = """
votes AS (
  SELECT DISTINCT 'votes' AS dataset, l_returnflag || l_linestatus AS video_id,
         l_suppkey AS user_id, l_partkey AS frame, 1 AS selected
  FROM lineitem)
"""

