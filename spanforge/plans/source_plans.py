"""Reading, writing and maintaining stores; set operations on ids."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.operators import sets
from spanforge.operators.ordered import KEYS
from spanforge.plans.registry import R6, query, r6, with_ctes
from spanforge.plans.stats_plans import GTFRAMES, labelled_frames, rounded
from spanforge.plans.text_plans import joined, trimmed
from spanforge.session import fresh_dir
from spanforge.sources import json_maps
from spanforge.sources import records as rec
from spanforge.sources import stores
from spanforge.sources import views
from spanforge.sources.views import FRAMES, SEGMENTS, SENTENCES, SHOT_FRAMES


def vector_records(spark, sf):
    """Every vector as one record of arrays; picks are not stored."""
    e = views.table(spark, sf, "embeddings")
    return e.select(
        F.lit("vectors").alias("dataset"),
        F.col("vec_id").cast("string").alias("video_id"),
        F.col("embedding").alias("gtscore"),
        F.transform("embedding", lambda x: (x > 0).cast("int")).alias("gtframe"),
        F.transform("embedding", lambda x: F.round(x.cast("double") * 10000).cast("long")).alias("scaled"),
    )


@query(
    "load_video_records",
    f"""SELECT CAST(vec_id AS VARCHAR) AS video_id, step - 1 AS step, {R6("embedding[step]")} AS gtscore, CASE WHEN embedding[step] > 0 THEN 1 ELSE 0 END AS gtframe,
    CAST(NULL AS DOUBLE) AS picks, CAST(NULL AS DOUBLE) AS gtsummary FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS step FROM embeddings)""",
)
def load_video_records(spark, sf):
    out = rec.load_video_records(vector_records(spark, sf))
    return out.drop("dataset").withColumn("gtscore", r6("gtscore"))


@query(
    "profile_record",
    """SELECT video_id, field, array_to_string(v[1:8], ',') AS sample, len(v) AS length FROM (
      SELECT CAST(vec_id AS VARCHAR) AS video_id, 'scaled' AS field, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)) AS v FROM embeddings
      UNION ALL SELECT CAST(vec_id AS VARCHAR), 'gtframe', list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) FROM embeddings)""",
)
def profile_record(spark, sf):
    return rec.profile_record(vector_records(spark, sf), ["scaled", "gtframe"]).drop("dataset")


def nested_lines(spark, sf):
    """Every document as a nested record: its lines are sentences, summaries are printed dicts.

    Of five documents one has its text without sentences and one is plain text.
    """
    kind = F.col("doc_id") % 5
    lines = F.when(kind == 3, F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    aligned = F.transform(
        lines,
        lambda s, i: F.struct(
            i.cast("long").alias("sentence_id"), F.sequence(i.cast("long"), (i + F.col("doc_id") % 3).cast("long")).alias("shot_ids")
        ),
    )
    raw = F.when((kind == 3) | (F.col("doc_id") % 2 == 0), F.col("text")).otherwise(F.lit(""))
    doc = F.to_json(
        F.struct(raw.alias("raw_text"), lines.alias("sentences"), aligned.alias("alignments"), F.size(lines).alias("num_sentences"))
    )
    k = F.col("doc_id").cast("string")
    printed = F.concat(
        F.lit("{'raw_text': None, 'sentences': ['item "), k, F.lit("', 'end.'], 'alignments': [{'sentence_id': 1, 'shot_ids': ["), k, F.lit("]}], 'num_sentences': 2}")
    )
    frames = F.array(
        F.struct(F.col("doc_id").alias("frame_id"), F.col("lang").alias("description"), F.lit(1).alias("is_gt"), F.lit(0).alias("status"))
    )
    clips = F.array(
        F.struct(F.lit(0).alias("clip_id"), F.col("source").alias("summary"), F.lit(1).alias("gt"), F.array(F.col("doc_id")).alias("frames"))
    )
    whole = F.to_json(
        F.struct(
            frames.alias("frames"),
            clips.alias("clips"),
            F.when(kind == 4, F.col("text")).otherwise(doc).alias("aligned_full_document"),
            F.when(F.col("doc_id") % 3 > 0, printed).alias("aligned_text_summary"),
        )
    )
    return views.documents(spark, sf).select(F.lit("docs").alias("dataset"), k.alias("video_id"), whole.alias("doc"))


NESTED = """
doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents),
nested AS (SELECT doc_id, 'document' AS block, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS sentence_id, doc_id % 3 AS w FROM doc_lines WHERE doc_id % 5 < 3
  UNION ALL SELECT doc_id, 'summary', unnest(['item ' || doc_id, 'end.']), unnest([0, 1]), NULL FROM documents WHERE doc_id % 3 > 0)
"""


@query(
    "load_nested_docs",
    with_ctes(
        NESTED,
        body="""SELECT CAST(doc_id AS VARCHAR) AS video_id, block, sentence_id, md5(t) AS text, CASE WHEN block = 'summary' THEN CASE WHEN sentence_id = 1 THEN CAST(doc_id AS VARCHAR) ELSE '' END
        ELSE array_to_string(range(sentence_id, sentence_id + w + 1), ',') END AS shot_ids FROM nested""",
    ),
)
def load_nested_docs(spark, sf):
    out = rec.parse_nested_docs(nested_lines(spark, sf))["sentences"]
    return out.select("video_id", "block", "sentence_id", F.md5("text").alias("text"), joined("shot_ids").alias("shot_ids"))


@query(
    "load_nested_texts",
    with_ctes(
        """doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS l, text FROM documents)""",
        body=f"""SELECT CAST(doc_id AS VARCHAR) AS video_id, 'document' AS block, CASE doc_id % 5 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE len(l) END AS num_sentences,
        md5(CASE WHEN doc_id % 5 < 3 THEN array_to_string(l, ' ') ELSE {trimmed('text')} END) AS raw_text FROM doc_lines
        UNION ALL SELECT CAST(doc_id AS VARCHAR), 'summary', 2, md5('item ' || doc_id || ' end.') FROM documents WHERE doc_id % 3 > 0""",
    ),
)
def load_nested_texts(spark, sf):
    out = rec.parse_nested_docs(nested_lines(spark, sf))["documents"]
    return out.select("video_id", "block", "num_sentences", F.md5("raw_text").alias("raw_text"))


@query(
    "load_nested_segments",
    "SELECT CAST(doc_id AS VARCHAR) AS video_id, lang AS frame_text, source AS shot_text, 1 AS n_sampled FROM documents",
)
def load_nested_segments(spark, sf):
    parts = rec.parse_nested_docs(nested_lines(spark, sf))
    frames = parts["frames"].select(*KEYS, F.col("description").alias("frame_text"))
    shots = parts["segments"].select(*KEYS, F.col("description").alias("shot_text"), "n_sampled")
    return frames.join(shots, list(KEYS)).drop("dataset")


@query(
    "union_annotations",
    """SELECT c_custkey AS video_id, CASE WHEN c_nationkey < 10 THEN 'test' WHEN c_acctbal > 0 THEN 'val' ELSE 'train' END AS split FROM customer""",
)
def union_annotations(spark, sf):
    c = views.table(spark, sf, "customer")
    part = lambda d, name: d.select(F.col("c_custkey").alias("video_id"), F.lit(name).alias("split"))
    return rec.union_annotations(
        [part(c, "train"), part(c.filter("c_acctbal > 0"), "val"), part(c.filter("c_nationkey < 10"), "test")]
    )


@query(
    "load_metadata_csv",
    "SELECT c_name AS video_id, 'yt,' || c_custkey AS youtube_id, c_nationkey AS duration FROM customer",
)
def load_metadata_csv(spark, sf):
    path = fresh_dir(spark, "metadata")
    c = views.table(spark, sf, "customer")
    youtube = F.concat(F.lit("yt,"), F.col("c_custkey").cast("string"))
    c.select(F.col("c_name").alias("video_id"), youtube.alias("youtube_id"), F.col("c_nationkey").alias("duration")).write.csv(
        path, header=True
    )
    return rec.load_metadata_csv(spark, path)


@query(
    "load_categories",
    "SELECT unnest(['v_' || c_name, c_name]) AS video_name, CASE WHEN c_custkey % 5 = 1 THEN 'Unknown' ELSE c_mktsegment END AS label FROM customer WHERE c_custkey % 5 > 0",
)
def load_categories(spark, sf):
    k = F.col("c_custkey") % 5
    label = F.when(k != 1, F.col("c_mktsegment"))
    notes = F.when(k == 0, F.array().cast("array<struct<label: string>>")).otherwise(
        F.array(F.struct(label.alias("label")), F.struct(F.lit("second").alias("label")))
    )
    entry = F.create_map(F.col("c_name"), F.struct(notes.alias("annotations")))
    return rec.load_categories(views.table(spark, sf, "customer").select(F.to_json(entry).alias("database")))


@query("restrict_to_ids", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def restrict_to_ids(spark, sf):
    path = fresh_dir(spark, "ids")
    c = views.table(spark, sf, "customer")
    c.select(F.when(F.col("c_acctbal") > 5000, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise("  ").alias("value")).write.text(path)
    return rec.restrict_to_ids(c, spark.read.text(path), "c_name").select("c_custkey", "c_name")


@query(
    "write_nested_docs",
    with_ctes(FRAMES, GTFRAMES, body="SELECT video_id, step // 40 AS part, pick AS frame_id, description, gtframe AS is_gt, status FROM gt_frames"),
)
def write_nested_docs(spark, sf):
    path = fresh_dir(spark, "docs")
    rec.write_nested_docs(rec.nested_docs(labelled_frames(spark, sf), rows_per_part=40), path)
    back = spark.read.schema("video_id STRING, part BIGINT, doc STRING").json(path)
    frames = F.explode(F.from_json("doc", "frames ARRAY<STRUCT<frame_id BIGINT, description STRING, is_gt INT, status INT>>")["frames"])
    return back.select("video_id", "part", frames.alias("f")).select("video_id", "part", "f.*")


def round_trip(spark, sf):
    """Frames in parts of 40, clips and aligned blocks, written and read back."""
    members = F.sort_array(F.collect_list("pick")).alias("members")
    shots = views.shot_frames(spark, sf).groupBy(*KEYS, "shot_idx").agg(members)
    segments = views.segments(spark, sf).join(shots, [*KEYS, "shot_idx"])
    path = fresh_dir(spark, "docs")
    docs = rec.nested_docs(labelled_frames(spark, sf), segments, views.sentences(spark, sf), rows_per_part=40)
    rec.write_nested_docs(docs, path)
    return rec.load_nested_docs(spark, path)


@query(
    "nested_round_trip_frames",
    with_ctes(FRAMES, GTFRAMES, body="SELECT video_id, step, pick AS frame_id, description, gtframe AS is_gt, status FROM gt_frames"),
)
def nested_round_trip_frames(spark, sf):
    return round_trip(spark, sf)["frames"].drop("dataset")


@query(
    "nested_round_trip_segments",
    with_ctes(FRAMES, SHOT_FRAMES, SEGMENTS, body="SELECT video_id, shot_idx, description, shot_level_gt, n_sampled FROM segments"),
)
def nested_round_trip_segments(spark, sf):
    return round_trip(spark, sf)["segments"].drop("dataset")


@query(
    "nested_round_trip_sentences",
    with_ctes(SENTENCES, body="SELECT video_id, block, sentence_id, md5(text) AS text, array_to_string(shot_ids, ',') AS shot_ids FROM sentences"),
)
def nested_round_trip_sentences(spark, sf):
    out = round_trip(spark, sf)["sentences"]
    return out.select("video_id", "block", "sentence_id", F.md5("text").alias("text"), joined("shot_ids").alias("shot_ids"))


@query("read_json_map", "SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS frame_id, role AS description FROM conversations")
def read_json_map(spark, sf):
    """Map files of some videos each, as one writer leaves them."""
    path = fresh_dir(spark, "maps")
    entry = F.struct(F.col("turn").alias("frame_id"), F.col("role").alias("description"))
    talks = views.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(entry).alias("frames"))
    one = F.struct(F.col("conv_id").cast("string").alias("key"), F.struct("frames").alias("value"))
    maps = talks.groupBy(F.floor(F.col("conv_id") / 20)).agg(F.map_from_entries(F.collect_list(one)).alias("m"))
    maps.select(F.to_json("m")).write.text(path)
    frames = rec.parse_nested_docs(json_maps.read_json_map(spark, path, "talks"))["frames"]
    return frames.select("video_id", "frame_id", "description")


@query("read_json_map_texts", "SELECT CAST(doc_id AS VARCHAR) AS video_id, md5(text) AS text, lang FROM documents WHERE text IS NOT NULL")
def read_json_map_texts(spark, sf):
    """Maps of whole texts, with their brackets, quotes and escapes, read by ranges of one megabyte."""
    path = fresh_dir(spark, "maps")
    docs = views.table(spark, sf, "documents").filter("text IS NOT NULL")
    one = F.struct(F.col("doc_id").cast("string").alias("key"), F.struct("text", "lang").alias("value"))
    maps = docs.groupBy(F.floor(F.col("doc_id") / 20)).agg(F.map_from_entries(F.collect_list(one)).alias("m"))
    maps.select(F.to_json("m")).write.text(path)
    found = json_maps.read_json_map(spark, path, "texts")
    d = F.from_json("doc", "text STRING, lang STRING")
    return found.select("video_id", F.md5(d["text"]).alias("text"), d["lang"].alias("lang"))


@query(
    "votes_from_matrix",
    """SELECT CAST(vec_id AS VARCHAR) AS video_id, u AS user_id, (i - 1) * 15 AS frame, CASE WHEN embedding[i] > u * 0.1::FLOAT THEN 1 ELSE 0 END AS selected
    FROM (SELECT *, unnest([0, 1]) AS u FROM embeddings), LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS i)""",
)
def votes_from_matrix(spark, sf):
    row = lambda least: F.transform("embedding", lambda x: (x > F.lit(least).cast("float")).cast("int"))
    records = views.table(spark, sf, "embeddings").select(
        F.lit("vectors").alias("dataset"),
        F.col("vec_id").cast("string").alias("video_id"),
        F.array(row(0.0), row(0.1)).alias("user_summary"),
        F.transform("embedding", lambda x, i: i * 15).alias("picks"),
    )
    return rec.votes_from_matrix(records, picks="picks").drop("dataset")


@query(
    "write_run",
    f"""SELECT o_orderpriority AS run_id, count(*) AS n_total, count(*) AS n_rows, {R6("avg(o_totalprice)")} AS avg_score FROM orders GROUP BY o_orderpriority""",
)
def write_run(spark, sf):
    path = fresh_dir(spark, "run")
    o = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("run_id"), "o_orderkey", F.col("o_totalprice").alias("score"))
    settings = o.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_total"), F.avg("score").alias("avg_score"))
    rec.write_run(settings, o, path)
    rows = spark.read.parquet(f"{path}/video_results").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return rounded(spark.read.parquet(f"{path}/run_summary").join(rows, "run_id"))


STORE = """
store AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS old FROM customer),
fresh AS (SELECT o_custkey AS c_custkey, CAST(count(*) AS INT) AS new FROM orders GROUP BY o_custkey)
"""


def store(spark, sf):
    c = views.table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("n"))
    o = views.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return c, o


@query("upsert_columns", with_ctes(STORE, body="SELECT c_custkey, coalesce(old, new) AS n FROM store LEFT JOIN fresh USING (c_custkey)"))
def upsert_columns(spark, sf):
    return rec.upsert_columns(*store(spark, sf), ["n"], ["c_custkey"])


@query("upsert_columns_force", with_ctes(STORE, body="SELECT c_custkey, coalesce(new, old) AS n FROM store LEFT JOIN fresh USING (c_custkey)"))
def upsert_columns_force(spark, sf):
    return rec.upsert_columns(*store(spark, sf), ["n"], ["c_custkey"], force=True)


@query(
    "upsert_columns_by_group",
    with_ctes(
        """store AS (SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 10 AND c_custkey % 3 = 0 THEN c_nationkey END AS old FROM customer)""",
        """fresh AS (SELECT o_custkey AS c_custkey, CAST(count(*) AS INT) AS new FROM orders GROUP BY o_custkey)""",
        body="""SELECT c_custkey, CASE WHEN count(old) OVER (PARTITION BY c_nationkey) > 0 THEN old ELSE new END AS n FROM store LEFT JOIN fresh USING (c_custkey)""",
    ),
)
def upsert_columns_by_group(spark, sf):
    old = F.when((F.col("c_nationkey") < 10) & (F.col("c_custkey") % 3 == 0), F.col("c_nationkey"))
    c = views.table(spark, sf, "customer").select("c_custkey", "c_nationkey", old.alias("n"))
    out = rec.upsert_columns(c, store(spark, sf)[1], ["n"], ["c_custkey"], group=["c_nationkey"])
    return out.select("c_custkey", "n")


@query("delete_by_id", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def delete_by_id(spark, sf):
    return deleted(spark, sf)[0].select("o_orderkey")


@query(
    "delete_by_id_counts",
    """SELECT count(*) FILTER (WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)) AS removed,
    count(*) FILTER (WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)) AS kept FROM orders""",
)
def delete_by_id_counts(spark, sf):
    return deleted(spark, sf)[1]


def deleted(spark, sf):
    failed = views.table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    return rec.delete_by_id(views.table(spark, sf, "orders"), failed, ["o_orderkey"])


HEAVY = "SELECT l_orderkey FROM lineitem WHERE l_quantity > 48"


@query(
    "delete_stored",
    f"""SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_orderkey IN ({HEAVY})) AS removed, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN ({HEAVY})) AS kept
    FROM orders WHERE o_orderkey NOT IN ({HEAVY})""",
)
def delete_stored(spark, sf):
    """A stored table without the failed rows, read again, with the counts of the rewrite."""
    path = fresh_dir(spark, "store")
    stores.create_store(views.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), path, ["o_orderkey"], buckets=8)
    failed = views.table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_orderkey").alias("o_orderkey"))
    done = stores.delete_stored(spark, path, failed, ["o_orderkey"])
    counts = {"removed": F.lit(done.changed).cast("long"), "kept": F.lit(done.rows).cast("long")}
    return stores.read_store(spark, path).select("o_orderkey").withColumns(counts)


@query("upsert_stored", with_ctes(STORE, body="SELECT c_custkey, coalesce(old, new) AS n FROM store LEFT JOIN fresh USING (c_custkey)"))
def upsert_stored(spark, sf):
    path = fresh_dir(spark, "store")
    held, fresh = store(spark, sf)
    stores.create_store(held, path, ["c_custkey"], buckets=8)
    stores.upsert_stored(spark, path, fresh, ["n"], ["c_custkey"])
    return stores.read_store(spark, path).select("c_custkey", "n")


DONE = """
captioned AS (SELECT video_id FROM frames GROUP BY video_id HAVING bool_and(gtscore >= 0.5)),
checkpointed AS (SELECT DISTINCT video_id FROM frames WHERE video_id LIKE '%5'),
both_docs AS (SELECT video_id FROM sentences GROUP BY video_id HAVING count(DISTINCT block) = 2),
done AS (SELECT video_id FROM captioned UNION SELECT video_id FROM checkpointed UNION SELECT video_id FROM both_docs WHERE CAST(video_id AS BIGINT) % 2 = 0)
"""


def done(spark, sf):
    f = views.frames(spark, sf)
    said = f.withColumn("description", F.when(F.col("gtscore") >= 0.5, F.col("description")).otherwise(" "))
    docs = views.sentences(spark, sf).filter("cast(video_id as bigint) % 2 = 0").withColumn("dataset", F.lit("events"))
    finished = rec.done_groups(said, f.filter(F.col("video_id").endswith("5")), docs)
    return f.select(*KEYS).distinct(), finished


@query(
    "resume_pending",
    with_ctes(FRAMES, SENTENCES, DONE, body="SELECT DISTINCT video_id FROM frames WHERE video_id NOT IN (SELECT video_id FROM done)"),
)
def resume_pending(spark, sf):
    return rec.resume_pending(*done(spark, sf)).select("video_id")


@query("union_done_sources", with_ctes(FRAMES, SENTENCES, DONE, body="SELECT video_id FROM captioned UNION SELECT video_id FROM checkpointed"))
def union_done_sources(spark, sf):
    f = views.frames(spark, sf)
    captioned = f.groupBy("video_id").agg(F.min("gtscore").alias("m")).filter("m >= 0.5")
    return sets.union_done_sources(captioned, f.filter(F.col("video_id").endswith("5")), on=["video_id"])


@query("new_items", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT conv_id FROM conversations)")
def new_items(spark, sf):
    seen = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("user_id"))
    return sets.new_items(views.table(spark, sf, "events"), seen, ["user_id"])


@query("pick_head", "SELECT 'video_' || c_custkey AS video_id FROM customer ORDER BY c_custkey LIMIT 25")
def pick_head(spark, sf):
    return rec.pick_head(numbered(spark, sf), stop=25)


@query("pick_range", "SELECT 'video_' || c_custkey AS video_id FROM customer ORDER BY 'video_' || c_custkey LIMIT 900 OFFSET 100")
def pick_range(spark, sf):
    return rec.pick_head(numbered(spark, sf), start=100, stop=1000, natural=False)


def numbered(spark, sf):
    name = F.concat(F.lit("video_"), F.col("c_custkey").cast("string"))
    return views.table(spark, sf, "customer").select(name.alias("video_id"))
