"""Reading and writing records, nested documents and run results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import text
from spanforge.operators.ordered import KEYS, with_position

ALIGNED = (
    "raw_text STRING, sentences ARRAY<STRING>, num_sentences BIGINT, "
    "alignments ARRAY<STRUCT<sentence_id BIGINT, shot_ids ARRAY<BIGINT>, shot_summaries ARRAY<STRING>>>"
)
DOC_FIELDS = (
    "frames ARRAY<STRUCT<step BIGINT, frame_id BIGINT, description STRING, is_gt INT, status INT>>, "
    "clips ARRAY<STRUCT<clip_id BIGINT, summary STRING, gt INT, frames ARRAY<BIGINT>>>, "
    "aligned_full_document STRING, aligned_text_summary STRING"
)
ARRAYS = ("picks", "gtscore", "gtsummary", "gtframe")


# ---- scans -----------------------------------------------------------------

def load_video_records(records: DataFrame, fields: Sequence[str] = ARRAYS) -> DataFrame:
    """Per-video arrays to one row per step; a missing field becomes a NULL column."""
    have = [c for c in fields if c in records.columns]
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(records.schema[c].dataType)).alias(c) for c in have])
    out = records.select(*KEYS, F.posexplode(zipped).alias("step", "_v"))
    values = [F.col(f"_v.{c}").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in fields]
    return out.select(*KEYS, F.col("step").cast("long").alias("step"), *values)


def votes_from_matrix(records: DataFrame, matrix: str = "user_summary", picks: str | None = None) -> DataFrame:
    """A users x frames matrix per video (array of arrays) to votes: user_id, frame, selected.

    Users are numbered by row. ``frame`` is the column number, or the entry of the array ``picks`` at it; columns
    beyond the picks are dropped. Null rows and entries give no votes.
    """
    users = records.select(*KEYS, *([picks] if picks else []), F.posexplode(matrix).alias("user_id", "_row"))
    cells = users.select(*KEYS, "user_id", *([picks] if picks else []), F.posexplode("_row").alias("_at", "selected"))
    frame = F.get(picks, F.col("_at")).cast("long") if picks else F.col("_at").cast("long")
    out = cells.select(*KEYS, F.col("user_id").cast("long").alias("user_id"), frame.alias("frame"), F.col("selected").cast("int").alias("selected"))
    return out.filter(F.col("frame").isNotNull() & F.col("selected").isNotNull())


def aligned_block(c: Column) -> Column:
    """A block stored as a JSON object, as its printed Python form or as plain text."""
    printed = c
    # Python's spelling of the JSON literals.
    for python, json in (("None", "null"), ("True", "true"), ("False", "false")):
        printed = F.regexp_replace(printed, rf"(?<=[:\[,]\s?){python}(?=\s*[,}}\]])", json)
    text_form = F.when(F.regexp(c, F.lit(r"^\s*\{\s*'")), printed).otherwise(c)
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    plain = F.struct(
        text.strip(c).alias("raw_text"),
        F.lit(None).cast("array<string>").alias("sentences"),
        F.lit(None).cast("bigint").alias("num_sentences"),
        F.lit(None).cast("array<struct<sentence_id: bigint, shot_ids: array<bigint>, shot_summaries: array<string>>>").alias("alignments"),
    )
    return F.when(F.regexp(c, F.lit(r"^\s*\{")), F.from_json(text_form, ALIGNED, options)).when(~text.is_blank(c), plain)


def parse_nested_docs(lines: DataFrame) -> dict[str, DataFrame]:
    """``dataset, video_id, doc`` (JSON objects, one or several numbered parts per video) to long tables.

    A frame's step is the one it was written with, else its place in the list. The text of a block is made of its
    sentences if it has some.
    """
    parsed = lines.select(*KEYS, F.from_json("doc", DOC_FIELDS).alias("d")).select(*KEYS, "d.*")
    frames = parsed.select(*KEYS, F.posexplode("frames").alias("at", "f")).select(
        *KEYS, F.coalesce("f.step", F.col("at").cast("long")).alias("step"), *[f"f.{c}" for c in ("frame_id", "description", "is_gt", "status")]
    )
    clips = parsed.select(*KEYS, F.explode("clips").alias("c")).select(
        *KEYS,
        F.col("c.clip_id").alias("shot_idx"),
        F.col("c.summary").alias("description"),
        F.col("c.gt").alias("shot_level_gt"),
        F.size("c.frames").cast("long").alias("n_sampled"),
    )
    blocks = [
        parsed.select(*KEYS, F.lit(name).alias("block"), aligned_block(F.col(field)).alias("b"))
        for name, field in (("document", "aligned_full_document"), ("summary", "aligned_text_summary"))
    ]
    both = blocks[0].unionByName(blocks[1]).filter(F.col("b").isNotNull())
    rows = both.select(*KEYS, "block", "b", F.posexplode("b.sentences").alias("sentence_id", "text"))
    match = F.filter("b.alignments", lambda a: a["sentence_id"] == F.col("sentence_id"))
    ids = F.coalesce(F.get(match, F.lit(0))["shot_ids"], F.array().cast("array<bigint>"))
    sentences = rows.select(
        *KEYS, "block", F.col("sentence_id").cast("long").alias("sentence_id"), "text", ids.alias("shot_ids")
    )
    raw = F.when(F.size("b.sentences") > 0, F.array_join("b.sentences", " ")).otherwise(text.strip(F.col("b.raw_text")))
    documents = both.select(*KEYS, "block", raw.alias("raw_text"), F.col("b.num_sentences").alias("num_sentences"))
    return {"frames": frames, "segments": clips, "sentences": sentences, "documents": documents}


def load_nested_docs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read documents written by :func:`write_nested_docs`, one JSON object per line."""
    lines = spark.read.schema("video_id STRING, part BIGINT, doc STRING, dataset STRING").json(path)
    return parse_nested_docs(lines)


def union_annotations(files: Sequence[DataFrame], key: str = "video_id") -> DataFrame:
    """Several annotation tables; a later one replaces rows of the same id."""
    tagged = [f.withColumn("_file", F.lit(i)) for i, f in enumerate(files)]
    rows = tagged[0]
    for more in tagged[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    fields = [c for c in rows.columns if c not in (key, "_file")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), "_file").alias("_v"))
    return last.select(key, "_v.*")


def load_metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("video_id STRING, youtube_id STRING, duration INT").csv(path, header=True)


def category_keys(labels: DataFrame) -> DataFrame:
    """Labels under the plain id and under its ``v_`` form."""
    both = F.explode(F.array(F.concat(F.lit("v_"), "id"), F.col("id"))).alias("video_name")
    return labels.select(both, "label")


def load_categories(raw: DataFrame) -> DataFrame:
    """First label per id from ``{id: {annotations: [{label}]}}`` strings in ``database``."""
    schema = "MAP<STRING, STRUCT<annotations: ARRAY<STRUCT<label: STRING>>>>"
    entries = raw.select(F.explode(F.map_entries(F.from_json("database", schema))).alias("e"))
    first = F.get(F.col("e.value.annotations"), F.lit(0))
    labels = entries.filter(first.isNotNull()).select(
        F.col("e.key").alias("id"), F.coalesce(first["label"], F.lit("Unknown")).alias("label")
    )
    return category_keys(labels)


def restrict_to_ids(rows: DataFrame, ids: DataFrame, key: str = "video_id") -> DataFrame:
    """Keep rows whose id is in a text table (column ``value``); blank lines do not count."""
    wanted = ids.filter(~text.is_blank(F.col("value"))).select(text.strip(F.col("value")).alias(key)).distinct()
    return rows.join(wanted, [key], "left_semi")


# ---- sinks -----------------------------------------------------------------

def aligned_blocks(sentences: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per video: both blocks as JSON, from ``block, sentence_id, text, shot_ids``."""
    row = F.struct("sentence_id", "text", "shot_ids")
    packed = sentences.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(row)).alias("s"))
    texts = F.transform("s", lambda x: x["text"])
    block = F.to_json(
        F.struct(
            F.array_join(texts, " ").alias("raw_text"),
            texts.alias("sentences"),
            F.size("s").cast("long").alias("num_sentences"),
            F.transform("s", lambda x, i: F.struct(i.cast("long").alias("sentence_id"), x["shot_ids"].alias("shot_ids"))).alias("alignments"),
        )
    )
    one = lambda name: F.max(F.when(F.col("block") == name, F.col("_b")))
    return packed.withColumn("_b", block).groupBy(*keys).agg(
        one("document").alias("aligned_full_document"), one("summary").alias("aligned_text_summary")
    )


def nested_docs(
    frames: DataFrame,
    segments: DataFrame | None = None,
    sentences: DataFrame | None = None,
    rows_per_part: int = 10_000,
) -> DataFrame:
    """One JSON document per video; very long videos are written in numbered parts.

    ``segments`` (shot_idx, description, shot_level_gt, ``members``: its frame ids) become the clips and ``sentences`` the aligned
    document and summary; both stand in the first part. Entries keep their step, so parts can be read in any order.
    """
    cut = frames.withColumn("part", F.floor(F.col("step") / rows_per_part).cast("long"))
    entry = F.struct("step", F.col("pick").alias("frame_id"), "description", F.col("gtframe").alias("is_gt"), "status")
    out = cut.groupBy(*KEYS, "part").agg(F.sort_array(F.collect_list(entry)).alias("frames"))
    fields = [F.col("frames")]
    first = lambda df: df.withColumn("part", F.lit(0).cast("long"))
    if segments is not None:
        clip = F.struct(
            F.col("shot_idx").alias("clip_id"), F.col("description").alias("summary"), F.col("shot_level_gt").alias("gt"), F.col("members").alias("frames")
        )
        clips = segments.groupBy(*KEYS).agg(F.sort_array(F.collect_list(clip)).alias("clips"))
        out = out.join(first(clips), [*KEYS, "part"], "full")
        fields.append(F.col("clips"))
    if sentences is not None:
        out = out.join(first(aligned_blocks(sentences)), [*KEYS, "part"], "full")
        fields += [F.col("aligned_full_document"), F.col("aligned_text_summary")]
    return out.select(*KEYS, "part", F.to_json(F.struct(*fields)).alias("doc"))


def write_nested_docs(docs: DataFrame, path: str) -> None:
    docs.write.partitionBy("dataset").json(path)


def write_run(settings: DataFrame, results: DataFrame, path: str) -> None:
    """Run settings with aggregates, and the rows per video, as two tables."""
    settings.write.parquet(f"{path}/run_summary")
    results.write.partitionBy("run_id").parquet(f"{path}/video_results")


# ---- maintenance -----------------------------------------------------------

def upsert_columns(
    store: DataFrame,
    fresh: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = KEYS,
    force: bool = False,
    group: Sequence[str] | None = None,
) -> DataFrame:
    """Add derived columns; rows that already have one keep it unless ``force``.

    With ``group`` (some of the keys) a group in which any row has the column is skipped whole, so old
    and new values never mix in one group.
    """
    renamed = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = store.join(renamed, list(keys), "left")
    have = [c for c in columns if c in store.columns]
    if group is not None and have and not force:
        facts = store.groupBy(*group).agg(*[(F.count(c) > 0).alias(f"_has_{c}") for c in have])
        joined = joined.join(facts, list(group), "left")
    out = {}
    for c in columns:
        new = F.col(f"_new_{c}")
        old = F.col(c) if c in have else F.lit(None)
        if force:
            out[c] = F.coalesce(new, old)
        elif group is not None and c in have:
            out[c] = F.when(F.col(f"_has_{c}"), old).otherwise(new)
        else:
            out[c] = F.coalesce(old, new)
    return joined.withColumns(out).drop(*[f"_new_{c}" for c in columns], *[f"_has_{c}" for c in have])


def delete_by_id(store: DataFrame, failed: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame]:
    """(remaining rows, one row with removed and kept counts)."""
    bad = failed.select(*keys).distinct()
    kept = store.join(bad, list(keys), "left_anti")
    flagged = store.join(bad.withColumn("_bad", F.lit(1)), list(keys), "left")
    counts = flagged.agg(F.count("_bad").alias("removed"), F.count_if(F.col("_bad").isNull()).alias("kept"))
    return kept, counts


def done_groups(outputs: DataFrame, checkpointed: DataFrame, documents: DataFrame) -> DataFrame:
    """Groups that need no more work.

    In the checkpoint, or captioned without an empty caption, or holding both documents.
    """
    captioned = outputs.groupBy(*KEYS).agg(F.bool_and(~text.is_blank(F.col("description"))).alias("ok"))
    both = documents.groupBy(*KEYS).agg(F.count_distinct("block").alias("n"))
    return (
        checkpointed.select(*KEYS)
        .unionByName(captioned.filter("ok").select(*KEYS))
        .unionByName(both.filter("n = 2").select(*KEYS))
        .distinct()
    )


def resume_pending(todo: DataFrame, done: DataFrame) -> DataFrame:
    return todo.join(done, list(KEYS), "left_anti")


def profile_record(records: DataFrame, fields: Sequence[str], first: int = 8) -> DataFrame:
    """First values and length of every array field, one row per record and field."""
    looks = [
        F.struct(
            F.lit(f).alias("field"),
            F.array_join(F.transform(F.slice(f, 1, first), lambda x: x.cast("string")), ",").alias("sample"),
            F.size(f).cast("long").alias("length"),
        )
        for f in fields
    ]
    return records.select(*KEYS, F.explode(F.array(*looks)).alias("p")).select(*KEYS, "p.*")


def pick_head(videos: DataFrame, start: int = 0, stop: int | None = None, natural: bool = True) -> DataFrame:
    """An index range of groups, in natural order of their numeric suffix or in text order."""
    suffix = F.regexp_extract("video_id", r"_(\d+)$", 1).try_cast("bigint")
    order = [suffix, F.col("video_id")] if natural else [F.col("video_id")]
    if start == 0 and stop is not None:
        return videos.orderBy(*order).limit(stop)
    placed = with_position(videos, [], order, "_p")
    kept = placed.filter(F.col("_p") >= start)
    return (kept if stop is None else kept.filter(F.col("_p") < stop)).drop("_p")
