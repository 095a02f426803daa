"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import minhash, packing, pii, suffix_dedup, toxicity
from spanforge.session import fresh_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon does not call toxic; null and empty texts stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_texts(docs.select(*COLUMNS), model, keep=list(COLUMNS))
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that is alike in 80 % of its five-word shingles.

    Of equal texts with that id all rows stay. Texts without words, and rows without an id, are kept.
    """
    named = docs.select(*COLUMNS).withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    found = minhash.near_duplicates(named, params=minhash.Params(words=5), keep=("_sha",))
    gone = found.filter(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "_sha").distinct()
    return named.join(gone, ["doc_id", "_sha"], "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that an earlier document holds; characters stay whole.

    Documents of which nothing is left are dropped, those that were empty before stay.
    """
    p = suffix_dedup.Params()
    cut = suffix_dedup.remove_repeats(docs.select(*COLUMNS), params=p, kept_text=True, keep=("lang", "source"))
    cut = cut.filter((F.col("kept_text") != "") | (F.col("n_bytes") == 0))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by the name of its kind."""
    found = pii.find_pii(docs.select(*COLUMNS), masked=True, keep=["doc_id", "lang", "source"])
    return found.select("doc_id", F.col("masked_text").alias("text"), "lang", "source", F.char_length("masked_text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# Learned lexicons and tokenizers have no SQL form; the tests hold run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        place = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
