"""Stored tables whose rows are changed by rewriting only the parts that hold them.

A store deals its rows to buckets by a hash of their keys. ``data/version=V/bucket=B`` holds the rows of a bucket as version V wrote them, and
``manifest`` lists for every version which copy of each bucket counts. A change writes new copies of the buckets it touches, compares
counts, and only then the new manifest: readers see all of it or nothing, and the versions before remain as backup.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators.ordered import KEYS
from spanforge.sources.records import upsert_columns

BUCKETS = 64
MANIFEST = "version long, bucket int, copy long, rows long, buckets int"


@dataclass(frozen=True)
class Change:
    """Rows removed or changed by a version, rows of the store after it, and the buckets that were written anew."""

    version: int
    changed: int
    rows: int
    rewritten: tuple[int, ...]


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, int, dict[int, tuple[int, int]]]:
    """(version, number of buckets, bucket -> (copy, rows)); one row per bucket."""
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    version = rows.agg(F.max("version")).first()[0] if version is None else version
    listed = rows.filter(F.col("version") == version).collect()
    if not listed:
        raise ValueError(f"no version {version} in {path}")
    return version, listed[0]["buckets"], {r["bucket"]: (r["copy"], r["rows"]) for r in listed if r["bucket"] >= 0}


def _note(spark: SparkSession, path: str, version: int, buckets: int, parts: dict[int, tuple[int, int]]) -> None:
    # Bucket -1 stands for the version itself, so that an empty store has one row too.
    rows = [(b, copy, n, buckets) for b, (copy, n) in sorted(parts.items())] + [(-1, version, 0, buckets)]
    listed = spark.createDataFrame(rows, "bucket int, copy long, rows long, buckets int").coalesce(1)
    listed.withColumn("version", F.lit(version).cast("long")).write.mode("append").partitionBy("version").parquet(f"{path}/manifest")


def _copies(spark: SparkSession, path: str, parts: dict[int, tuple[int, int]]) -> DataFrame:
    """Rows of the given copies, with their ``bucket``."""
    places = [f"{path}/data/version={copy}/bucket={b}" for b, (copy, _) in sorted(parts.items())]
    read = spark.read.option("basePath", f"{path}/data").option("mergeSchema", "true").parquet(*places)
    return read.drop("version")


def _write(df: DataFrame, path: str, version: int, buckets: int) -> dict[int, int]:
    """Writes rows with their ``bucket`` as copies of a version; rows of each, counted from what was written."""
    place = f"{path}/data/version={version}"
    df.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
    counted = df.sparkSession.read.schema(df.schema).parquet(place).groupBy("bucket").count().collect()
    return {r["bucket"]: r["count"] for r in counted}


def create_store(df: DataFrame, path: str, keys: Sequence[str] = KEYS, buckets: int = BUCKETS) -> Change:
    """A new store as version 0; a path that holds one raises."""
    written = _write(df.withColumn("bucket", _bucket(keys, buckets)), path, 0, buckets)
    _note(df.sparkSession, path, 0, buckets, {b: (0, n) for b, n in written.items()})
    return Change(0, sum(written.values()), sum(written.values()), tuple(sorted(written)))


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the last version or of an earlier one; columns that a bucket lacks are null."""
    _, _, parts = _manifest(spark, path, version)
    if not parts:
        # Version 0 knows the columns even if no bucket is left.
        _, _, first = _manifest(spark, path, 0)
        return _copies(spark, path, first).drop("bucket").limit(0) if first else spark.createDataFrame([], "empty int")
    return _copies(spark, path, parts).drop("bucket")


def _change(
    spark: SparkSession,
    path: str,
    ids: DataFrame,
    keys: Sequence[str],
    new_rows: Callable[[DataFrame, DataFrame], DataFrame],
    counted: Callable[[DataFrame, DataFrame], DataFrame],
    lost: bool,
) -> Change:
    keys = list(keys)
    version, buckets, parts = _manifest(spark, path)
    asked = ids.withColumn("bucket", _bucket(keys, buckets))
    may = {r["bucket"] for r in asked.select("bucket").distinct().collect()} & parts.keys()
    hit: dict[int, int] = {}
    if may:
        held = _copies(spark, path, {b: parts[b] for b in may})
        hit = {r["bucket"]: r["count"] for r in counted(held, asked).groupBy("bucket").count().collect()}
    rows = sum(n for _, n in parts.values())
    if not hit:
        return Change(version, 0, rows, ())
    touched = {b: parts[b] for b in hit}
    written = _write(new_rows(_copies(spark, path, touched), asked), path, version + 1, buckets)
    for b, (_, before) in touched.items():
        if written.get(b, 0) + (hit[b] if lost else 0) != before:
            raise ValueError(f"bucket {b} of {path} had {before} rows, {written.get(b, 0)} were written and {hit[b]} changed")
    kept = {b: p for b, p in parts.items() if b not in touched} | {b: (version + 1, n) for b, n in written.items()}
    _note(spark, path, version + 1, buckets, kept)
    changed = sum(hit.values())
    return Change(version + 1, changed, rows - changed if lost else rows, tuple(sorted(touched)))


def delete_stored(spark: SparkSession, path: str, failed: DataFrame, keys: Sequence[str] = KEYS) -> Change:
    """Removes the rows of the failed keys from a store; buckets without one keep their files.

    Removed and kept rows are counted for each bucket and must add up to what it held, else the store stays at
    its version and an error is raised. Keys that the store lacks, and null keys, remove nothing.
    """
    ids = failed.select(*keys).dropna().distinct()
    hits = lambda held, asked: held.join(asked, [*keys, "bucket"], "left_semi")
    rest = lambda held, asked: held.join(asked, [*keys, "bucket"], "left_anti")
    return _change(spark, path, ids, keys, rest, hits, lost=True)


def upsert_stored(
    spark: SparkSession, path: str, fresh: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS, force: bool = False
) -> Change:
    """Adds derived columns to the rows of a store, or fills them where they are null; ``force`` also replaces values.

    ``fresh`` has one row per key. Only buckets in which some value changes are written anew. Keys that the store lacks add no rows.
    """

    def hits(held: DataFrame, asked: DataFrame) -> DataFrame:
        renamed = asked.select(*keys, "bucket", *[F.col(c).alias(f"_new_{c}") for c in columns])
        changes = F.lit(False)
        for c in columns:
            new, old = F.col(f"_new_{c}"), F.col(c) if c in held.columns else F.lit(None)
            changes = changes | (new.isNotNull() & (~new.eqNullSafe(old) if force else old.isNull()))
        return held.join(renamed, [*keys, "bucket"]).filter(changes)

    def filled(held: DataFrame, asked: DataFrame) -> DataFrame:
        return upsert_columns(held, asked.drop("bucket"), columns, keys, force)

    return _change(spark, path, fresh, keys, filled, hits, lost=False)
