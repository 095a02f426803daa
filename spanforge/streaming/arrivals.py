"""Directories that fill over time, read as streams.

What has been read and which ids were seen live in the checkpoint, so a restarted query
goes on where it stopped. ``available_now`` takes what is there and ends.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from spanforge.operators.ordered import with_position
from spanforge.session import checkpoint, fresh_dir

# Folders of flushes that a task writes one after another, beyond one task for each core.
FOLDERS_PER_TASK = 64
# What is known after a batch: flushes written so far, whether the rest was written too, and rows carried on.
_FACTS = StructType(
    [StructField("batch", LongType()), StructField("flushes", LongType()), StructField("closed", BooleanType()), StructField("carried", LongType())]
)


def arriving_files(
    spark: SparkSession, folder: str, schema: StructType, glob: str = "*", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def seen_once(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first arrival of every id, across batches and restarts."""
    return stream.dropDuplicates(list(keys))


def watch_arrivals(
    stream: DataFrame, metadata: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """New ids joined to what is known about them; unknown ids are dropped."""
    return seen_once(stream, keys).join(metadata, list(keys))


def _to_files(stream: DataFrame, out: str, state: str) -> DataStreamWriter:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)


def run_to_table(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Append a stream to a Parquet folder until the arrivals are used up; returns the table."""
    _to_files(stream, out, state).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def keep_table(stream: DataFrame, out: str, state: str, every: str) -> StreamingQuery:
    """The same at every interval, for as long as the returned query runs."""
    return _to_files(stream, out, state).trigger(processingTime=every).start()


def flush_every_n(
    stream: DataFrame,
    n: int,
    derive: Callable[[DataFrame], DataFrame],
    out: str,
    state: str,
    order: Sequence[str] | None = None,
    close: bool = True,
) -> None:
    """Write what ``derive`` makes of every ``n`` results, as folder ``flush=0``, ``flush=1``, ... of ``out``.

    A flush holds exactly ``n`` results, however many arrive at a time. Results that are left over after a batch are carried to the next
    one, also over restarts; ``close`` writes them as a last, smaller flush once the arrivals are used up. ``derive`` gets rows with
    a column ``flush`` and must keep it. Within a batch results follow ``order`` (all columns unless given). The number of flushes and the
    rows carried on lie below ``state``, by batch: a batch that is repeated after a failure starts from what the batch before
    left, and replaces its own flushes. Results are numbered by a distributed running count.
    """
    spark = stream.sparkSession
    facts, carried = f"{state}/facts", f"{state}/carried"
    kinds = StructType([*stream.schema.fields, *_FACTS.fields[:1]])
    start = spark.createDataFrame([(-1, 0, False, 0)], _FACTS)
    start.write.mode("ignore").partitionBy("batch").parquet(facts)
    spark.createDataFrame([], kinds).write.mode("ignore").partitionBy("batch").parquet(carried)

    def latest(before: int | None = None) -> Row:
        known = spark.read.schema(_FACTS).parquet(facts)
        known = known if before is None else known.filter(F.col("batch") < before)
        return known.orderBy(F.desc("batch"), F.desc("closed")).first()

    def rows_of(fact: Row) -> DataFrame:
        rows = spark.read.schema(kinds).parquet(carried)
        return rows.filter((F.col("batch") == fact["batch"]) & F.lit(not fact["closed"])).drop("batch")

    def replace(df: DataFrame, place: str, by: str, folders: int = 1) -> None:
        if folders > 1:
            # A folder takes as long as some thousand rows, so tasks are dealt out by folders, however few rows these hold.
            most = max(spark.sparkContext.defaultParallelism, -(-folders // FOLDERS_PER_TASK))
            df = df.repartition(min(folders, most), by)
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(place)

    def note(batch: int, flushes: int, closed: bool, left: int) -> None:
        # A closing note stands beside that of its batch.
        fact = spark.createDataFrame([(batch, flushes, closed, left)], _FACTS)
        fact.write.mode("append" if closed else "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(facts)

    def write(batch: DataFrame, number: int) -> None:
        before = latest(number)
        rows = rows_of(before).withColumn("_late", F.lit(0)).unionByName(batch.withColumn("_late", F.lit(1)))
        rows = checkpoint(rows)
        placed = with_position(rows, [], [F.col("_late"), *[F.col(c) for c in order or batch.columns]], "_at").drop("_late")
        full, left = divmod(rows.count(), n)
        if full:
            flush = (F.floor(F.col("_at") / n) + before["flushes"]).cast("long")
            replace(derive(placed.filter(F.col("_at") < full * n).withColumn("flush", flush).drop("_at")), out, "flush", full)
        replace(placed.filter(F.col("_at") >= full * n).drop("_at").withColumn("batch", F.lit(number).cast("long")), carried, "batch")
        note(number, before["flushes"] + full, False, left)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state}/query")
    query.trigger(availableNow=True).start().awaitTermination()
    last = latest()
    if close and last["carried"] and not last["closed"]:
        replace(derive(rows_of(last).withColumn("flush", F.lit(last["flushes"]).cast("long"))), out, "flush")
        note(last["batch"], last["flushes"] + 1, True, 0)


def scratch(spark: SparkSession, label: str) -> tuple[str, str]:
    """New output and state folders below the shared folder."""
    base = fresh_dir(spark, label)
    return f"{base}/out", f"{base}/state"
