"""Helpers used by several operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.session import checkpoint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


# Texts handed to Python at a time, in characters; one longer text is a portion of its own.
PORTION = 4_000_000


def map_texts(
    docs: DataFrame, keep: list[str], text: str, work: Callable[[list[str]], dict[str, list]], added: dict[str, pa.DataType]
) -> DataFrame:
    """The kept columns, unchanged, and those that ``work`` makes of the texts (null: empty), row by row.

    Kept columns stay Arrow arrays, so integers and nulls survive; Python sees a bounded portion at a time.
    """
    fields = [docs.schema[k] for k in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` {_ddl(t)}" for n, t in added.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lengths = batch.column(1).to_pylist()
            start = 0
            while start < n:
                stop, size = start + 1, lengths[start]
                while stop < n and size + lengths[stop] <= PORTION:
                    size += lengths[stop]
                    stop += 1
                part = batch.slice(start, stop - start)
                out = work(part.column(0).to_pylist())
                arrays = [pa.array(out[name], kind) for name, kind in added.items()]
                yield pa.RecordBatch.from_arrays(part.columns[2:] + arrays, names=[*keep, *added])
                start = stop

    value = text_or_empty(text)
    narrow = docs.select(value.alias("_text"), F.char_length(value).alias("_length"), *keep)
    return narrow.mapInArrow(run, schema)


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean"}
    return names[kind]


def give_back() -> None:
    """Hands memory that earlier work of a Python worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def smallest_reachable(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternating stars: every node first hands its larger neighbours to its smallest neighbour, then
    its smaller ones. Both halves are one grouped minimum (combined before the shuffle) and one join, so
    a hub of any degree is split by Spark's skew join; each round is checkpointed. Null ends are
    ignored. The rounds end when a round changes nothing; their number grows with the logarithm of
    the longest path.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    links, seen = checkpoint(links), None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.filter(F.col("u") != F.col("v")).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    leaves = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
