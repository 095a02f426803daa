"""Files of ``{key: value, ...}`` objects, split at their top-level entries by many tasks.

Spark's text source deals a file out by byte ranges, with ``}`` as its separator, so ranges are read without regard to the
entries in them. Whether a range begins inside a string, and how deep, depends on all ranges before it. Each range is therefore
scanned as a function: for either start state (outside or inside a string) it gives the end state and the change of depth. These functions
compose, a prefix over the ranges of a file fixes every start state, and a second scan cuts the entries out. Only the text at the borders of
ranges is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.operators.joins import fits_broadcast

RANGE = ["path", "block"]
# Bytes of records scanned at once; one longer record is a portion of its own.
PORTION = 8 << 20
# Depth changes and the separators looked for, by byte.
DEPTH = np.zeros(256, np.int8)
DEPTH[[ord("{"), ord("[")]] = 1
DEPTH[[ord("}"), ord("]")]] = -1
BLANK = np.zeros(256, bool)
BLANK[[ord(c) for c in " \t\r\n"]] = True


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """path, block, size, value: records between closing braces, in file order within each range."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("value"),
    )


def quotes(data: np.ndarray) -> np.ndarray:
    """Places of the quotes that no backslash escapes."""
    found = np.flatnonzero(data == ord('"'))
    slashes = data == ord("\\")
    if not slashes.any():
        return found
    # The place of the last other byte before each place tells how long a run of backslashes is.
    other = np.maximum.accumulate(np.where(slashes, -1, np.arange(len(data))))
    before = np.where(found > 0, other[found - 1], -1)
    return found[(found - 1 - before) % 2 == 0]


def scan(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(whether each byte lies outside strings, depth change of each byte, whether the end is inside a string)."""
    marks = np.zeros(len(data), np.int8)
    marks[quotes(data)] = 1
    state = (np.cumsum(marks, dtype=np.int64) + inside) & 1
    outside = (state == 0) & (marks == 0)
    return outside, np.where(outside, DEPTH[data], 0), bool(state[-1]) if len(data) else inside


def _portions(batch: pa.RecordBatch, at: int) -> Iterator[tuple[tuple, bytes]]:
    """Runs of records of one range, each with its closing brace again: (path, block, extra columns), bytes."""
    keys = list(zip(*[batch.column(i).to_pylist() for i in range(at)]))
    values = batch.column(at)
    start = 0
    while start < batch.num_rows:
        stop, size, parts = start, 0, []
        while stop < batch.num_rows and keys[stop] == keys[start] and (size == 0 or size < PORTION):
            value = values[stop].as_py() or b""
            parts.append(value)
            size += len(value) + 1
            stop += 1
        yield keys[start], b"}".join([*parts, b""])
        start = stop


def _functions(records: DataFrame) -> DataFrame:
    """path, block, size, bytes, flips, deep_out, deep_in: each range as a function of its start state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, state, deep = None, 0, [0, 1], [0, 0]

        def row() -> pa.RecordBatch:
            columns = [[key[0]], [key[1]], [key[2]], [total], [state[0]], [deep[0]], [deep[1]]]
            kinds = [pa.string(), *[pa.int64()] * 6]
            names = ["path", "block", "size", "bytes", "flips", "deep_out", "deep_in"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for own, raw in _portions(batch, 3):
                if own != key:
                    if key is not None:
                        yield row()
                    key, total, state, deep = own, 0, [0, 1], [0, 0]
                data = np.frombuffer(raw, np.uint8)
                total += len(data)
                for k in range(2):
                    _, change, end = scan(data, bool(state[k]))
                    deep[k] += int(change.sum())
                    state[k] = int(end)
        if key is not None:
            yield row()

    schema = "path string, block long, size long, bytes long, flips long, deep_out long, deep_in long"
    return records.mapInArrow(run, schema)


def start_states(functions: DataFrame) -> DataFrame:
    """path, block, inside, depth, phantom: the state at the start of each range; broken files raise.

    One row per range goes through one window per file. ``phantom`` marks the range whose last closing brace is not in the file, as
    the file does not end with one.
    """
    w = Window.partitionBy("path").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy("path")
    states = functions.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    states = states.withColumn("deep", F.when(F.col("inside") == 1, F.col("deep_in")).otherwise(F.col("deep_out")))
    states = states.withColumn("depth", F.coalesce(F.sum("deep").over(before), F.lit(0)))
    read, size = F.sum("bytes").over(all_), F.col("size")
    last = F.col("block") == F.max("block").over(all_)
    missing = read - size  # 1: the reader's last separator is not in the file
    ended = (F.sum("flips").over(all_) % 2 == 0) & (F.sum("deep").over(all_) + missing == 0)
    sound = missing.isin(0, 1) & ended
    message = F.concat(F.lit("not a sequence of whole JSON objects: "), F.col("path"))
    checked = F.when(sound, F.col("depth")).otherwise(F.raise_error(message).cast("long"))
    return states.select("path", "block", (F.col("inside") == 1).alias("inside"), checked.alias("depth"), (last & (missing == 1)).alias("phantom"))


class _Cutter:
    """Cuts the entries of one range. A piece is (number, whether it goes on from the range before, whether it ends here, text)."""

    def __init__(self, path: str, block: int, inside: bool, depth: int, phantom: bool) -> None:
        self.path, self.inside, self.depth, self.phantom = path, inside, depth, phantom
        self.number, self.open, self.goes_on = 0, [], depth > 0
        self.held = b""

    def feed(self, raw: bytes, last: bool = False) -> Iterator[tuple[int, bool, bool, bytes]]:
        if self.phantom:
            # Only the last brace of the range is not in the file, so one portion is held back.
            self.held, raw = raw, self.held
            if last:
                raw = raw[:-1]
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            return
        outside, change, self.inside = scan(data, self.inside)
        depth = np.cumsum(change, dtype=np.int64) + self.depth
        before = depth - change
        opens, closes = (change == 1) & (before == 0), (change == -1) & (depth == 0)
        commas = outside & (data == ord(",")) & (depth == 1)
        stray = (before == 0) & (depth == 0) & ~(outside & BLANK[data]) | (opens & (data != ord("{"))) | (closes & (data != ord("}"))) | (depth < 0)
        if stray.any():
            raise ValueError(f"not a sequence of JSON objects: {self.path}")
        start = 0
        for place in np.flatnonzero(opens | closes | commas).tolist():
            if not opens[place]:
                self.open.append(raw[start:place])
                yield from self._piece(ends=True)
            start = place + 1
        if depth[-1] > 0:
            self.open.append(raw[start:])
        self.depth = int(depth[-1])

    def _piece(self, ends: bool) -> Iterator[tuple[int, bool, bool, bytes]]:
        text = b"".join(self.open)
        if self.goes_on or not ends or text.strip():
            yield self.number, self.goes_on, ends, text
            self.number += 1
        self.open, self.goes_on = [], False

    def finish(self) -> Iterator[tuple[int, bool, bool, bytes]]:
        if self.phantom:
            yield from self.feed(b"", last=True)
        if self.depth > 0:
            yield from self._piece(ends=False)


def _pieces(records: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter = None, None

        def rows(found: list) -> pa.RecordBatch:
            columns = [[key[0]] * len(found), [key[1]] * len(found), *[[f[i] for f in found] for i in range(4)]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
            names = ["path", "block", "number", "goes_on", "ends", "text"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for own, raw in _portions(batch, 5):
                if own != key:
                    if cutter is not None and (found := list(cutter.finish())):
                        yield rows(found)
                    key, cutter = own, _Cutter(*own)
                if found := list(cutter.feed(raw)):
                    yield rows(found)
        if cutter is not None and (found := list(cutter.finish())):
            yield rows(found)

    return records.mapInArrow(run, "path string, block long, number long, goes_on boolean, ends boolean, text binary")


def split_json_maps(spark: SparkSession, path: str) -> DataFrame:
    """path, entry: every top-level ``"key": value`` of the files below ``path``, as text.

    A file holds one object or several, on one line or many. Files are read by ranges of
    ``spark.sql.files.maxPartitionBytes``; an entry that crosses ranges is put together from its pieces, so only single
    entries must fit into a row. Strings may hold brackets, quotes and escapes. Empty objects and empty files give no entries. A file that
    ends within an object, or holds anything but objects, raises an error when the result is computed.
    """
    records = _ranges(spark, path)
    states = start_states(_functions(records))
    if fits_broadcast(states):
        known = records.join(F.broadcast(states), RANGE)
    else:
        placed = records.withColumn("_row", F.monotonically_increasing_id()).join(states, RANGE)
        known = placed.repartition(*RANGE).sortWithinPartitions(*RANGE, "_row")
    pieces = _pieces(known.select(*RANGE, "inside", "depth", "phantom", "value"))
    # Conditions of a reader are tested before these filters, so other pieces have no text there.
    alone = ~F.col("goes_on") & F.col("ends")
    whole = pieces.filter(alone).select("path", F.when(alone, F.col("text")).alias("text"))
    # At most two pieces of a range are parts: they are numbered by the entries that begin among them.
    parts = pieces.filter(F.col("goes_on") | ~F.col("ends"))
    w = Window.partitionBy("path").orderBy("block", "number")
    begun = F.sum((~F.col("goes_on")).cast("long")).over(w)
    named = parts.select(*RANGE, "number", "goes_on").withColumn("_entry", begun).drop("goes_on")
    joined = parts.join(named, [*RANGE, "number"])
    ordered = F.sort_array(F.collect_list(F.struct("block", "number", "text")))
    glued = F.aggregate(ordered, F.lit(b""), lambda a, p: F.concat(a, p["text"]))
    rest = joined.groupBy("path", "_entry").agg(glued.alias("text")).select("path", "text")
    rows = whole.unionByName(rest).select("path", F.col("text").cast("string").alias("entry"))
    return rows.filter(F.regexp(F.col("entry"), F.lit(r"\S")))


def read_json_map(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """``{video_id: {...}}`` files as one row per video: dataset, video_id, doc; see :func:`split_json_maps`.

    An entry that is no ``"key": value`` raises an error; a key that occurs several times gives several rows.
    """
    entries = split_json_maps(spark, path)
    parsed = F.from_json(F.concat(F.lit("{"), F.col("entry"), F.lit("}")), "MAP<STRING, STRING>")
    message = F.concat(F.lit("not an entry of a JSON object: "), F.substring("entry", 1, 100))
    one = F.when(F.size(F.map_keys(parsed)) == 1, F.map_entries(parsed)[0])
    # Spark may look at rows before split_json_maps has dropped them; only texts are errors.
    failed = F.raise_error(message).cast("struct<key: string, value: string>")
    checked = one.when(F.regexp(F.col("entry"), F.lit(r"\S")), failed)
    return entries.select(checked.alias("e")).select(F.lit(dataset).alias("dataset"), F.col("e.key").alias("video_id"), F.col("e.value").alias("doc"))
