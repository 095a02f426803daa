"""Kernel work on sequences too long for one task: blocks of vectors, pairs of blocks as tasks.

All pairs of a sequence are looked at by definition, so a block travels to every block it meets, as one row of packed
vectors; pairs of vectors stay inside tiles of a matrix product and never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanforge.operators.ordered import KEYS, Oversize, find_oversize, with_position
from spanforge.session import checkpoint, fresh_dir, row_limit

# Vectors of a group that one task may work on alone, and of a block of larger groups (a multiple of STRIP).
ALONE = 8_192
BLOCK = 2_048
# Rows and columns of a tile of a matrix product. Tiles have one shape, so a pair has the same bits wherever it is computed.
STRIP = 256
# Block of the segmentation, rows of its table that travel together, and columns that are put together in one task.
STEPS, COUNTS, ENDS = 1_024, 256, 128


def alone_limit(spark: SparkSession) -> int:
    return min(ALONE, row_limit(spark))


def cut_tiles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tiles padded with zeros, their squared norms, their row counts)."""
    n, count = len(x), -(-len(x) // STRIP)
    tiles = np.zeros((count * STRIP, x.shape[1]))
    tiles[:n] = x
    tiles = tiles.reshape(count, STRIP, -1)
    sizes = np.minimum(n - STRIP * np.arange(count), STRIP)
    return tiles, (tiles * tiles).sum(axis=2), sizes


def squared_gaps(a: tuple, i: int, b: tuple, j: int) -> np.ndarray:
    gaps = a[1][i][:, None] + b[1][j][None, :] - 2.0 * (a[0][i] @ b[0][j].T)
    return np.maximum(gaps, 0.0)[: a[2][i], : b[2][j]]


def gap_tiles(a: tuple, b: tuple | None = None) -> Iterator[np.ndarray]:
    """Non-zero distances, tile by tile: between two blocks, or of all pairs of one."""
    for i in range(len(a[0])):
        for j in range(i if b is None else 0, len((b or a)[0])):
            gaps = np.sqrt(squared_gaps(a, i, b or a, j))
            gaps = gaps[np.triu_indices(len(gaps), 1)] if b is None and i == j else gaps.reshape(-1)
            yield gaps[gaps > 0]


# ---- blocks ----------------------------------------------------------------

def _pack(group: pd.DataFrame) -> bytes:
    return np.ascontiguousarray(np.stack(group.sort_values("_at")["feature"].to_numpy()), dtype="<f8").tobytes()


def _unpack(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(rows, -1)


def pack_blocks(frames: DataFrame, keys: Sequence[str], size: int, over: Oversize, carried: Sequence[str] = ()) -> DataFrame:
    """keys, carried columns, block, n, x: each run of ``size`` vectors in step order as one row."""
    order = [F.col("step")] if "step" in frames.columns else [F.col("feature")]
    placed = with_position(frames, keys, order, "_at", over)
    placed = placed.withColumn("block", F.floor(F.col("_at") / size).cast("long"))
    names = [*keys, *carried]
    schema = ", ".join(f"{c} {frames.schema[c].dataType.simpleString()}" for c in names) + ", block long, n long, x binary"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        fixed = {c: [group[c].iloc[0]] for c in names}
        return pd.DataFrame({**fixed, "block": [int(group["block"].iloc[0])], "n": [len(group)], "x": [_pack(group)]})

    return placed.select(*names, "block", "_at", "feature").groupBy(*keys, "block").applyInPandas(one, schema)


def meet(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each block once for every block of its group that it meets: adds ``low`` and ``high``."""
    count = blocks.groupBy(*keys).agg(F.max("block").alias("_last"))
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))).alias("_with")
    out = blocks.join(count, list(keys)).select(*blocks.columns, partner)
    return out.select(*blocks.columns, F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"))


def _two(group: pd.DataFrame) -> tuple[tuple, tuple | None]:
    group = group.sort_values("block")
    tiles = [cut_tiles(_unpack(x, n)) for x, n in zip(group["x"], group["n"], strict=True)]
    return tiles[0], tiles[1] if len(tiles) > 1 else None


# ---- the middle distance ---------------------------------------------------

def median_gap_by_blocks(frames: DataFrame, over: Oversize, size: int | None = None) -> DataFrame:
    """KEYS, sigma: the exact median of the non-zero distances of groups of any size; 1 if there is none.

    Positive doubles sort like their bits. Four passes count the next 16 bits of the distances that still are candidates, per
    pair of blocks; the sums over all pairs fix the digit of the middle. The result has the bits of the one-task form.
    """
    blocks = checkpoint(pack_blocks(frames, KEYS, size or BLOCK, over))
    pairs = meet(blocks, KEYS)
    names = ", ".join(f"{k} string" for k in KEYS)
    state = None
    for shift in (48, 32, 16, 0):
        asked = pairs if state is None else pairs.join(_prefixes(state), list(KEYS))

        counted = asked.groupBy(*KEYS, "low", "high").applyInPandas(_digit_counter(shift), f"{names}, prefix long, digit long, n long")
        counts = checkpoint(counted.groupBy(*KEYS, "prefix", "digit").agg(F.sum("n").alias("n")))
        if state is None:
            total = counts.groupBy(*KEYS).agg(F.sum("n").alias("total"))
            rank = F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2))).alias("rank")
            state = total.select(*KEYS, F.lit(0).cast("long").alias("prefix"), rank)
            state = state.withColumn("which", F.row_number().over(Window.partitionBy(*KEYS).orderBy("rank")))
        w = Window.partitionBy(*KEYS, "which").orderBy("digit")
        ranked = state.join(counts, [*KEYS, "prefix"]).withColumn("ends", F.sum("n").over(w))
        hit = ranked.filter((F.col("ends") > F.col("rank")) & (F.col("ends") - F.col("n") <= F.col("rank")))
        prefix = (F.col("prefix") * (1 << 16) + F.col("digit")).alias("prefix")
        state = checkpoint(hit.select(*KEYS, "which", prefix, (F.col("rank") - F.col("ends") + F.col("n")).alias("rank")))

    def middle(group: pd.DataFrame) -> pd.DataFrame:
        two = group["prefix"].to_numpy(np.int64).view(np.float64)
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in KEYS}, "sigma": [float((two[0] + two[-1]) / 2)]})

    found = state.groupBy(*KEYS).applyInPandas(middle, f"{names}, sigma double")
    groups = blocks.select(*KEYS).distinct().join(found, list(KEYS), "left")
    return groups.select(*KEYS, F.coalesce("sigma", F.lit(1.0)).alias("sigma"))


def _digit_counter(shift: int):
    """Counts, for one pair of blocks, of the 16 bits above ``shift`` of the distances that begin with a wanted prefix."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        wanted = [0] if "prefixes" not in group else sorted(set(group["prefixes"].iloc[0]))
        counts = {p: np.zeros(1 << 16, np.int64) for p in wanted}
        for gaps in gap_tiles(*_two(group)):
            bits = gaps.view(np.uint64) >> np.uint64(shift)
            above = (bits >> np.uint64(16)).astype(np.int64)
            digit = (bits & np.uint64(0xFFFF)).astype(np.int64)
            for p in wanted:
                counts[p] += np.bincount(digit[above == p], minlength=1 << 16)
        found = [(p, int(d), int(c[d])) for p, c in counts.items() for d in np.flatnonzero(c)]
        out = pd.DataFrame(found, columns=["prefix", "digit", "n"])
        return out.assign(**{k: group[k].iloc[0] for k in KEYS})[[*KEYS, "prefix", "digit", "n"]]

    return one


def _prefixes(state: DataFrame) -> DataFrame:
    return state.groupBy(*KEYS).agg(F.collect_set("prefix").alias("prefixes"))


# ---- kernel mass -----------------------------------------------------------

def mass_of(a: tuple, b: tuple | None, sigma: float) -> float:
    """Sum of the Gaussian kernel over all pairs of two blocks, or of one."""
    parts = [
        float(np.exp(-squared_gaps(a, i, b or a, j) / (2.0 * sigma * sigma)).sum()) for i in range(len(a[0])) for j in range(len((b or a)[0]))
    ]
    return float(np.sum(parts))


def mass_by_blocks(frames: DataFrame, over: Oversize, size: int | None = None) -> DataFrame:
    """KEYS, shot_idx, length, mass: kernel mass over length of segments of any size, partial masses added in block order."""
    keys = [*KEYS, "shot_idx"]
    blocks = checkpoint(pack_blocks(frames, keys, size or BLOCK, over, carried=["sigma"]))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        a, b = _two(group)
        mass = mass_of(a, b, float(group["sigma"].iloc[0]))
        fixed = {k: [group[k].iloc[0]] for k in [*keys, "low", "high"]}
        return pd.DataFrame({**fixed, "mass": [mass if b is None else 2.0 * mass]})

    names = ", ".join(f"{k} string" for k in KEYS)
    partial = meet(blocks, keys).groupBy(*keys, "low", "high").applyInPandas(one, f"{names}, shot_idx long, low long, high long, mass double")
    ordered = F.sort_array(F.collect_list(F.struct("low", "high", "mass")))
    total = partial.groupBy(*keys).agg(F.aggregate(ordered, F.lit(0.0), lambda s, p: s + p["mass"]).alias("mass"))
    length = blocks.groupBy(*keys).agg(F.sum("n").alias("length"))
    return total.join(length, keys).select(*keys, "length", (F.col("mass") / F.col("length")).alias("mass"))


# ---- segmentation ----------------------------------------------------------

def _kernel(a: np.ndarray, b: np.ndarray, sigma: float) -> np.ndarray:
    gaps = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.exp(-gaps / (2.0 * sigma * sigma))


def _gain_block(kernel: np.ndarray, mass: np.ndarray, between: np.ndarray, own: np.ndarray, lengths: np.ndarray, min_len: int):
    """(gains of all segments from starts (rows) to ends (columns), mass of each start up to the last end).

    ``mass`` is that of each start up to the block of ends, ``between`` the kernel sums of each end's step with the steps between the two
    blocks and with earlier ones of its own, ``own`` its kernel with itself.
    """
    behind = np.cumsum(kernel[::-1], axis=0)[::-1]
    total = mass[:, None] + np.cumsum(2.0 * (behind + between) + own, axis=1)
    return np.where(lengths >= min_len, total / np.maximum(lengths, 1), -np.inf), total[:, -1]


def _best(table: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each count and end the best start and its value, of equal ones the first."""
    value = np.empty((len(table), gain.shape[1]))
    start = np.empty(value.shape, np.int64)
    for k in range(len(table)):
        through = table[k][:, None] + gain
        start[k] = through.argmax(axis=0)
        value[k] = through[start[k], np.arange(gain.shape[1])]
    return value, start


def cuts_by_blocks(frames: DataFrame, steps_per_segment: int, min_len: int, over: Oversize, steps: int | None = None) -> DataFrame:
    """KEYS, start, end: the segments of :func:`best_cuts` for sequences of any length.

    ``frames`` carries ``sigma``. Blocks of ends are solved one after another; for one of them every earlier block of starts, and every
    COUNTS rows of its part of the table of best values, is a task of its own. Starts hand their kernel mass on from one block of ends to
    the next. The table of best values and the starts that reached them are rows in the shared folder, and the way back reads one block
    of them at a time. A task holds at most (segments x block) values of 8 bytes and their starts, besides a square of a block.
    """
    spark = frames.sparkSession
    size = steps or STEPS
    names = ", ".join(f"{k} string" for k in KEYS)
    blocks = checkpoint(pack_blocks(frames, KEYS, size, over, carried=["sigma"]))
    facts = blocks.groupBy(*KEYS).agg(F.sum("n").alias("steps"), F.max("block").alias("last"))
    wanted = F.greatest(F.lit(1).cast("long"), F.least(F.floor(F.col("steps") / steps_per_segment), F.floor(F.col("steps") / min_len)))
    facts = checkpoint(facts.withColumn("wanted", wanted))
    blocks = blocks.join(facts, list(KEYS))
    last = facts.agg(F.max("last")).first()[0]
    place = fresh_dir(spark, "cuts")
    done: list[int] = []
    for b in range(last + 1):
        _solve_block(spark, blocks, b, size, min_len, place, names, done)
        done.append(b)
    return _way_back(spark, facts, size, place, names)


def _read(spark: SparkSession, place: str, kind: str, which: Sequence[int]) -> DataFrame:
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{place}/{kind}-{b}") for b in which])


def _solve_block(spark: SparkSession, blocks: DataFrame, b: int, size: int, min_len: int, place: str, names: str, done: list[int]) -> None:
    """Best values of all ends in block ``b``: written as table-b (as starts), origin-b, mass-b and edge-b."""
    base = b * size
    ends = blocks.filter(F.col("block") == b).select(*KEYS, "sigma", "wanted", F.col("x").alias("end_x"), F.col("n").alias("end_n"))
    reached = bool(done)
    if reached:
        starts = blocks.filter(F.col("block") < b).select(*KEYS, "block", "x", "n")

        def sums(group: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for r in group.itertuples():
                kernel = _kernel(_unpack(r.x, r.n), _unpack(r.end_x, r.end_n), r.sigma)
                rows.append((*[getattr(r, k) for k in KEYS], r.block, kernel.sum(axis=0).tolist()))
            return pd.DataFrame(rows, columns=[*KEYS, "block", "sums"])

        met = starts.join(ends, list(KEYS))
        met.groupBy(*KEYS, "block").applyInPandas(sums, f"{names}, block long, sums array<double>").write.parquet(f"{place}/sums-{b}")
        columns = spark.read.parquet(f"{place}/sums-{b}")
        listed = columns.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("block", "sums"))).alias("all_sums"))
        table, mass = _read(spark, place, "table", done), _read(spark, place, f"mass-{b - 1}", ["all"])
        work = table.join(met.join(listed, list(KEYS)).join(mass, [*KEYS, "block"]), [*KEYS, "block"])

        def reach(group: pd.DataFrame) -> pd.DataFrame:
            r = next(group.itertuples())
            x, y = _unpack(r.x, r.n), _unpack(r.end_x, r.end_n)
            own = _kernel(y, y, r.sigma)
            before = np.triu(own, 1).sum(axis=0)
            between = before + sum((np.array(s["sums"]) for s in r.all_sums if s["block"] > r.block), np.zeros(len(y)))
            first = r.block * size
            lengths = base + 1 + np.arange(len(y))[None, :] - (first + np.arange(len(x)))[:, None]
            gain, total = _gain_block(_kernel(x, y, r.sigma), np.array(r.mass), between, np.diag(own), lengths, min_len)
            value, start = _best(np.frombuffer(r.rows, "<f8").reshape(-1, len(x)), gain)
            out = []
            for at in range(0, len(y), ENDS):
                v, s = value[:, at : at + ENDS], start[:, at : at + ENDS] + first
                out.append((*[getattr(r, k) for k in KEYS], r.block, r.part, at, v.tobytes(), s.astype("<i8").tobytes(), None))
            if r.part == 0:
                out.append((*[getattr(r, k) for k in KEYS], r.block, -1, -1, None, None, total.tolist()))
            return pd.DataFrame(out, columns=[*KEYS, "block", "part", "at", "value", "start", "mass"])

        schema = f"{names}, block long, part long, at long, value binary, start binary, mass array<double>"
        work.groupBy(*KEYS, "block", "part").applyInPandas(reach, schema).write.parquet(f"{place}/reach-{b}")
        met_again = spark.read.parquet(f"{place}/reach-{b}")

        def put(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("block")
            value = start = None
            for v, s in zip(group["value"], group["start"], strict=True):
                v, s = np.frombuffer(v, "<f8"), np.frombuffer(s, "<i8")
                if value is None:
                    value, start = v.copy(), s.copy()
                else:
                    better = v > value
                    value[better], start[better] = v[better], s[better]
            fixed = {k: [group[k].iloc[0]] for k in [*KEYS, "part", "at"]}
            return pd.DataFrame({**fixed, "value": [value.tobytes()], "start": [start.tobytes()]})

        pieces = met_again.filter("part >= 0").groupBy(*KEYS, "part", "at")
        far = pieces.applyInPandas(put, f"{names}, part long, at long, value binary, start binary")
        far = far.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("part", "at", "value", "start"))).alias("far"))
        edge = spark.read.parquet(f"{place}/edge-{b - 1}")
        ends = ends.join(far, list(KEYS)).join(edge, list(KEYS))

    def close(group: pd.DataFrame) -> pd.DataFrame:
        r = next(group.itertuples())
        y, wanted, n = _unpack(r.end_x, r.end_n), int(r.wanted), int(r.end_n)
        value, start = np.full((wanted + 1, n), -np.inf), np.zeros((wanted + 1, n), np.int64)
        left = np.full(wanted + 1, -np.inf)
        left[0] = 0.0
        if reached:
            for p in r.far:
                v = np.frombuffer(p["value"], "<f8")
                width = min(ENDS, n - p["at"])
                v, s = v.reshape(-1, width), np.frombuffer(p["start"], "<i8").reshape(-1, width)
                # Values of starts with so many segments are reached with one more.
                rows = slice(p["part"] * COUNTS + 1, min(p["part"] * COUNTS + 1 + len(v), wanted + 1))
                value[rows, p["at"] : p["at"] + width] = v[: rows.stop - rows.start]
                start[rows, p["at"] : p["at"] + width] = s[: rows.stop - rows.start]
            left = np.frombuffer(r.edge, "<f8")
        kernel = _kernel(y, y, r.sigma)
        behind = np.cumsum(np.triu(kernel, 1)[::-1], axis=0)[::-1]
        added = np.triu(2.0 * behind + np.diag(kernel)[None, :])
        total = np.cumsum(added, axis=1)
        table = np.empty((wanted + 1, n))
        for e in range(n):
            table[:, e] = left if e == 0 else value[:, e - 1]
            usable = e + 1 - min_len + 1
            if usable > 0:
                gain = total[:usable, e] / np.arange(e + 1, e + 1 - usable, -1)
                through = table[:-1, :usable] + gain
                at = through.argmax(axis=1)
                found = through[np.arange(wanted), at]
                better = found > value[1:, e]
                value[1:, e][better] = found[better]
                start[1:, e][better] = at[better] + base
        fixed = [getattr(r, k) for k in KEYS]
        out = [(*fixed, b, p, table[p * COUNTS : (p + 1) * COUNTS].tobytes(), start[p * COUNTS : (p + 1) * COUNTS].astype("<i4").tobytes(), None, None) for p in range(-(-(wanted + 1) // COUNTS))]
        out.append((*fixed, b, -1, None, None, value[:, -1].tobytes(), total[:, -1].tolist()))
        return pd.DataFrame(out, columns=[*KEYS, "block", "part", "rows", "origin", "edge", "mass"])

    schema = f"{names}, block long, part long, rows binary, origin binary, edge binary, mass array<double>"
    ends.groupBy(*KEYS).applyInPandas(close, schema).write.parquet(f"{place}/closed-{b}")
    closed = spark.read.parquet(f"{place}/closed-{b}")
    closed.filter("part >= 0").select(*KEYS, "block", "part", "rows").write.parquet(f"{place}/table-{b}")
    closed.filter("part = -1").select(*KEYS, "edge").write.parquet(f"{place}/edge-{b}")
    masses = closed.filter("part = -1").select(*KEYS, "block", "mass")
    if reached:
        masses = masses.unionByName(spark.read.parquet(f"{place}/reach-{b}").filter("part = -1").select(*KEYS, "block", "mass"))
    masses.write.parquet(f"{place}/mass-{b}-all")


def _way_back(spark: SparkSession, facts: DataFrame, size: int, place: str, names: str) -> DataFrame:
    """Segments from the last one to the first, the starts of one block of ends read at a time."""
    at = checkpoint(facts.select(*KEYS, F.col("wanted").alias("k"), F.col("steps").alias("end")))
    found = []
    b = facts.agg(F.max("last")).first()[0]
    while b >= 0:
        here = at.filter(F.floor((F.col("end") - 1) / size) == b)
        origin = spark.read.parquet(f"{place}/closed-{b}").filter("part >= 0").select(*KEYS, "part", "origin")

        met = here.join(origin, list(KEYS)).join(facts.select(*KEYS, "steps"), list(KEYS))
        cuts = checkpoint(met.groupBy(*KEYS).applyInPandas(_follower(b, size), f"{names}, start long, end long, k long"))
        found.append(cuts)
        low = cuts.groupBy(*KEYS).agg(F.min("start").alias("_start"), F.min("k").alias("_k"))
        moved = at.join(low, list(KEYS), "left")
        at = checkpoint(moved.select(*KEYS, F.coalesce("_k", "k").alias("k"), F.coalesce("_start", "end").alias("end")))
        b -= 1
    return reduce(DataFrame.unionByName, found).select(*KEYS, "start", "end")


def _follower(b: int, size: int):
    """The segments that end in block ``b``, from the last one back."""

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        k, end = int(group["k"].iloc[0]), int(group["end"].iloc[0])
        width = min(size, int(group["steps"].iloc[0]) - b * size)
        rows = np.concatenate([np.frombuffer(o, "<i4") for o in group["origin"]]).reshape(-1, width)
        out = []
        while k > 0 and end > b * size:
            start = int(rows[k, end - 1 - b * size])
            out.append((*[group[c].iloc[0] for c in KEYS], start, end - 1, k - 1))
            k, end = k - 1, start
        return pd.DataFrame(out, columns=[*KEYS, "start", "end", "k"])

    return follow
