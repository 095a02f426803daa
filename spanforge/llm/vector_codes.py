"""Vector codes by parts: nearest codebook entries through an integer Walsh-Hadamard transform, exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.joins import fits_broadcast

SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
# Vectors worked on at a time.
BLOCK = 8_192
# Copies of a label's total, so that a label of a third of all rows is met by several tasks.
SALTS = 32


@lru_cache(maxsize=8)
def sequency_order(width: int) -> np.ndarray:
    """The Hadamard matrix of a power of two with its rows in order of their sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < width:
        h = np.block([[h, h], [h, -h]])
    changes = (h[:, 1:] != h[:, :-1]).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


def transform(parts: np.ndarray) -> np.ndarray:
    """Coefficients of zero-padded rows in sequency order, coefficients first: (padded width, rows).

    Squared distances of coefficients are the padded width times those of the rows.
    """
    n, width = parts.shape
    padded = 1 << max(0, width - 1).bit_length()
    return sequency_order(padded)[:, :width].astype(parts.dtype) @ parts.T if width else np.zeros((1, n), parts.dtype)


def nearest_entries(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of each row's nearest entry, its squared distance, differences squared on the way).

    Scaled squared differences add up coefficient by coefficient, so every partial sum is a lower bound. After the first
    coefficients the entry ahead is measured in full; entries whose partial sum exceeds the least full sum known go, and
    only the pairs left go on. Ties take the lower index. Only integers are used; where 64 bits could overflow they are Python's.
    """
    n, width = parts.shape
    most = max(abs(int(parts.max(initial=0))), abs(int(parts.min(initial=0))), abs(int(entries.max(initial=0))), abs(int(entries.min(initial=0))))
    padded = 1 << max(0, width - 1).bit_length()
    exact = 4 * most * most * padded * padded * padded < 1 << 62
    if not exact:
        parts, entries = parts.astype(object), entries.astype(object)
    x, c = transform(parts), transform(entries)
    first = max(1, padded // 4)
    partial = np.zeros((n, len(entries)), x.dtype)
    for j in range(first):
        d = x[j][:, None] - c[j][None, :]
        partial += d * d
    ahead = partial.argmin(axis=1)
    rows = np.arange(n)
    bound = partial[rows, ahead]
    for j in range(first, padded):
        d = x[j] - c[j][ahead]
        bound = bound + d * d
    # Pairs (row, entry) that may still win; the one ahead is among them.
    row, entry = np.nonzero((partial <= bound[:, None]).astype(bool))
    acc, work = partial[row, entry], n * (len(entries) * first + padded - first)
    for j in range(first, padded):
        d = x[j][row] - c[j][entry]
        acc = acc + d * d
        work += len(row)
        stay = (acc <= bound[row]).astype(bool)
        if not stay.all():
            row, entry, acc = row[stay], entry[stay], acc[stay]
    # Rows rise and entries rise within a row; the least sum of a row, and of equal sums the first, is kept.
    least = np.full(n, None, object) if not exact else np.full(n, np.iinfo(np.int64).max)
    if exact:
        np.minimum.at(least, row, acc)
    else:
        for r, a in zip(row.tolist(), acc.tolist()):
            least[r] = a if least[r] is None else min(least[r], a)
    hit = np.flatnonzero((acc == least[row]).astype(bool))
    keep = np.unique(row[hit], return_index=True)[1]
    index = entry[hit][keep]
    return index, least // padded, work


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    x = F.col(vector)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(x.isNotNull() & fine, F.lit(False))


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """floor(SCALE * x) of each vector, padded by zeros to ``width``: (vectors, width)."""
    n = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    big = len(flat) and np.abs(flat).max() >= 2.0**62
    values = np.array([int(v) for v in flat], object) if big else flat.astype(np.int64)
    if len(values) == n * width and (lengths == width).all():
        return values.reshape(n, width)
    out = np.zeros((n, width), values.dtype)
    where = np.repeat(np.arange(n) * width - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(values))
    out.reshape(-1)[where] = values
    return out


def _assign(vectors: np.ndarray, books: list[np.ndarray], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, distances), both (vectors, parts)."""
    size = vectors.shape[1] // parts
    found = [nearest_entries(vectors[:, p * size : (p + 1) * size], books[p])[:2] for p in range(parts)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _one_round(vectors: DataFrame, books: list[np.ndarray], parts: int, width: int) -> list[np.ndarray]:
    """The codebooks after one assignment and update; tasks send sums of parts, one row per used entry."""
    size = width // parts
    sums = [f"s{k}" for k in range(size)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(b), size), object) for b in books]
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                block = _integers(batch.column(0).slice(start, BLOCK), width)
                codes, _ = _assign(block, books, parts)
                for p in range(parts):
                    own = block[:, p * size : (p + 1) * size]
                    order = np.argsort(codes[:, p], kind="stable")
                    kinds, first, n = np.unique(codes[order, p], return_index=True, return_counts=True)
                    safe = own.dtype != object and (not own.size or int(np.abs(own).max()) < 1 << 49)
                    added = np.add.reduceat(own[order] if safe else own[order].astype(object), first, axis=0) if size else np.zeros((len(kinds), 0))
                    total[p][kinds] += added.astype(object)
                    count[p][kinds] += n
        rows = [(p, e) for p in range(parts) for e in range(len(books[p])) if count[p][e]]
        # Sums of any size travel as two halves that 128-bit decimals hold for any number of tasks.
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([int(count[p][e]) for p, e in rows], pa.int64())]
        names = ["part", "entry", "n"]
        for k in range(size):
            values = [int(total[p][e][k]) for p, e in rows]
            columns += [pa.array([v >> 60 for v in values], pa.decimal128(38, 0)), pa.array([v & ((1 << 60) - 1) for v in values], pa.decimal128(38, 0))]
            names += [f"{sums[k]}_high", f"{sums[k]}_low"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    halves = [f"{s}_{h}" for s in sums for h in ("high", "low")]
    schema = "part int, entry int, n long" + "".join(f", {h} decimal(38,0)" for h in halves)
    merged = vectors.select("_vector").mapInArrow(work, schema).groupBy("part", "entry")
    new = [b.copy() for b in books]
    for r in merged.agg(F.sum("n").alias("n"), *[F.sum(h).alias(h) for h in halves]).collect():
        for k in range(size):
            new[r["part"]][r["entry"], k] = ((int(r[f"s{k}_high"]) << 60) + int(r[f"s{k}_low"])) // r["n"]
    return new


def _tight(books: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit codebooks wherever they fit."""
    return [b.astype(np.int64) if all(abs(int(v)) < 1 << 62 for v in b.reshape(-1)) else b for b in books]


def learn_codebooks(vectors: DataFrame, key: str, parts: int, entries: int, rounds: int, width: int) -> list[np.ndarray]:
    """Codebooks that start as the parts of the smallest keys and move to their parts' means, floored.

    Only ``entries`` vectors and one row per entry and round reach the driver.
    """
    first = vectors.orderBy(F.col(key).asc_nulls_last(), "_vector").limit(entries).select("_vector").collect()
    raw = _integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), width)
    size = width // parts
    books = [raw[:, p * size : (p + 1) * size].astype(object) for p in range(parts)]
    for _ in range(rounds):
        books = _one_round(vectors, _tight(books), parts, width)
        books = [b.astype(object) for b in books]
    return _tight(books)


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per usable vector: key, code, error, label_error, codebooks_sha256.

    Components become floor(4096 * x); vectors are cut into ``parts`` equal parts, each coded by its nearest codebook entry.
    Rows whose vector is null or holds a null or non-finite component are dropped. Vectors of different or indivisible
    length count as padded by zeros to the longest one, rounded up to a multiple of ``parts``; empty vectors have codes of
    zeros. Of equal keys the smaller vector comes first, null keys come last, and rows of equal keys stay apart. With fewer
    than ``entries`` vectors there are fewer entries. Equal labels, and null labels together, share a ``label_error``.
    An error beyond 64 bits is an error. An empty table gives no rows; other columns are ignored.
    """
    kept = vectors.filter(usable(vector))
    named = kept.select(F.col(key), F.col(label).alias("_label"), F.transform(vector, lambda v: v.cast("double")).alias("_vector"))
    longest = named.agg(F.max(F.size("_vector"))).first()[0]
    width = -(-(longest or 0) // parts) * parts
    books = learn_codebooks(named, key, parts, entries, rounds, width) if longest is not None else []
    listed = ",".join(str(int(v)) for b in books for v in b.reshape(-1))
    digest = hashlib.sha256(listed.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                codes, far = _assign(_integers(part.column(2), width), books, parts)
                code = ["".join(map("{:02x}".format, c)) for c in codes.tolist()]
                error = [sum(map(int, f)) for f in far.tolist()]
                arrays = [part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, "_label", "code", "error"])

    kinds = [named.schema[c].dataType.simpleString() for c in (key, "_label")]
    coded = named.mapInArrow(work, f"`{key}` {kinds[0]}, _label {kinds[1]}, code string, error long")
    totals = coded.groupBy("_label").agg(F.sum("error").alias("label_error")).withColumnRenamed("_label", "_of")
    if fits_broadcast(totals):
        joined = coded.join(F.broadcast(totals), F.col("_label").eqNullSafe(F.col("_of")))
    else:
        spread = coded.withColumn("_salt", F.pmod(F.xxhash64(key, "code"), F.lit(SALTS)))
        copies = totals.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = spread.join(copies, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_salt") == F.col("_copy")))
    return joined.select(key, "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def compress_sql(width: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same over ``embeddings`` with vectors of ``width`` components, for checks."""
    size = width // parts
    steps = [
        f"""kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"cut AS (SELECT vec_id, label, part, v[part * {size} + 1 : part * {size} + {size}] AS x FROM kept, range({parts}) r(part))",
        f"""book0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM cut
  QUALIFY entry < {entries})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""near{r} AS MATERIALIZED (SELECT vec_id, part, any_value(label) AS label, any_value(x) AS x, min(d) AS d, arg_min(entry, (d, entry)) AS entry
  FROM (SELECT vec_id, label, part, x, entry, list_sum(list_transform(range(1, {size + 1}), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d
    FROM cut JOIN book{r} USING (part)) GROUP BY vec_id, part)"""
        )
        if r < rounds:
            means = ", ".join(f"CAST(floor_div(sum(x[{i + 1}]), count(*)) AS BIGINT)" for i in range(size))
            steps.append(
                f"""mean{r} AS (SELECT part, entry, [{means}] AS c FROM near{r} GROUP BY part, entry),
book{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (part, entry))"""
            )
    # Integer division that goes down, of a 128-bit sum by a count.
    for k, s in enumerate(steps):
        while "floor_div(" in s:
            a = s.index("floor_div(")
            i, depth = a + 10, 1
            while depth:
                depth += {"(": 1, ")": -1}.get(s[i], 0)
                i += 1
            num, den = s[a + 10 : i - 1].split(", ")
            s = s[:a] + f"({num} - ((({num}) % {den}) + {den}) % {den}) // {den}" + s[i:]
        steps[k] = s
    steps.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM book{rounds})")
    steps.append(
        f"""coded AS (SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id)"""
    )
    return (
        "WITH "
        + ",\n".join(steps)
        + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest"
    )
