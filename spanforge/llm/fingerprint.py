"""Document fingerprints: bottom-k sketches of word-shingle hashes, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.shared import text_or_empty

K = 128
WORDS = 5
# Documents that follow each other are compared inside slabs of about this many; the number of slabs is
# bounded because their borders are part of the plan.
SLAB_ROWS = 1_000
MAX_SLABS = 16_384
FAN = 128


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """array<long>: distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run.

    Words are what white space separates, A-Z lower-cased by the lower-case function. A text without words has none.
    """
    split = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def runs(ws: Column) -> Column:
        n = F.size(ws)
        at = F.sequence(F.lit(1), F.greatest(n - (words - 1), F.lit(1)))
        # Absent words of a short text hash as nulls.
        one = lambda i: F.xxhash64(*[F.try_element_at(ws, i + j) for j in range(words)])
        return F.when(n > 0, F.array_distinct(F.transform(at, one))).otherwise(F.array().cast("array<bigint>"))

    # The array of words is computed once, as the only element of the outer transform.
    return F.transform(F.array(split), runs)[0]


def bottom_k(hashes: Column, k: int = K) -> Column:
    """The k smallest hashes, ascending: the sketch."""
    return F.slice(F.sort_array(hashes), 1, k)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    return bottom_k(shingle_hashes(text, words), k)


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return bottom_k(F.array_union(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all, 0 to 1: exact while both sketches hold every shingle.

    Two empty sketches are alike (1), an empty and another one are not (0).
    """

    def estimate(u: Column) -> Column:
        common = F.size(F.array_intersect(F.array_intersect(u, a), b))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(common / F.size(u))

    return F.transform(F.array(union_sketch(a, b, k)), estimate)[0]


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else from the k-th smallest hash."""
    share = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    r, u = resemblance(a, b, k), distinct_shingles(union_sketch(a, b, k), k)
    own = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * u / own))


def merge_sketches(parts: DataFrame, keys: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per key from those of its parts; null and empty sketches add nothing.

    Hashes are rows here: they are made distinct, and every task keeps k of a key before the shuffle.
    """
    rows = parts.select(*keys, F.explode(name).alias("_h")).distinct()
    first = Window.partitionBy(*keys).orderBy("_h")
    kept = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(name))


def as_text(s: Column) -> Column:
    """The sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def slab_borders(rows: DataFrame, key: str, slab_rows: int = SLAB_ROWS) -> list:
    """Values of ``key`` at which slabs of about ``slab_rows`` rows begin; at most ``MAX_SLABS`` of them."""
    n, low = rows.agg(F.count(key), F.min(key)).first()
    slabs = min(MAX_SLABS, n // slab_rows)
    if slabs < 2:
        return [low] if low is not None else []
    cuts = [i / slabs for i in range(1, slabs)]
    found = rows.agg(F.percentile_approx(key, cuts, 10 * slabs)).first()[0]
    return sorted({low, *found})


def slab_of(key: Column, borders: list) -> Column:
    """Number of the slab that holds ``key``: two steps of at most ``FAN`` comparisons; nulls are in the first."""
    groups = [borders[i : i + FAN] for i in range(0, len(borders), FAN)]
    at = lambda array, x: F.greatest(F.size(F.filter(array, lambda b: b <= x)), F.lit(1))
    firsts = F.lit([g[0] for g in groups])
    inner = F.array(*[F.lit(g) for g in groups])
    coarse = F.when(key.isNull(), F.lit(1)).otherwise(at(firsts, key))
    return F.transform(F.array(coarse), lambda c: (c - 1) * FAN + at(F.element_at(inner, c), F.coalesce(key, F.lit(borders[0]))))[0]


def with_next(
    docs: DataFrame, key: str, values: dict[str, str], slab_rows: int = SLAB_ROWS, made: dict[str, Column] | None = None
) -> DataFrame:
    """Add to each row values of the row with the next larger ``key`` (after the last: the first).

    ``values`` maps column to added name; ``made`` adds columns once the rows have moved. Rows move once, to the slab of their key; the first row of every slab
    also goes to the slab before, so no slab needs another one. Equal keys follow each other by the first
    value; null keys come first.
    """
    borders = slab_borders(docs.select(key), key, slab_rows)
    if not borders:
        docs = docs.withColumns(made or {})
        return docs.withColumns({b: F.lit(None).cast(docs.schema[a].dataType) for a, b in values.items()})
    slabs = len(borders)
    first = next(iter(values))
    home = docs.withColumn("_slab", slab_of(F.col(key), borders)).withColumn("_late", F.lit(0))
    # The row that begins slab s is also the last of slab s - 1, and that of the first slab the last of all.
    before = F.when(F.col("_slab") == 1, F.lit(slabs)).otherwise(F.col("_slab") - 1)
    start = F.element_at(F.lit(borders), F.col("_slab")) == F.col(key)
    places = F.when(
        start | F.col(key).isNull(),
        F.array(F.struct(F.col("_slab").alias("s"), F.lit(0).alias("late")), F.struct(before.alias("s"), F.lit(1).alias("late"))),
    ).otherwise(F.array(F.struct(F.col("_slab").alias("s"), F.lit(0).alias("late"))))
    dealt = home.withColumn("_p", F.explode(places)).withColumns({"_slab": F.col("_p.s"), "_late": F.col("_p.late")})
    w = Window.partitionBy("_slab").orderBy("_late", F.col(key).asc_nulls_first(), first)
    dealt = dealt.drop("_p").repartition("_slab").withColumns(made or {})
    out = dealt.withColumns({b: F.lead(a).over(w) for a, b in values.items()})
    return out.filter(F.col("_late") == 0).drop("_slab", "_late")


def fingerprint_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, words: int = WORDS, slab_rows: int = SLAB_ROWS
) -> DataFrame:
    """key, n_chars, sketch, edited text and its sketch, next document's sketch, for every document.

    The edited text replaces the last quarter of the code points by the first as many (or all) of the next document.
    Null and empty texts have an empty sketch. Repeated rows are rows of their own; equal keys follow by
    text, null keys come first; one row is its own next. An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(key), text_or_empty(text).alias("_text"))
    made = {"sketch": sketch(F.col("_text"), k, words)}
    pairs = with_next(base, key, {"_text": "_next", "sketch": "next_sketch"}, slab_rows, made)
    n = F.char_length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - quarter), F.substring("_next", F.lit(1), quarter))
    out = pairs.select(key, n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    return out.withColumn("edited_sketch", sketch(F.col("edited"), k, words))
