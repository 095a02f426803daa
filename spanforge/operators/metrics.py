"""Set, ranking and text-overlap metrics over prediction and truth tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.aggregates import macro_avg, ratio
from spanforge.operators.joins import chain_join, overlap_join
from spanforge.operators.ordered import KEYS, Oversize, running_sum, with_position


# ---- sets ------------------------------------------------------------------

def set_overlap(units: DataFrame, pred: DataFrame, truth: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Sizes of both sets, their intersection and union; units without rows count as empty.

    Both sides are made distinct in one grouping on (unit, item), so a large unit spreads
    over tasks before its counts meet.
    """
    keys = list(keys)
    tagged = pred.select(*keys, item, F.lit(1).alias("_p"), F.lit(0).alias("_g")).unionByName(
        truth.select(*keys, item, F.lit(0).alias("_p"), F.lit(1).alias("_g"))
    )
    members = tagged.groupBy(*keys, item).agg(F.max("_p").alias("_p"), F.max("_g").alias("_g"))
    counts = members.groupBy(*keys).agg(
        F.sum("_p").alias("n_pred"),
        F.sum("_g").alias("n_gt"),
        F.sum(F.col("_p") * F.col("_g")).alias("n_inter"),
        F.count(F.lit(1)).alias("n_union"),
    )
    joined = units.select(*keys).join(counts, keys, "left")
    return joined.withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_pred", "n_gt", "n_inter", "n_union")}
    )


def set_metrics(units: DataFrame, pred: DataFrame, truth: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    """Precision, recall, F1, IoU (1 when both are empty) and hit per unit."""
    out = set_overlap(units, pred, truth, keys, item)
    out = out.withColumns({"p": ratio("n_inter", "n_pred"), "r": ratio("n_inter", "n_gt")})
    return out.withColumns(
        {
            "f1": ratio(F.col("p") * F.col("r") * 2, F.col("p") + F.col("r")),
            "iou": ratio("n_inter", "n_union", 1.0),
            "hit": (F.col("n_inter") > 0).cast("int"),
        }
    )


def set_f1(units: DataFrame, pred: DataFrame, truth: DataFrame, keys: Sequence[str], item: str) -> DataFrame:
    out = set_metrics(units, pred, truth, keys, item)
    return out.select(*keys, F.col("p").alias("precision"), F.col("r").alias("recall"), "f1")


# ---- rankings --------------------------------------------------------------

def _sign_sum(xs: Column, ys: Column) -> Column:
    """Sum over all ordered pairs of sign(dx) * sign(dy)."""
    rows = F.arrays_zip(xs.alias("x"), ys.alias("y"))
    return F.aggregate(
        rows,
        F.lit(0.0),
        lambda acc, a: acc
        + F.aggregate(rows, F.lit(0.0), lambda s, b: s + F.signum(a["x"] - b["x"]) * F.signum(a["y"] - b["y"])),
    )


def kendall_tau_b(xs: Column, ys: Column, x: Column, y: Column) -> Column:
    """Tau-b of two short arrays, given their own :func:`_sign_sum`; NULL when one of them is constant."""
    return F.when((x > 0) & (y > 0), _sign_sum(xs, ys) / F.sqrt(x * y))


def mean_ranks(xs: Column) -> Column:
    """Ranks 1..n, ties sharing their mean."""
    return F.transform(
        xs,
        lambda a: F.size(F.filter(xs, lambda b: b < a)) + (F.size(F.filter(xs, lambda b: b == a)) + 1) / F.lit(2.0),
    )


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _dot(a: Column, ma: Column, b: Column, mb: Column) -> Column:
    return _total(F.zip_with(a, b, lambda u, v: (u - ma) * (v - mb)))


def with_pearson(rows: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """Add the correlation of two short arrays, NULL when one is constant; means and variances are columns, so they are made once."""
    n = F.size(x)
    d = rows.withColumns({"_mx": _total(F.col(x)) / n, "_my": _total(F.col(y)) / n})
    mx, my = F.col("_mx"), F.col("_my")
    d = d.withColumns({"_vx": _dot(F.col(x), mx, F.col(x), mx), "_vy": _dot(F.col(y), my, F.col(y), my)})
    vx, vy = F.col("_vx"), F.col("_vy")
    rho = F.when((vx > 0) & (vy > 0), _dot(F.col(x), mx, F.col(y), my) / F.sqrt(vx * vy))
    return d.withColumn(name, rho).drop("_mx", "_my", "_vx", "_vy")


def ranking_metrics(rows: DataFrame, top: int = 3) -> DataFrame:
    """Spearman, tau-b and top-k precision of one ranking per row.

    ``ranking`` lists labels 1..n from best to worst, ``scores`` the true score by label. Rows come
    from sampled tasks, so the arrays are short. Columns are NULL where undefined.
    """
    n = F.size("scores")
    d = rows.withColumn(
        "_pred",
        F.transform("scores", lambda s, i: -F.array_position(F.col("ranking"), (i + 1).cast("long")).cast("double")),
    )
    d = d.withColumns({"_rp": mean_ranks(F.col("_pred")), "_rg": mean_ranks(F.col("scores"))})
    # Sums that tau names twice are columns, so they are made once.
    d = d.withColumns({"_x": _sign_sum(F.col("_pred"), F.col("_pred")), "_y": _sign_sum(F.col("scores"), F.col("scores"))})
    d = with_pearson(d, "_rp", "_rg", "_rho")
    tau = kendall_tau_b(F.col("_pred"), F.col("scores"), F.col("_x"), F.col("_y"))
    k = F.least(F.lit(top), n)
    by_score = F.sort_array(F.transform("scores", lambda s, i: F.struct((-s).alias("s"), (i + 1).cast("long").alias("l"))))
    best = F.transform(F.slice(by_score, F.lit(1), k), lambda x: x["l"])
    hits = F.size(F.array_intersect(F.slice("ranking", F.lit(1), k), best))
    valid = F.col("ranking").isNotNull() & (n > 0)
    return d.withColumns(
        {
            "spearman_r": F.when(valid, F.col("_rho")),
            "kendall_tau": F.when(valid, tau),
            "top_k": F.when(valid, k.cast("long")),
            "top_k_precision": F.when(valid, hits / k),
        }
    ).drop("_pred", "_rp", "_rg", "_x", "_y", "_rho")


def selection_rank_corr(
    items: DataFrame, keys: Sequence[str] = KEYS, over: Oversize | None = None
) -> DataFrame:
    """Spearman and tau-b between a 0/1 ``selected`` column and ``score`` over all items of a group.

    One side has two values only, so both follow from counts per distinct score and their
    running sums; no pair of items is formed and groups may have any size.
    """
    keys = list(keys)
    values = items.groupBy(*keys, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("selected").cast("long")).alias("s")
    )
    cum = running_sum(values, keys, [F.col("score")], {"to_n": F.col("n"), "to_s": F.col("s")}, over)
    totals = values.groupBy(*keys).agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    d = cum.join(totals, keys)
    n, s = F.col("n").cast("double"), F.col("s").cast("double")
    mid = (F.col("all_n") + 1) / 2
    rank = (F.col("to_n") - F.col("n")) + (n + 1) / 2
    below = (F.col("to_n") - F.col("n")) - (F.col("to_s") - F.col("s"))
    above = (F.col("all_n") - F.col("all_s")) - (F.col("to_n") - F.col("to_s"))
    sums = d.groupBy(*keys).agg(
        F.max("all_n").cast("double").alias("all_n"),
        F.max("all_s").cast("double").alias("all_s"),
        F.sum(s * (rank - mid)).alias("_cov"),
        F.sum(n * (rank - mid) * (rank - mid)).alias("_var"),
        F.sum(s * (below - above)).alias("_c"),
        F.sum(n * (n - 1) / 2).alias("_ties"),
    )
    size, k = F.col("all_n"), F.col("all_s")
    var = k * (1 - k / size) * F.col("_var")
    pairs = k * (size - k) * (size * (size - 1) / 2 - F.col("_ties"))
    return sums.select(
        *keys,
        F.when(var > 0, F.col("_cov") / F.sqrt(var)).alias("spearman_rho"),
        F.when(pairs > 0, F.col("_c") / F.sqrt(pairs)).alias("kendall_tau"),
    )


def temporal_gt_scores(items: DataFrame, index: str = "orig_pos", keys: Sequence[str] = KEYS) -> DataFrame:
    """Score of a temporal task: earlier is higher, the last item scores 0."""
    last = items.groupBy(*keys).agg(F.max(index).alias("_last"))
    return items.join(last, list(keys)).withColumn("gt_score", (F.col("_last") - F.col(index)).cast("double")).drop("_last")


def rank_from_wins(wins: DataFrame, over: Oversize | None = None) -> DataFrame:
    """Every item by wins, earlier item first on ties; the first has rank 1."""
    placed = with_position(wins, KEYS, [F.desc("wins"), F.col("orig_pos")], "rank", over)
    return placed.withColumn("rank", F.col("rank") + 1)


# ---- alignment chains ------------------------------------------------------

def chain_metrics(
    summaries: DataFrame, documents: DataFrame, sentence_docs: DataFrame, doc_clips: DataFrame
) -> dict[str, DataFrame]:
    """Per-sentence metrics of both steps and of the oracle that starts from true documents.

    ``sentence_docs``: predicted documents per sentence; ``doc_clips``: predicted clips per document.
    """
    unit = [*KEYS, "sentence_id"]
    units = summaries.select(*unit)
    gt_docs = overlap_join(summaries, documents).filter(F.col("doc_id").isNotNull())
    gt_clips = summaries.select(*unit, F.explode("shot_ids").alias("clip_id"))
    return {
        "step1": set_metrics(units, sentence_docs, gt_docs, unit, "doc_id"),
        "final": set_metrics(units, chain_join(sentence_docs, doc_clips), gt_clips, unit, "clip_id"),
        "oracle": set_metrics(units, chain_join(gt_docs, doc_clips), gt_clips, unit, "clip_id"),
    }


def chain_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """Sentence, then video, then dataset averages of every part."""
    metrics = ["p", "r", "f1", "iou", "hit"]
    rows = None
    for name, part in parts.items():
        one = macro_avg(part, metrics, ["dataset"]).withColumn("part", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows


# ---- text overlap ----------------------------------------------------------

def overlap_tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def plain_tokens(c: Column) -> Column:
    """Lower-cased words between white space."""
    from spanforge.functions import text

    return text.words(F.lower(c))


# Tokens of both sides whose grams are counted at once; one longer pair is counted alone.
TOKENS = 1 << 18


def _token_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose last two columns hold a bounded number of tokens."""
    sizes = sum(np.nan_to_num(batch.column(i).value_lengths().to_numpy(zero_copy_only=False).astype(float)) for i in (-2, -1))
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + TOKENS, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _codes(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, number of the token) of all tokens of each side; equal tokens have equal numbers."""
    sides = [batch.column(-2), batch.column(-1)]
    flat = pa.concat_arrays([s.flatten() for s in sides])
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = [pc.list_parent_indices(s).to_numpy(zero_copy_only=False).astype(np.int64) for s in sides]
    return [(rows[0], codes[: len(rows[0])]), (rows[1], codes[len(rows[0]) :])]


def count_overlaps(batch: pa.RecordBatch, orders: Sequence[int]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the clipped overlap and the numbers of grams of both sides, row by row.

    A gram of order n is a pair of a gram of order n - 1 and a token, numbered anew; grams of a row are counted as sorted
    numbers, and equal numbers of both sides meet by binary search.
    """
    n_rows, sides = batch.num_rows, _codes(batch)
    grams = [(rows, codes) for rows, codes in sides]
    out = {}
    for n in range(1, max(orders) + 1):
        if n > 1:
            width = 1 + max((int(codes.max()) for _, codes in sides if len(codes)), default=0)
            # The token that follows stands n - 1 places on, in the same row.
            made = []
            for (rows, codes), (own, ids) in zip(sides, grams, strict=True):
                same = rows[n - 1 :] == own[: len(rows) - n + 1] if len(rows) >= n else np.zeros(0, bool)
                pairs = np.full(len(rows), -1, np.int64)
                at = np.flatnonzero(same)
                at = at[ids[at] >= 0]
                pairs[at] = ids[at] * width + codes[at + n - 1]
                made.append(pairs)
            both = np.concatenate(made)
            kinds, numbers = np.unique(both, return_inverse=True)
            if len(kinds) and kinds[0] == -1:
                numbers = numbers - 1
            grams = [(sides[0][0], numbers[: len(made[0])]), (sides[1][0], numbers[len(made[0]) :])]
        if n not in orders:
            continue
        span = 1 + max((int(ids.max()) for _, ids in grams if len(ids)), default=0)
        counted = []
        for rows, ids in grams:
            fine = ids >= 0
            keys, counts = np.unique(rows[fine] * max(1, span) + ids[fine], return_counts=True)
            counted.append((keys, counts, np.bincount(rows[fine], minlength=n_rows)))
        (keys, counts, n_cand), (others, their, n_ref) = counted
        at = np.searchsorted(others, keys)
        hit = np.flatnonzero(at < len(others))
        hit = hit[others[at[hit]] == keys[hit]]
        shared = np.minimum(counts[hit], their[at[hit]])
        overlap = np.bincount(keys[hit] // max(1, span), weights=shared, minlength=n_rows).astype(np.int64)
        out[n] = (overlap, n_cand, n_ref)
    return out


def _with_tokens(pairs: DataFrame, keys: Sequence[str], tokens) -> DataFrame:
    return pairs.select(*keys, *[tokens(F.coalesce(c, F.lit(""))).alias(f"_{c}") for c in ("candidate", "reference")])


def gram_overlap(pairs: DataFrame, keys: Sequence[str], orders: Sequence[int], tokens=overlap_tokens) -> DataFrame:
    """keys, overlaps: for every row of ``candidate`` and ``reference`` the clipped n-gram overlap of each order, as an array.

    Nothing is shuffled: both texts lie in one row, and Arrow batches of rows are counted at once.
    """
    keys = list(keys)
    split = _with_tokens(pairs, keys, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _token_slices(whole):
                found = count_overlaps(batch, orders)
                fields = [pa.array(np.repeat([list(orders)], batch.num_rows, axis=0).reshape(-1), pa.int32())]
                fields += [pa.array(np.stack([found[n][i] for n in orders], axis=1).reshape(-1).astype(np.int64)) for i in range(3)]
                rows = pa.StructArray.from_arrays(fields, names=["n", "overlap", "n_cand", "n_ref"])
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(orders))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.ListArray.from_arrays(offsets, rows)], names=[*keys, "overlaps"])

    kinds = ", ".join(f"`{k}` {split.schema[k].dataType.simpleString()}" for k in keys)
    return split.mapInArrow(run, f"{kinds}, overlaps array<struct<n: int, overlap: long, n_cand: long, n_ref: long>>")


def rouge_n(pairs: DataFrame, keys: Sequence[str], orders: Sequence[int] = (1, 2)) -> DataFrame:
    """n-gram precision, recall and F1; units without any gram of an order get zeros."""
    d = gram_overlap(pairs, keys, orders).select(*keys, F.explode("overlaps").alias("_x")).select(*keys, "_x.*")
    d = d.withColumns({"precision": ratio("overlap", "n_cand"), "recall": ratio("overlap", "n_ref")})
    f1 = ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    return d.select(*keys, "n", "precision", "recall", f1.alias("f1"))


def lcs_length(a: Sequence, b: Sequence) -> int:
    """Longest common subsequence with one bit per token of the shorter text; tokens that it lacks cost nothing."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        mask = places.get(token)
        if mask is not None:
            hit = row & mask
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def rouge_l(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Longest-common-subsequence precision, recall and F1 over whole texts.

    Tokens travel as Arrow lists and become numbers a batch at a time; only tokens that both texts of a row hold are walked through.
    """
    keys = list(keys)
    split = _with_tokens(pairs, keys, overlap_tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _token_slices(whole):
                (c_rows, c), (r_rows, r) = _codes(batch)
                # Tokens of a row that the other side of the row lacks are in no common subsequence.
                span = 1 + max(int(c.max(initial=0)), int(r.max(initial=0)))
                c_key, r_key = c_rows * span + c, r_rows * span + r
                c_fine, r_fine = np.isin(c_key, r_key), np.isin(r_key, c_key)
                cuts = [np.searchsorted(rows[fine], np.arange(batch.num_rows + 1)).tolist() for rows, fine in ((c_rows, c_fine), (r_rows, r_fine))]
                own, other = c[c_fine].tolist(), r[r_fine].tolist()
                lcs = [lcs_length(own[cuts[0][i] : cuts[0][i + 1]], other[cuts[1][i] : cuts[1][i + 1]]) for i in range(batch.num_rows)]
                sizes = [pa.array(np.bincount(rows, minlength=batch.num_rows).astype(np.int64)) for rows in (c_rows, r_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(lcs, pa.int64()), *sizes], names=[*keys, "lcs", "_c", "_r"])

    kinds = ", ".join(f"`{k}` {split.schema[k].dataType.simpleString()}" for k in keys)
    d = split.mapInArrow(run, f"{kinds}, lcs long, _c long, _r long")
    d = d.withColumns({"precision": ratio("lcs", "_c"), "recall": ratio("lcs", "_r")})
    f1 = ratio(F.col("precision") * F.col("recall") * 2, F.col("precision") + F.col("recall"))
    return d.select(*keys, "lcs", "precision", "recall", f1.alias("f1"))


def bleu4(pairs: DataFrame, keys: Sequence[str], epsilon: float = 0.0) -> DataFrame:
    """Geometric mean of clipped 1..4-gram precision times the brevity penalty.

    Without any common gram of an order the score is 0; ``epsilon`` replaces zero counts instead.
    """
    d = gram_overlap(pairs, keys, (1, 2, 3, 4), plain_tokens)

    def log_p(x: Column) -> Column:
        hit = F.when(x["overlap"] > 0, x["overlap"].cast("double")).otherwise(F.lit(float(epsilon)))
        return F.when((hit > 0) & (x["n_cand"] > 0), F.ln(hit / x["n_cand"]))

    logs = F.transform("overlaps", log_p)
    first = F.col("overlaps")[0]
    penalty = F.when(first["n_cand"] > first["n_ref"], 1.0).otherwise(F.exp(1.0 - first["n_ref"] / first["n_cand"]))
    total = F.aggregate("_l", F.lit(0.0), lambda a, x: a + x)
    score = F.when((F.size("_l") == 4) & F.forall("_l", lambda x: x.isNotNull()), penalty * F.exp(total / 4)).otherwise(0.0)
    return d.withColumn("_l", logs).select(*keys, F.coalesce(score, F.lit(0.0)).alias("bleu4"))


# ---- vectors ---------------------------------------------------------------

def _mean_direction(vectors: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("feature", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = F.transform("feature", lambda v: v.cast("double") / F.col("_norm"))
    d = vectors.withColumn("_norm", norm).filter(F.col("_norm") > 0)
    mean = Summarizer.mean(array_to_vector(unit))
    return d.groupBy(*keys).agg(mean.alias("_m")).select(*keys, vector_to_array("_m").alias(name))


def embedding_match(sentences: DataFrame, frames: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean cosine over all sentence-frame pairs of a group.

    The mean over pairs equals the product of the two mean directions, so each side is
    averaged by itself and no pair is formed.
    """
    a = _mean_direction(sentences, keys, "_a")
    b = _mean_direction(frames, keys, "_b")
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, list(keys)).select(*keys, dot.alias("score"))


# ---- runs ------------------------------------------------------------------

def input_quality(frames: DataFrame) -> DataFrame:
    """What the submitted frames keep of a video.

    ``frames``: every step with 0/1 ``submitted``, 0/1 ``gtframe``, ``gtscore`` and ``shot_idx``. Shots are counted
    after grouping on (video, shot), which also pre-aggregates the frames.
    """
    sent = F.col("submitted") == 1
    shot = frames.groupBy(*KEYS, "shot_idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sent).alias("k"),
        F.sum("gtframe").alias("g"),
        F.sum(F.col("gtframe") * F.col("submitted")).alias("gk"),
        F.sum("gtscore").alias("s"),
        F.sum(F.when(sent, F.col("gtscore"))).alias("sk"),
    )
    per = shot.groupBy(*KEYS).agg(
        *[F.sum(c).alias(c) for c in ("n", "k", "g", "gk", "s", "sk")],
        F.count_if(F.col("k") > 0).alias("hit"),
        F.count(F.lit(1)).alias("shots"),
    )
    return per.select(
        *KEYS,
        ratio("k", "n").alias("coverage"),
        ratio("gk", "g", None).alias("gt_recall"),
        ratio(ratio("sk", "k", None), ratio("s", "n", None), None).alias("gtscore_ratio"),
        ratio("hit", "shots").alias("shot_coverage"),
    )


def spread(rows: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Minimum, maximum and mean of every metric."""
    return rows.groupBy(*by).agg(
        *[f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )


def compare_runs(
    results: DataFrame, metric: str, by: Sequence[str], modes: Sequence[str] = ("no_doc", "with_doc")
) -> DataFrame:
    """One row per setting with the mean of every mode and the gain of the last over the first."""
    wide = results.groupBy(*by).pivot("mode", list(modes)).agg(F.avg(metric))
    return wide.withColumn("delta", F.col(modes[-1]) - F.col(modes[0]))
