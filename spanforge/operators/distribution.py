"""How well a subset represents the full data.

All tests start from per-value counts of both sides, so ordered steps run over distinct
values and not over rows; those steps are cut into slabs when even they are many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.operators.ordered import Oversize, find_oversize, next_value, running_sum
from spanforge.session import checkpoint

# Least expected count of a merged bin, guard inside the logarithm, number of known categories.
MIN_EXPECTED = 5.0
LOG_GUARD = 1e-12
KNOWN_CATEGORIES = 200
# Fixed value: values of a side up to which the p-value of the two-sample test is exact.
EXACT_UP_TO = 10_000


def value_counts(df: DataFrame, value: str, in_subset: str = "in_subset") -> DataFrame:
    """Rows per value on the full side and on the subset side."""
    return df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n_full"), F.sum(F.col(in_subset).cast("long")).alias("n_sub")
    )


def _curves(df: DataFrame, value: str) -> tuple[DataFrame, Oversize]:
    """Both distribution functions at every value; the rows are read once, for the value counts."""
    counts = checkpoint(value_counts(df, value))
    over = find_oversize(counts, [])
    sizes = counts.agg(F.struct(F.sum("n_full").alias("f"), F.sum("n_sub").alias("s"))).scalar()
    cum = running_sum(counts, [], [F.col("v")], {"c_full": F.col("n_full"), "c_sub": F.col("n_sub")}, over)
    share = lambda c, n: F.try_divide(F.col(c).cast("double"), F.col(n).cast("double"))
    cum = cum.withColumn("_n", sizes).withColumns({"_nf": F.col("_n.f"), "_ns": F.col("_n.s")}).drop("_n")
    return cum.withColumn("gap", F.abs(share("c_full", "_nf") - share("c_sub", "_ns"))), over


def kolmogorov_tail(x: Column, terms: int = 100) -> Column:
    """2 * sum of (-1)^(k-1) exp(-2 k^2 x^2), within 0..1."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k.cast("double") * k.cast("double") * x * x),
    )
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * total)))


def path_tail(statistic: float, n: int, m: int) -> float:
    """P(D >= statistic) of two samples without a difference, exactly: the share of lattice paths that leave the band.

    A path to (i, j) is a mixed order of i values of one side and j of the other, all equally likely; its last step came from
    (i - 1, j) with probability i / (i + j). Points on which the distribution functions differ by the statistic or more are left with
    certainty, so one pass over the anti-diagonals adds up positive shares only; two of them are kept.
    """
    least = round(statistic * n * m)
    i = np.arange(n + 1)
    left = np.zeros(n + 1)
    left[0] = 1.0 if least <= 0 else 0.0
    for s in range(1, n + m + 1):
        low, high = max(0, s - m), min(s, n)
        own = i[low : high + 1]
        stay = left[low : high + 1] * (s - own)
        step = np.zeros(len(own))
        step[own > 0] = left[own[own > 0] - 1] * own[own > 0]
        now = (stay + step) / s
        now[np.abs(own * m - (s - own) * n) >= least] = 1.0
        left[low : high + 1] = now
    return float(left[n])


def exact_tail(statistic: Column, n: Column, m: Column) -> Column:
    def tails(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if pd.isna(d) or not a or not b else path_tail(d, int(a), int(b)) for d, a, b in zip(*batch, strict=True)], dtype="float64")

    return F.pandas_udf(tails, "double")(statistic, n, m)


def ks_two_sample(df: DataFrame, value: str, exact_up_to: int = EXACT_UP_TO) -> DataFrame:
    """Largest distance of the two distribution functions, with its p-value.

    The p-value is exact while both sides have at most ``exact_up_to`` values, and asymptotic beyond.
    """
    found = _curves(df, value)[0].agg(
        F.max("gap").alias("statistic"), F.max("_nf").alias("n_full"), F.max("_ns").alias("n_sub")
    )
    size = F.col("n_full").cast("double") * F.col("n_sub") / (F.col("n_full") + F.col("n_sub"))
    small = F.greatest("n_full", "n_sub") <= exact_up_to
    some = lambda c: F.when(small, F.col(c))
    exact = exact_tail(some("statistic"), some("n_full"), some("n_sub"))
    return found.withColumn("p_value", F.when(small, exact).otherwise(kolmogorov_tail(F.sqrt(size) * F.col("statistic"))))


def wasserstein_1d(df: DataFrame, value: str) -> DataFrame:
    """Area between the distribution functions, and its share of the full mean."""
    curves, over = _curves(df, value)
    spaced = next_value(curves, [], "v", "_next", over)
    out = spaced.agg(
        F.coalesce(F.sum(F.col("gap") * (F.col("_next") - F.col("v"))), F.lit(0.0)).alias("distance"),
        (F.sum(F.col("v") * F.col("n_full")) / F.sum("n_full")).alias("_mean"),
    )
    relative = F.coalesce(F.try_divide(F.col("distance"), F.col("_mean")) * 100, F.lit(0.0))
    return out.select("distance", relative.alias("relative_error_pct"))


def bin_of(x: Column, width: float, n_bins: int) -> Column:
    """Bin of equal width counted in doubles as ``i * width``; the last edge belongs to the last bin."""
    guess = F.floor(x / F.lit(width)).cast("long")
    edge = lambda i: i.cast("double") * F.lit(width)
    exact = F.when(x < edge(guess), guess - 1).when(x >= edge(guess + 1), guess + 1).otherwise(guess)
    exact = F.when(x == edge(F.lit(n_bins)), F.lit(n_bins - 1).cast("long")).otherwise(exact)
    return F.when((exact >= 0) & (exact < n_bins), exact)


def histogram(df: DataFrame, value: str, width: float, n_bins: int) -> DataFrame:
    """Counts per bin for the full side and the subset, empty bins included."""
    binned = df.select(bin_of(F.col(value).cast("double"), width, n_bins).alias("bin"), "in_subset")
    counts = binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n_full"), F.sum(F.col("in_subset").cast("long")).alias("n_sub")
    )
    bins = df.sparkSession.range(n_bins).select(F.col("id").alias("bin"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return bins.join(counts, "bin", "left").select("bin", zero("n_full"), zero("n_sub"))


def _chi2_tail() -> object:
    def tail(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for stat, df in batches:
            yield pd.Series([_upper_gamma(d / 2.0, s / 2.0) for s, d in zip(stat, df, strict=True)])

    return F.pandas_udf(tail, "double")


def _upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma, by series below and continued fraction above a + 1.

    Both go on until they no longer change; their number of terms grows with the square root of a.
    """
    if not a > 0 or x != x:
        return float("nan")
    if x <= 0:
        return 1.0
    if x == float("inf"):
        return 0.0
    if a < 1e4:
        log_scale = a * math.log(x) - x - math.lgamma(a)
    else:  # the same without the difference of large numbers
        ahead = (x - a) / a
        log_scale = -a * (ahead - math.log1p(ahead)) + 0.5 * math.log(a / (2 * math.pi)) - 1 / (12 * a)
    scale = math.exp(log_scale) if log_scale > -745 else 0.0
    if x < a + 1:
        total, term, k = 1.0, 1.0, 0
        while term > 1e-17 * total:
            terms = term * np.cumprod(x / (a + np.arange(k + 1, k + 4097)))
            total, term, k = total + float(terms.sum()), float(terms[-1]), k + 4096
        return min(1.0, max(0.0, 1.0 - scale / a * total))
    # Lentz's form of the continued fraction.
    tiny = 1e-300
    base = x + 1 - a
    c, d = 1 / tiny, 1 / base
    value, i, change = d, 0, 0.0
    while abs(change - 1) > 1e-15:
        i += 1
        base += 2
        step = i * (a - i)
        d, c = step * d + base, base + step / c
        d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
        change = c * d
        value *= change
    return min(1.0, max(0.0, scale * value))


def chi2_binned(df: DataFrame, value: str, width: float, n_bins: int) -> DataFrame:
    """Chi-squared of the subset's histogram against the full one.

    Neighbouring bins are merged from the left until 5 are expected; the remainder joins
    the last merged bin. The fold runs over the bins (tens), not the data.
    """
    sizes = df.agg(F.count(value).alias("f"), F.sum(F.when(F.col(value).isNotNull(), F.col("in_subset").cast("long"))).alias("s"))
    scale = sizes.select(F.try_divide(F.col("s").cast("double"), F.col("f"))).scalar()
    bins = histogram(df, value, width, n_bins).agg(
        F.sort_array(F.collect_list(F.struct("bin", "n_sub", "n_full"))).alias("b")
    )
    one = bins.withColumn("_k", scale).withColumn(
        "b", F.transform("b", lambda x: F.struct(x["n_sub"].cast("double").alias("o"), (x["n_full"] * F.col("_k")).alias("e")))
    )
    kind = "struct<o: double, e: double, done: array<struct<o: double, e: double>>>"
    start = F.struct(
        F.lit(0.0).alias("o"), F.lit(0.0).alias("e"), F.array().cast("array<struct<o: double, e: double>>").alias("done")
    ).cast(kind)

    def merge(acc: Column, x: Column) -> Column:
        o, e = acc["o"] + x["o"], acc["e"] + x["e"]
        full = F.struct(
            F.lit(0.0).alias("o"),
            F.lit(0.0).alias("e"),
            F.concat(acc["done"], F.array(F.struct(o.alias("o"), e.alias("e")))).alias("done"),
        )
        return F.when(e >= MIN_EXPECTED, full).otherwise(F.struct(o.alias("o"), e.alias("e"), acc["done"].alias("done")))

    folded = one.select(F.aggregate("b", start, merge).alias("a"))
    left = F.col("a.e") > 0
    some = F.size("a.done") > 0
    tail = F.array(F.struct(F.col("a.o").alias("o"), F.col("a.e").alias("e")))
    last = F.element_at("a.done", -1)
    joined = F.concat(
        F.slice("a.done", F.lit(1), F.size("a.done") - 1),
        F.array(F.struct((last["o"] + F.col("a.o")).alias("o"), (last["e"] + F.col("a.e")).alias("e"))),
    )
    merged = F.when(left & some, joined).when(left, tail).otherwise(F.col("a.done"))
    total = lambda f: F.aggregate("m", F.lit(0.0), lambda acc, x: acc + x[f])
    out = folded.select(merged.alias("m")).withColumns({"_o": total("o"), "_e": total("e")})
    expect = lambda x: x["e"] * (F.col("_o") / F.col("_e"))
    stat = F.aggregate(
        "m", F.lit(0.0), lambda acc, x: acc + (x["o"] - expect(x)) * (x["o"] - expect(x)) / expect(x)
    )
    out = out.filter(F.size("m") > 1).select(stat.alias("chi2"), (F.size("m") - 1).cast("long").alias("df"))
    return out.withColumn("p_value", _chi2_tail()("chi2", "df"))


def category_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows per category on both sides."""
    return rows.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_full"), F.sum(F.col("in_subset").cast("long")).alias("n_sub")
    )


def category_coverage(counts: DataFrame, known: int = KNOWN_CATEGORIES) -> DataFrame:
    """Distinct categories on both sides and their share of the known ones."""
    out = counts.agg(
        F.count(F.lit(1)).alias("n_categories_full"), F.count_if(F.col("n_sub") > 0).alias("n_categories_subset")
    )
    return out.withColumns(
        {
            "coverage_full_pct": F.col("n_categories_full") / F.lit(float(known)) * 100,
            "coverage_pct": F.col("n_categories_subset") / F.lit(float(known)) * 100,
        }
    )


def top_categories(counts: DataFrame, k: int = 20, label: str = "label") -> DataFrame:
    """The k largest categories with their percentage on both sides."""
    totals = counts.agg(F.sum("n_full").alias("f"), F.sum("n_sub").alias("s"))
    share = lambda c, t: F.try_divide(F.col(c).cast("double"), totals.select(t).scalar()) * 100
    return (
        counts.withColumns({"full_pct": share("n_full", "f"), "sub_pct": share("n_sub", "s")})
        .orderBy(F.desc("n_full"), label)
        .limit(k)
    )


def category_divergence(counts: DataFrame) -> DataFrame:
    """Chi-squared over categories and Jensen-Shannon divergence (natural log)."""
    totals = counts.agg(F.sum("n_full").alias("f"), F.sum("n_sub").alias("s"))
    f, s = totals.select("f").scalar(), totals.select("s").scalar()
    expected = F.col("n_full").cast("double") / f * s
    p, q = F.col("n_sub").cast("double") / s, F.col("n_full").cast("double") / f
    m = (p + q) * 0.5
    guard = F.lit(LOG_GUARD)
    part = lambda x: x * F.ln(x / (m + guard) + guard)
    out = counts.agg(
        F.sum((F.col("n_sub") - expected) * (F.col("n_sub") - expected) / expected).alias("chi2"),
        (F.count(F.lit(1)) - 1).alias("df"),
        (F.sum(part(p)) * 0.5 + F.sum(part(q)) * 0.5).alias("jsd"),
    )
    return out.withColumn("p_value", _chi2_tail()("chi2", "df"))


def missing_members(counts: DataFrame, label: str = "label") -> DataFrame:
    """Categories of the full side that the subset lacks."""
    return counts.filter((F.col("n_full") > 0) & (F.col("n_sub") == 0)).select(label)
