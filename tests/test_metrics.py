import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import distribution as dist
from spanforge.operators import metrics as mt
from spanforge.operators.aggregates import win_counts
from spanforge.streaming import arrivals

UNIT = "dataset string, video_id string"


def sets(spark, pred, gt):
    unit = spark.createDataFrame([("d", "v")], UNIT)
    table = lambda ids: spark.createDataFrame([("d", "v", i) for i in ids], f"{UNIT}, x long")
    return mt.set_metrics(unit, table(pred), table(gt), ["dataset", "video_id"], "x").first()


@pytest.mark.parametrize("pred,gt", [([], []), ([1], []), ([], [1]), ([1, 2, 2], [2, 3, 4]), ([5], [5])])
def test_set_metrics(spark, pred, gt):
    row, back = sets(spark, pred, gt), sets(spark, gt, pred)
    p, g = set(pred), set(gt)
    assert row.iou == pytest.approx(len(p & g) / len(p | g) if p | g else 1.0)
    assert row.f1 == pytest.approx(back.f1) and row.p == pytest.approx(back.r)
    assert row.hit == int(bool(p & g))


def test_ranking_metrics(spark):
    rows = [([1, 2, 3, 4], [4.0, 3.0, 2.0, 1.0]), ([4, 3, 2, 1], [4.0, 3.0, 2.0, 1.0]), ([1, 2], [1.0, 1.0]), (None, [1.0]), ([2, 1, 3], [5.0, 5.0, 1.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, ranking array<long>, scores array<double>")
    a, b, tied, none, some = mt.ranking_metrics(df).orderBy("i").collect()
    assert (a.spearman_r, a.kendall_tau, a.top_k_precision) == (pytest.approx(1), pytest.approx(1), 1.0)
    assert (b.spearman_r, b.kendall_tau) == (pytest.approx(-1), pytest.approx(-1))
    assert tied.spearman_r is None and tied.kendall_tau is None and none.spearman_r is None
    assert some.kendall_tau == pytest.approx(2 / math.sqrt(3 * 2))


def test_selection_correlation_equals_the_pairwise_form(spark, small_tasks):
    rnd = random.Random(2)
    xs = [(rnd.randint(0, 1), float(rnd.randint(0, 5))) for _ in range(40)]
    items = spark.createDataFrame([("d", "v", s, v) for s, v in xs], f"{UNIT}, selected int, score double")
    row = mt.selection_rank_corr(items).first()
    sign = lambda a: (a > 0) - (a < 0)
    pairs = [(sign(a[0] - b[0]), sign(a[1] - b[1])) for a in xs for b in xs]
    tau = sum(p * q for p, q in pairs) / math.sqrt(sum(abs(p) for p, _ in pairs) * sum(abs(q) for _, q in pairs))
    rank = lambda v, all_v: sum(o < v for o in all_v) + (sum(o == v for o in all_v) + 1) / 2
    rs = [[rank(x[i], [y[i] for y in xs]) for x in xs] for i in (0, 1)]
    assert row.kendall_tau == pytest.approx(tau)
    assert row.spearman_rho == pytest.approx(np.corrcoef(rs)[0, 1])


def test_undefined_selection_correlation(spark):
    items = spark.createDataFrame([("d", "v", 0, 1.0), ("d", "v", 0, 2.0)], f"{UNIT}, selected int, score double")
    row = mt.selection_rank_corr(items).first()
    assert row.spearman_rho is None and row.kendall_tau is None


@pytest.mark.parametrize("seed", range(8))
def test_common_subsequence(seed):
    rnd = random.Random(seed)
    a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
    b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 30))]
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    assert mt.lcs_length(a, b) == rows[-1][-1]


def test_text_overlap(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "", "x"), (3, "a b c d e", "a b c d e")], "id long, candidate string, reference string")
    got = {(r.id, r.n): r.f1 for r in mt.rouge_n(df, ["id"]).collect()}
    assert got[(1, 1)] == pytest.approx(2 / 3) and got[(1, 2)] == pytest.approx(1 / 2)
    assert got[(2, 1)] == 0 and got[(3, 2)] == 1
    assert {r.id: round(r.bleu4, 6) for r in mt.bleu4(df, ["id"]).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}
    assert {r.id: r.lcs for r in mt.rouge_l(df, ["id"]).collect()} == {1: 2, 2: 0, 3: 5}


def test_embedding_match_equals_the_mean_over_pairs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(3, 5)), rng.normal(size=(4, 5))
    table = lambda m: spark.createDataFrame([("d", "v", row.tolist()) for row in m], f"{UNIT}, feature array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    got = mt.embedding_match(table(a), table(b)).first().score
    assert got == pytest.approx((unit(a) @ unit(b).T).mean())


def test_wins_keep_items_without_any(spark):
    pairs = spark.createDataFrame([("d", "v", 0, 1, "A"), ("d", "v", 0, 2, "B"), ("d", "v", 1, 2, None)], f"{UNIT}, i long, j long, winner string")
    items = spark.createDataFrame([("d", "v", i) for i in range(3)], f"{UNIT}, orig_pos long")
    assert {r.orig_pos: r.wins for r in win_counts(pairs, items).collect()} == {0: 1, 1: 0, 2: 1}


def test_distances_vanish_on_identical_data(spark, small_tasks):
    df = spark.createDataFrame([(float(i % 37), 1) for i in range(200)], "v double, in_subset int")
    assert dist.ks_two_sample(df, "v").first().statistic == 0
    assert dist.wasserstein_1d(df, "v").first().distance == 0


def test_distances_match_plain_numpy(spark, small_tasks):
    rng = np.random.default_rng(9)
    v, s = np.round(rng.normal(size=300), 2), rng.integers(0, 2, 300)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, s)], "v double, in_subset int")
    grid = np.unique(v)
    f = np.searchsorted(np.sort(v), grid, side="right") / len(v)
    g = np.searchsorted(np.sort(v[s == 1]), grid, side="right") / s.sum()
    assert dist.ks_two_sample(df, "v").first().statistic == pytest.approx(np.abs(f - g).max())
    area = (np.abs(f - g)[:-1] * np.diff(grid)).sum()
    assert dist.wasserstein_1d(df, "v").first().distance == pytest.approx(area)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(x, 1) for x in (-0.1, 0.0, 0.29999999999999999, 0.3, 0.6, 0.7000000000000001, 1.0, 1.01)], "v double, in_subset int")
    got = [r.n_full for r in dist.histogram(df, "v", 0.1, 10).orderBy("bin").collect()]
    counts, _ = np.histogram([r.v for r in df.collect()], bins=np.arange(11) * 0.1)
    assert got == counts.tolist()


@pytest.mark.parametrize("x,df,p", [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (0.0, 4, 1.0), (2.0, 4, 0.7357588823428847), (124.342113, 100, 0.05)])
def test_chi_squared_tail(x, df, p):
    assert dist._upper_gamma(df / 2, x / 2) == pytest.approx(p, abs=1e-6)


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    known = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")

    def arrive(ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(source)
        files = arrivals.arriving_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
        table = arrivals.run_to_table(arrivals.watch_arrivals(files, known, ["id"]), out, state)
        return sorted(r.id for r in table.collect())

    assert arrive([1, 1, 9]) == [1]
    assert arrive([1, 3]) == [1, 3]


def test_flush_writes_one_folder_per_n_results(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(0, 40, 1, 4).write.parquet(source)
    files = arrivals.arriving_files(spark, source, spark.read.parquet(source).schema, files_per_batch=1)
    arrivals.flush_every_n(files, 10, lambda b: b.groupBy("flush").agg(F.count(F.lit(1)).alias("n")), out, state)
    got = spark.read.parquet(out)
    assert got.agg(F.sum("n")).first()[0] == 40 and got.select("flush").distinct().count() == 4


@pytest.mark.parametrize("n,m", [(1, 1), (3, 4), (5, 5), (2, 7), (7, 6)])
def test_exact_tail_counts_all_orders(n, m):
    for least in range(n * m + 1):
        out = 0
        for chosen in itertools.combinations(range(n + m), n):
            i = np.cumsum(np.isin(np.arange(n + m), chosen))
            j = np.arange(1, n + m + 1) - i
            out += least <= 0 or bool((np.abs(i * m - j * n) >= least).any())
        assert dist.path_tail(least / (n * m), n, m) == pytest.approx(out / math.comb(n + m, n), abs=1e-13)


def test_the_p_value_is_exact_for_small_sides_only(spark):
    df = spark.createDataFrame([(float(i), int(i % 3 == 0)) for i in range(90)], "v double, in_subset int")
    exact, asymptotic = dist.ks_two_sample(df, "v").first(), dist.ks_two_sample(df, "v", exact_up_to=89).first()
    assert exact.p_value == pytest.approx(dist.path_tail(exact.statistic, 90, 30))
    x = exact.statistic * math.sqrt(90 * 30 / 120)
    tail = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 100)) if x >= 0.2 else 1.0
    assert asymptotic.p_value == pytest.approx(tail)
    none = dist.ks_two_sample(df.withColumn("in_subset", F.lit(0)), "v").first()
    assert none.p_value is None
