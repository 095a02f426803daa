import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.functions import index
from spanforge.operators import index as numbering
from spanforge.operators import sampling as sm


@pytest.mark.parametrize("k", [1, 2, 5, 23, 60])
def test_uniform_thinning_matches_truncated_linspace(spark, k):
    rows = spark.range(1, 81).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    got = {}
    for r in sm.thin_uniform(rows, F.lit(k).cast("long"), "p", "n").collect():
        got.setdefault(r.n, []).append((r.slot, r.p))
    for n, found in got.items():
        want = list(range(n)) if n <= k else np.linspace(0, n - 1, k, dtype=int).tolist()
        assert [p for _, p in sorted(found)] == want


@pytest.mark.parametrize("k", [1, 3, 8, 50])
def test_stride_thinning_pads_with_the_last_row(spark, k):
    rows = spark.range(1, 61).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    got = {}
    for r in sm.thin_stride(rows, F.lit(k).cast("long"), "p", "n").collect():
        got.setdefault(r.n, []).append((r.slot, r.p))
    for n, found in got.items():
        want = [int(i * n / k) for i in range(k)] if n > k else list(range(n)) + [n - 1] * (k - n)
        assert [p for _, p in sorted(found)] == want


def test_rounded_picks_match_linspace(spark):
    sizes = [(n_total, n) for n_total in (0, 1, 2, 31, 100, 301) for n in (0, 1, 2, 7, 23, 64)]
    df = spark.createDataFrame([(t * 1000 + n, t, n) for t, n in sizes], "clip long, n_total long, n long")
    got = {}
    for r in numbering.picks_linspace(df).collect():
        got.setdefault((r.n_total, r.n), []).append((r.step, r.pick))
    for t, n in sizes:
        want = np.round(np.linspace(0, t - 1, n)).astype(int).tolist() if t > 0 and n > 0 else []
        assert [p for _, p in sorted(got.get((t, n), []))] == want


def test_shot_budget_rounds_half_to_even(spark):
    n = F.col("id")
    rows = spark.range(0, 60).select(n.alias("n"), index.shot_budget(n, 0.30, 4, 8).alias("k"), index.shot_budget(n, 0.1, 1, 1, True).alias("one"))
    for r in rows.collect():
        assert r.k == max(4, min(8, round(r.n * 0.30)))
        assert r.one == min(r.n, max(1, min(1, round(r.n * 0.1))))


@pytest.mark.parametrize("budget", [1, 4, 9, 30])
def test_budget_is_spent_in_order(spark, budget):
    sizes = [3, 0, 5, 2, 7, 1]
    shots = spark.createDataFrame([("d", "v", i, n) for i, n in enumerate(sizes)], "dataset string, video_id string, shot_idx long, n_sampled long")
    got = [r.take for r in sm.global_budget_truncate(shots, budget).orderBy("shot_idx").collect()]
    left, want = budget, []
    for n in sizes:
        take = min(n, max(1, left))
        want.append(take)
        left = max(0, left - take)
    assert got == want


def test_sampling_is_independent_of_row_order_and_unshuffles(spark):
    rows = [("d", f"v{g}", f"k{i}", i) for g in range(4) for i in range(12)]
    schema = "dataset string, video_id string, item_key string, i long"
    a = sm.shuffle_per_group(sm.sample_per_group(spark.createDataFrame(rows, schema), 5, 42, [F.col("i")]), 42)
    b = sm.shuffle_per_group(sm.sample_per_group(spark.createDataFrame(rows[::-1], schema), 5, 42, [F.col("i")]), 42)
    assert sorted(a.collect()) == sorted(b.collect())
    back = sm.to_original(a.select("dataset", "video_id", F.col("display_pos").alias("pred_id")), a)
    for video, part in back.toPandas().groupby("video_id"):
        assert sorted(part.orig_pos) == [0, 1, 2, 3, 4]
    assert {r.n for r in a.groupBy("video_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {5}


def test_representatives_keep_empty_shots(spark):
    shots = spark.createDataFrame([("d", "v", 0, 7), ("d", "v", 1, 0)], "dataset string, video_id string, shot_idx long, n_sampled long")
    frames = spark.createDataFrame([("d", "v", 0, p, p * 10, float(p)) for p in range(7)], "dataset string, video_id string, shot_idx long, shot_pos long, pick long, gtscore double")
    got = sorted((r.shot_idx, r.slot, r.pick, r.gtscore) for r in sm.representatives(frames, shots).collect())
    k = max(1, math.ceil(7 * 0.20))
    want = [(0, i, int(p) * 10, float(p)) for i, p in enumerate(np.linspace(0, 6, k, dtype=int))] + [(1, 0, -1, 0.0)]
    assert got == want


def test_run_centers(spark):
    votes = spark.createDataFrame([("d", "v", 1, f, 10) for f in (0, 1, 2, 5, 8, 9)], "dataset string, video_id string, user_id long, frame long, n long")
    got = sorted(r.center for r in sm.run_centers(votes, "n").collect())
    assert got == [pytest.approx(0.15), pytest.approx(0.55), pytest.approx(0.9)]


def test_one_long_segment_is_spelled_into_few_buckets(spark):
    from spanforge.operators import joins

    unit = "dataset string, video_id string"
    spans = [("d", "v", 0, 0, 10_000_000), ("d", "v", 1, 5, 5), ("d", "v", 2, 60, 70), ("d", "v", 3, 9, 8), ("d", "v", 4, 900, 4_000)]
    segments = spark.createDataFrame(spans, f"{unit}, shot_idx long, start long, end long")
    points = spark.createDataFrame([("d", "v", p) for p in (0, 5, 64, 900, 4_000, 4_001, 10_000_000, 10_000_001)], f"{unit}, at long")
    got = sorted((r.shot_idx, r.at) for r in joins.interval_hits(segments, points, "at").collect())
    assert got == sorted((s, p.at) for _, _, s, a, b in spans for p in points.collect() if a <= p.at <= b)
    hits = joins.interval_hits(segments, points, "at")
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" in plan  # at most five buckets a segment:
    size = 64 * 8 ** math.ceil(math.log2(10_000_001 / 256) / 3)
    assert 10_000_000 // size + 1 <= 5
