import itertools
import random

import numpy as np
import pytest

from spanforge.operators import groundtruth as gt

ITEMS = "dataset string, video_id string, shot_idx long, weight long, value double, capacity long"
FRAMES = "dataset string, video_id string, step long, pick long, gtscore double"


def enumerate_best(weights, values, capacity):
    best = 0.0
    for take in itertools.product((0, 1), repeat=len(weights)):
        if sum(w for w, t in zip(weights, take) if t) <= capacity:
            best = max(best, sum(v for v, t in zip(values, take) if t))
    return best


@pytest.mark.parametrize("seed", range(12))
def test_exact_choice_reaches_the_enumerated_optimum(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 8)
    weights = np.array([rnd.randint(1, 9) for _ in range(n)])
    values = np.array([float(rnd.randint(0, 20)) for _ in range(n)])
    capacity = rnd.randint(0, 25)
    keep = gt._best_subset(weights, values, capacity)
    assert weights[keep].sum() <= capacity
    assert values[keep].sum() == enumerate_best(weights, values, capacity)


def test_exact_choice_leaves_the_later_item_out_on_ties():
    keep = gt._best_subset(np.array([2, 2, 2]), np.array([5.0, 5.0, 5.0]), 4)
    assert keep.tolist() == [True, True, False]


def test_exact_is_at_least_greedy(spark):
    rnd = random.Random(5)
    rows = [("d", f"v{g}", i, rnd.randint(1, 9), rnd.random(), 14) for g in range(20) for i in range(7)]
    items = spark.createDataFrame(rows, ITEMS)
    value = {(r[1], r[2]): r[4] for r in rows}

    def totals(chosen):
        out = {}
        for r in chosen.collect():
            out[r.video_id] = out.get(r.video_id, 0) + value[(r.video_id, r.shot_idx)]
        return out

    exact, greedy = totals(gt.select_under_budget(items)), totals(gt.select_greedy(items))
    assert all(exact[v] >= greedy.get(v, 0) - 1e-12 for v in exact)


def test_greedy_skips_what_does_not_fit_and_goes_on(spark):
    rows = [("d", "a", 0, 3, 9.0, 5), ("d", "a", 1, 4, 11.0, 5), ("d", "a", 2, 2, 1.0, 5), ("d", "z", 0, 1, 1.0, 0)]
    got = {(r.video_id, r.shot_idx) for r in gt.select_greedy(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {("a", 0), ("a", 2)}


def brute_cuts(kernel, k, min_len):
    n = len(kernel)
    best, where = -np.inf, None
    for cuts in itertools.combinations(range(1, n), k - 1):
        edges = [0, *cuts, n]
        if min(b - a for a, b in zip(edges, edges[1:])) < min_len:
            continue
        score = sum(kernel[a:b, a:b].sum() / (b - a) for a, b in zip(edges, edges[1:]))
        if score > best + 1e-12:
            best, where = score, edges[:-1]
    return best, where


@pytest.mark.parametrize("k,min_len", [(1, 1), (2, 1), (3, 1), (3, 2), (4, 2)])
def test_cuts_are_optimal(k, min_len):
    x = np.random.default_rng(k).normal(size=(9, 3))
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * 1.3**2))
    assert gt.kernel_sum(x, 1.3) == pytest.approx(kernel.sum())
    starts = gt.best_cuts(x, 1.3, k, min_len)
    edges = [*starts, 9]
    score = sum(kernel[a:b, a:b].sum() / (b - a) for a, b in zip(edges, edges[1:]))
    assert len(starts) == k and starts[0] == 0
    assert min(b - a for a, b in zip(edges, edges[1:])) >= min_len
    assert score == pytest.approx(brute_cuts(kernel, k, min_len)[0])


def vectors(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows = [("d", v, s, rng.normal(size=4).tolist()) for v, n in sizes for s in range(n)]
    return spark.createDataFrame(rows, "dataset string, video_id string, step long, feature array<double>")


def test_kernel_segments_cover_every_step_once(spark):
    sizes = (("a", 57), ("b", 8), ("c", 1))
    frames = vectors(spark, sizes)
    for block in (None, 16):
        got = {}
        for r in gt.segment_by_kernel(frames, block=block).collect():
            got.setdefault(r.video_id, []).append((r.shot_idx, r.start, r.end))
        for video, n in sizes:
            spans = sorted(got[video])
            assert [i for i, _, _ in spans] == list(range(len(spans)))
            assert [s for _, a, b in spans for s in range(a, b + 1)] == list(range(n))
            if block is None:
                assert len(spans) == max(1, n // 10)


def dense_cuts(kernel, k):
    """The same optimum from the full matrix of gains."""
    n = len(kernel)
    total = np.zeros((n + 1, n + 1))
    total[1:, 1:] = kernel.cumsum(0).cumsum(1)
    corner, at = np.diagonal(total), np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (corner[:, None] + corner[None] - total - total.T) / (at[:, None] - at[None])
    gain[at[:, None] <= at[None]] = -np.inf
    best, back = gain[:, 0].copy(), []
    for _ in range(k - 1):
        through = gain + best[None]
        back.append(through.argmax(1))
        best = through[at, back[-1]]
    cuts, end = [], n
    for origin in reversed(back):
        end = int(origin[end])
        cuts.append(end)
    return [0, *reversed(cuts)]


def test_long_sequences_are_solved_as_one():
    """Beyond any strip or block: 2,300 steps with segments of known borders and as many again by chance."""
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(23, 3)), 100, axis=0) + 0.3 * rng.normal(size=(2300, 3))
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 2)
    assert gt.best_cuts(x, 1.0, 12) == dense_cuts(kernel, 12)


def test_median_gap_takes_all_pairs(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 300, 1300):
        x = rng.integers(0, 9, size=(n, 3)).astype(float)
        gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(n, 1)]
        gaps = gaps[gaps > 0]
        for most in (1 << 22, 10):
            monkeypatch.setattr(gt, "SORTED_GAPS", most)
            assert gt._median_gap(x) == pytest.approx(np.median(gaps) if len(gaps) else 1.0, rel=1e-6)


def test_cuts_and_bandwidth_do_not_depend_on_the_task_size(spark, small_tasks):
    frames = vectors(small_tasks, (("a", 64), ("b", 9)))
    few = sorted(map(tuple, gt.segment_by_kernel(frames).collect()))
    sigma = sorted(map(tuple, gt.median_bandwidth(frames).collect()))
    small_tasks.conf.unset("spark.spanforge.rowsPerTask")
    assert few == sorted(map(tuple, gt.segment_by_kernel(frames).collect()))
    assert sigma == sorted(map(tuple, gt.median_bandwidth(frames).collect()))


@pytest.mark.parametrize("seed", range(6))
def test_lists_and_curves_choose_alike(seed, monkeypatch):
    rnd = np.random.default_rng(seed)
    weights, values = rnd.integers(1, 60, 25), rnd.integers(1, 9, 25).astype(float)
    capacity = int(weights.sum() * 0.4)
    curve = gt._best_subset(weights, values, capacity)
    monkeypatch.setattr(gt, "CURVE_CELLS", 0)
    assert (gt._best_subset(weights, values, capacity) == curve).all()


def test_exact_choice_with_huge_capacity_and_many_items(spark):
    rows = [("d", "a", i, 1_000_003 * (i + 1), float(10 - i), 10**10) for i in range(8)]
    rows += [("d", "b", i, 10**9 + i * i, float(i), 2 * 10**9 + 50) for i in range(20)]
    rows += [("d", "c", i, 1 + i % 7, float((i * 37) % 1000), 400) for i in range(30_000)]
    got = {}
    for r in gt.select_under_budget(spark.createDataFrame(rows, ITEMS)).collect():
        got.setdefault(r.video_id, set()).add(r.shot_idx)
    assert got["a"] == set(range(8))
    pairs = [(a, b) for a in range(20) for b in range(a) if a * a + b * b <= 50]
    assert got["b"] == {19} and max(a + b for a, b in pairs) < 19
    value = {i: float((i * 37) % 1000) for i in range(30_000)}
    light = sorted((value[i] for i in range(0, 30_000, 7)), reverse=True)[:400]
    assert sum(1 + i % 7 for i in got["c"]) <= 400 and sum(value[i] for i in got["c"]) >= sum(light)


@pytest.mark.parametrize("n,k", [(1, 1), (3, 1), (10, 2), (30, 4), (50, 8)])
def test_share_of_key_frames_rounds_half_to_even(spark, n, k):
    frames = spark.createDataFrame([("d", "v", s, s, 1.0) for s in range(n)], FRAMES)
    marked = [r.step for r in gt.topk_frames(frames).filter("gtframe = 1").collect()]
    assert sorted(marked) == list(range(n - k, n))  # all tied: later steps first


def test_peak_of_a_shot_is_its_first_maximum(spark):
    frames = spark.createDataFrame([("d", "v", s, s, v) for s, v in enumerate([1.0, 3.0, 3.0, 2.0])], FRAMES)
    row = gt.argmax_per_shot(gt.segment_uniform(frames)).first()
    assert (row.step, row.gtscore) == (1, 3.0)


def test_votes_count_silent_users_as_zero(spark):
    picks = spark.createDataFrame([("d", "v", 0, 0), ("d", "v", 1, 15)], "dataset string, video_id string, step long, pick long")
    votes = spark.createDataFrame([("d", "v", 1, 0, 1), ("d", "v", 2, 0, 1), ("d", "v", 3, 15, 0)], "dataset string, video_id string, user_id long, frame long, selected int")
    users = spark.createDataFrame([("d", "v", u) for u in (1, 2, 3, 4)], "dataset string, video_id string, user_id long")
    got = {r.step: r.gtscore for r in gt.votes_to_score(picks, votes, users).collect()}
    assert got == {0: 0.5, 1: 0.0}


def test_nothing_is_forced_without_positive_scores(spark):
    rows = [("d", "a", 0, 0.0, 0), ("d", "a", 1, 0.0, 0), ("d", "b", 0, 2.0, 0), ("d", "b", 1, 2.0, 0)]
    s = spark.createDataFrame(rows, "dataset string, video_id string, shot_idx long, score double, selected int")
    got = {(r.video_id, r.shot_idx) for r in gt.force_best_if_empty(s).filter("selected = 1").collect()}
    assert got == {("b", 0)}
