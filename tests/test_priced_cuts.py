"""Cuts found by prices are those of the full recursion over the number of segments."""

import numpy as np
import pytest

from spanforge.operators import groundtruth as gt
from spanforge.operators import kernel_blocks as kb
from spanforge.operators import priced_cuts as pc

SCHEMA = "dataset string, video_id string, step long, feature array<double>"


@pytest.mark.parametrize("seed", range(8))
def test_prices_find_the_cuts_of_the_full_recursion(seed):
    rng = np.random.default_rng(seed)
    for n, per, min_len in ((2, 1, 1), (9, 3, 2), (60, 4, 2), (61, 10, 1), (150, 3, 3), (150, 2, 1), (300, 40, 1), (100, 30, 20)):
        x = rng.normal(size=(n, 5))
        if seed % 2:
            x = x[rng.integers(0, n, n) // 8] * 3 + 0.1 * rng.normal(size=(n, 5))
        wanted = max(1, min(n // per, n // min_len))
        assert pc.priced_cuts(x, 1.5, wanted, min_len) == gt.best_cuts(x, 1.5, wanted, min_len), (n, per, min_len)


def test_long_beginnings_give_a_first_price():
    x = np.random.default_rng(9).normal(size=(2_100, 4))
    assert pc.priced_cuts(x, 2.0, 210) == gt.best_cuts(x, 2.0, 210)


def test_too_many_open_segments_and_values_without_number(monkeypatch):
    x = np.random.default_rng(10).normal(size=(50, 3))
    assert pc.priced_cuts(np.where(x > 9, x, np.nan), 1.0, 5) is None
    monkeypatch.setattr(pc, "KEPT_SPANS", 20)
    assert pc.priced_cuts(np.ones((50, 3)), 1.0, 5) is None
    starts = gt._cuts(np.ones((50, 3)), 1.0, 5, 1, True)
    assert len(starts) == 5 and starts[0] == 0
    monkeypatch.setattr(gt, "FULL_CUTS", 0)
    assert gt._cuts(np.ones((50, 3)), 1.0, 5, 1, True) == starts


def test_longer_sequences_need_no_table_of_steps_times_segments(spark, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [("d", v, s, rng.normal(size=4).tolist()) for v, n in (("a", 90), ("b", 70), ("c", 20)) for s in range(n)]
    rows += [("d", "same", s, [1.0, 2.0]) for s in range(60)]
    frames = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, gt.segment_by_kernel(frames.filter("video_id <> 'same'"), 5).collect()))
    monkeypatch.setattr(kb, "ALONE", 30)
    by_blocks = []
    solve = kb.cuts_by_blocks
    monkeypatch.setattr(kb, "cuts_by_blocks", lambda d, *a: by_blocks.extend(r.video_id for r in d.select("video_id").distinct().collect()) or solve(d, *a))
    monkeypatch.setattr(pc, "KEPT_SPANS", 300)
    got = sorted(map(tuple, gt.segment_by_kernel(frames, 5).collect()))
    assert [r for r in got if r[1] != "same"] == want
    assert sum(r[1] == "same" for r in got) == 12
    assert not {"0#a", "0#b"} & set(by_blocks)
