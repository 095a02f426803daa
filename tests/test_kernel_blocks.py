"""Kernel work by blocks gives what one task gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import groundtruth as gt
from spanforge.operators import kernel_blocks as kb
from spanforge.operators.ordered import Oversize, find_oversize

SCHEMA = "dataset string, video_id string, step long, feature array<double>"


def sequences(rng, sizes, width=6):
    rows = []
    for v, n in sizes.items():
        level = rng.normal(size=(n // 7 + 1, width))
        x = level[np.arange(n) // 7] + 0.2 * rng.normal(size=(n, width))
        rows += [("d", v, s, x[s].tolist()) for s in range(n)]
    return rows


@pytest.mark.parametrize("size", [256, 512])
def test_median_by_blocks_has_the_same_bits(spark, size):
    rng = np.random.default_rng(1)
    rows = sequences(rng, {"a": 1_100, "b": 3, "c": 1, "d": 300})
    rows += [("d", "same", s, [1.0, 2.0]) for s in range(9)]
    frames = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.video_id: r.sigma for r in kb.median_gap_by_blocks(frames, Oversize(), size).collect()}
    for v in ("a", "b", "c", "d", "same"):
        x = np.array([r[3] for r in rows if r[1] == v])
        assert got[v] == gt._median_gap(x), v
    assert got["c"] == got["same"] == 1.0
    x = np.array([r[3] for r in rows if r[1] == "d"])
    full = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(300, 1)]
    assert got["d"] == pytest.approx(np.median(full))


def test_large_groups_are_spread(spark, monkeypatch):
    rng = np.random.default_rng(2)
    frames = spark.createDataFrame(sequences(rng, {"a": 40, "b": 8}), SCHEMA)
    alone = {r.video_id: r.sigma for r in gt.median_bandwidth(frames).collect()}
    monkeypatch.setattr(kb, "ALONE", 10)
    monkeypatch.setattr(kb, "BLOCK", 256)
    assert {r.video_id: r.sigma for r in gt.median_bandwidth(frames).collect()} == alone
    shots = frames.withColumns({"shot_idx": F.floor(F.col("step") / 30).cast("long"), "sigma": F.lit(1.0)})
    mass = sorted(map(tuple, gt.segment_kernel_mass(shots).collect()))
    monkeypatch.undo()
    assert [r[:4] for r in mass] == [r[:4] for r in sorted(map(tuple, gt.segment_kernel_mass(shots).collect()))]


@pytest.mark.parametrize("size", [1, 7, 1_000])
def test_mass_by_blocks(spark, size):
    rng = np.random.default_rng(3)
    rows = [("d", v, s, x, s // 23, 0.9) for _, v, s, x in sequences(rng, {"a": 60, "b": 5})]
    frames = spark.createDataFrame(rows, SCHEMA + ", shot_idx long, sigma double")
    key = lambda r: (r.video_id, r.shot_idx)
    want = {key(r): (r.length, r.mass) for r in gt.segment_kernel_mass(frames).collect()}
    got = {key(r): (r.length, r.mass) for r in kb.mass_by_blocks(frames, Oversize(), size).collect()}
    assert got.keys() == want.keys()
    for k, (length, mass) in want.items():
        assert got[k] == (length, pytest.approx(mass, rel=1e-12))


@pytest.mark.parametrize("size,per,min_len", [(8, 4, 1), (12, 3, 2)])
def test_cuts_by_blocks(spark, monkeypatch, size, per, min_len):
    monkeypatch.setattr(kb, "COUNTS", 3)
    monkeypatch.setattr(kb, "ENDS", 4)
    rng = np.random.default_rng(size)
    sizes = {"a": 23, "b": 9, "c": 1}
    rows = sequences(rng, sizes)
    frames = spark.createDataFrame(rows, SCHEMA).withColumn("sigma", F.lit(1.1))
    got = {}
    for r in kb.cuts_by_blocks(frames, per, min_len, Oversize(), size).orderBy("start").collect():
        got.setdefault(r.video_id, []).append((r.start, r.end))
    for v, n in sizes.items():
        x = np.array([r[3] for r in rows if r[1] == v])
        starts = gt.best_cuts(x, 1.1, max(1, min(n // per, n // min_len)), min_len)
        assert got[v] == list(zip(starts, [*[s - 1 for s in starts[1:]], n - 1])), v


def test_long_sequences_are_segmented_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frames = spark.createDataFrame(sequences(rng, {"a#x": 40, "b": 25, "c": 6}), SCHEMA)
    alone = sorted(map(tuple, gt.segment_by_kernel(frames, 5).collect()))
    forced = sorted(map(tuple, gt.segment_by_kernel(frames, 5, block=20).collect()))
    monkeypatch.setattr(kb, "ALONE", 12)
    monkeypatch.setattr(kb, "STEPS", 16)
    assert sorted(map(tuple, gt.segment_by_kernel(frames, 5).collect())) == alone
    assert sorted(map(tuple, gt.segment_by_kernel(frames, 5, block=20).collect())) == forced
    assert find_oversize(frames, limit=12).n_groups == 2
