"""Ordered operators give the same rows whether or not groups are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanforge.operators import ordered
from spanforge.operators.groundtruth import annotate_ground_truth, select_greedy, select_under_budget

KEYS = list(ordered.KEYS)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with a third of all rows and more, tied values, empty values."""
    rnd = random.Random(7)
    rows = []
    for video, n in (("hot", 40), ("warm", 9), ("cold", 3), ("one", 1)):
        steps = list(range(n))
        rnd.shuffle(steps)
        rows += [("d", video, s, rnd.randint(0, 6), rnd.choice([None, f"t{s}"])) for s in steps]
    return spark.createDataFrame(rows, "dataset string, video_id string, step long, v long, word string").cache()


def test_no_group_is_oversize_by_default(skewed):
    assert ordered.find_oversize(skewed).empty


def test_oversize_groups_are_found(small_tasks, skewed):
    over = ordered.find_oversize(skewed)
    assert over.n_groups == 2 and over.rows == 49
    rest, big = over.split(skewed, KEYS)
    assert rest.count() == 4 and big.count() == 49


@pytest.mark.parametrize(
    "work",
    [
        lambda d: ordered.with_position(d, KEYS, [F.col("v"), F.desc("step")]),
        lambda d: ordered.with_position(d, [], [F.col("video_id"), F.col("step")]),
        lambda d: ordered.running_sum(d, KEYS, [F.col("step")], {"s": F.col("v"), "n": F.lit(1)}),
        lambda d: ordered.carry_forward(d, KEYS, [F.col("step")], "last", F.col("word")),
        lambda d: ordered.carry_forward(d, KEYS, [F.desc("step")], "next", F.col("word")),
        lambda d: ordered.next_value(d.drop("word"), KEYS, "step", "following"),
        lambda d: ordered.quantiles(d, ["video_id"], "v", {"q1": 0.25, "q2": 0.5, "q3": 0.9}),
        lambda d: ordered.quantiles(d, [], "v", {"q": 0.333}),
    ],
)
def test_cut_groups_give_the_same_rows(spark, skewed, work):
    whole = rows_of(work(skewed))
    spark.conf.set("spark.spanforge.rowsPerTask", "5")
    try:
        cut = rows_of(work(skewed))
    finally:
        spark.conf.unset("spark.spanforge.rowsPerTask")
    assert cut == whole


def test_position_matches_plain_python(small_tasks, skewed):
    got = {(r.video_id, r.step): r.pos for r in ordered.with_position(skewed, KEYS, [F.col("step")]).collect()}
    assert all(pos == step for (_, step), pos in got.items())


def test_quantiles_match_numpy(small_tasks, skewed):
    got = {r.video_id: r.q for r in ordered.quantiles(skewed, ["video_id"], "v", {"q": 0.37}).collect()}
    values = {}
    for r in skewed.collect():
        values.setdefault(r.video_id, []).append(r.v)
    for video, found in got.items():
        assert found == pytest.approx(np.percentile(values[video], 37))


def test_first_rows_limit_groups_before_the_shuffle(skewed, capsys):
    ordered.first_rows(skewed, KEYS, [F.col("step")], 2).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


@pytest.mark.parametrize("pick", [select_greedy, select_under_budget])
def test_selection_is_the_same_for_cut_groups(spark, pick):
    rnd = random.Random(3)
    rows = []
    for video, n in (("hot", 30), ("cold", 4), ("tight", 8)):
        cap = 1 if video == "tight" else 25
        rows += [("d", video, i, rnd.randint(1, 9), float(rnd.randint(1, 40)), cap) for i in range(n)]
    items = spark.createDataFrame(
        rows, "dataset string, video_id string, shot_idx long, weight long, value double, capacity long"
    )
    whole = rows_of(pick(items))
    spark.conf.set("spark.spanforge.rowsPerTask", "5")
    try:
        cut = rows_of(pick(items))
    finally:
        spark.conf.unset("spark.spanforge.rowsPerTask")
    assert cut == whole


def test_annotation_is_the_same_for_cut_groups(spark):
    rnd = random.Random(11)
    rows = [
        ("d", v, s, s * 15, rnd.random()) for v, n in (("hot", 130), ("b", 47), ("c", 1)) for s in range(n)
    ]
    frames = spark.createDataFrame(rows, "dataset string, video_id string, step long, pick long, gtscore double")
    whole = rows_of(annotate_ground_truth(frames).withColumn("score", F.round("score", 9)))
    spark.conf.set("spark.spanforge.rowsPerTask", "20")
    try:
        cut = rows_of(annotate_ground_truth(frames).withColumn("score", F.round("score", 9)))
    finally:
        spark.conf.unset("spark.spanforge.rowsPerTask")
    assert cut == whole
