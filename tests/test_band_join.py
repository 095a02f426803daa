"""Picks near selected frames, whatever the repetitions, with one grouping."""

from spanforge.operators import joins


def test_repeated_selections_count_once_and_are_grouped_once(spark):
    picks = spark.createDataFrame([("d", "v", s, 30 * s) for s in range(5)], "dataset string, video_id string, step long, pick long")
    frames = [("d", "v", 1, 15), ("d", "v", 1, 15), ("d", "v", 1, 44), ("d", "v", 2, 76), ("d", "w", 1, 0)]
    selected = spark.createDataFrame(frames, "dataset string, video_id string, user_id long, frame long")
    near = joins.band_semi_join(picks, selected)
    assert sorted((r.user_id, r.step) for r in near.collect()) == [(1, 0), (1, 1), (2, 3)]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
