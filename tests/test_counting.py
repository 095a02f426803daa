"""Each source is counted once, before its plan is built."""

import pytest

import __spark_entry__ as contract
from spanforge.operators import ordered
from spanforge.sources import views

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name",
    ["dataset_overview", "position_to_shot", "gt_frame_set", "topk_frames", "segment_score", "annotate_ground_truth_exact", "shot_stats"],
)
def test_one_counting_pass(spark, monkeypatch, name):
    calls = []

    def counted(df, keys=ordered.KEYS, limit=None):
        calls.append(list(keys))
        return real(df, keys, limit)

    real = ordered.find_oversize
    for module in ("ordered", "groundtruth", "joins", "sampling", "distribution"):
        monkeypatch.setattr(f"spanforge.operators.{module}.find_oversize", counted, raising=False)
    monkeypatch.setattr("spanforge.plans.groundtruth_plans.find_oversize", counted)
    monkeypatch.setattr(views, "find_oversize", counted)
    contract.queries()[name](spark, DATA)
    assert len(calls) <= 1
