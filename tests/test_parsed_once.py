"""Answers are parsed in one place of a plan, not again in a filter ahead of it."""

import pytest

import __spark_entry__ as contract

NAMES = ["set_overlap", "win_counts", "explode_predictions", "unshuffle_answers", "position_bias_summary", "temporal_ranking_metrics"]


@pytest.mark.parametrize("name", NAMES)
def test_no_filter_parses(spark, name):
    df = contract.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("regexp_extract" in line for line in plan)
    assert not [line for line in plan if "Filter" in line and "regexp" in line]


def test_ranks_need_no_count(spark, monkeypatch):
    from spanforge.operators import ordered

    def counted(*_):
        raise AssertionError("all pairs are judged for a count of groups")

    monkeypatch.setattr(ordered, "find_oversize", counted)
    assert contract.queries()["rank_from_wins"](spark, "/root/testdata/sf0.001").count() > 0
