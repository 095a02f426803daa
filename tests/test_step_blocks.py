"""Steps of long groups are spelled out by several tasks."""

import __spark_entry__ as contract


def test_projected_steps_are_dealt_out(spark):
    df = contract.queries()["project_votes"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "first" in plan.split("RepartitionByExpression", 1)[1].splitlines()[0]
