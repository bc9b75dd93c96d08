"""The summary of models finds its percentiles in ranges of values."""

from cellmill.plans import cells


def test_no_task_holds_a_models_values(spark):
    out = cells.summary_by_model(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
    assert out.columns == ["model", "n", "scenes", "median", "p95", "max", "min", "std", "rms"] and out.count() == 3
