"""Objects of orders are dealt by order over as many tasks as there are lines for."""

from cellmill.plans import questions as Q
from cellmill.plans import tasks as T

SF = "/root/testdata/sf0.001"


def test_tasks_follow_the_lines(spark, monkeypatch):
    monkeypatch.setattr(Q, "LINES", 100)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for query in (Q.attr_count, T.robot_count, T.robot_attribute):
        out = query(spark, SF)
        assert out.rdd.getNumPartitions() == -(-lines // 100), query.__name__  # nothing is dealt anew after the orders
