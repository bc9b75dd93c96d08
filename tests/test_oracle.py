"""Every registered query against its SQL on the smallest tables, and the contract's entry."""

import math

import duckdb
import pytest

from cellmill import plans
from cellmill.plans import grouped

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(rows, columns):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(df.columns) == sorted(columns)
        assert canonical(got, df.columns) == canonical(want.fetchall(), columns)


def test_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
    assert set(SQL) <= set(QUERIES)


def test_plans_stay_in_the_engine(spark):
    """Scans prune columns, filters reach the scan, and only grouped operators run Python."""
    plan = QUERIES["depth_quality"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan
    plan = QUERIES["set_except"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "c_name" not in plan
    for name in set(SQL) - {"batch_predictions", "token_f1", "label_normalise", "decoded_arrays", "patch_matches"} - set(grouped.QUERIES):  # model calls; Unicode forms; bytes; sequential rules
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan, name
        assert "Pandas" not in plan and "ArrowEvalPython" not in plan, name
