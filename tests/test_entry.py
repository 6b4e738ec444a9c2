"""The entry module's contract."""

import __spark_entry__ as e
from voxtable.plans import queries as plans


def test_entry_and_keys(spark):
    assert e.entry(spark).count() == 20
    assert set(plans.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert set(plans.QUERIES) - set(plans.SQL) == {"mesh_triangle_count", "layered_undo"}


def test_filters_and_columns_reach_the_scan(spark):
    plan = e.queries()["snapshot_as_of"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(event_id,500)" in plan and "props" not in plan
    plan = e.queries()["label_volumes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "s_name" not in plan and "Python" not in plan and "NestedLoop" not in plan


def test_every_query_scans_a_table(spark):
    """Of queries over volumes of a fixed size too: what is left of a plan must still read the driver's tables."""
    import re

    for name in plans.QUERIES:
        plan = e.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"Relation \[.*\] (parquet|binaryFile)", plan), name
