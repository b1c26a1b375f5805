"""The driver's contract: names, stable schemas, matching columns."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert len(rows) == 10 and rows[0].vec_id == 0 and rows[0].distance == 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_topk_plan_takes_ordered_without_a_full_sort(spark):
    plan = __spark_entry__.queries()["vector_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_and_columns_reach_the_scan(spark):
    from skarn.plans.base import Tables
    from skarn.plans.vectors import chunk_table
    from skarn.operators.search import filtered

    plan = filtered(chunk_table(Tables(spark, SF)), {"language": "en", "chunk_type": "src1"}).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "EqualTo(source,src1)" in plan and "ReadSchema: struct<doc_id:bigint" in plan
    assert "text:string" not in plan.split("ReadSchema")[-1]
