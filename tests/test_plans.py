"""Plan-level guards: no cross joins, filters reach the Parquet scan, scoring
and splits read the materialized table without a shuffle."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()  # final AQE plan
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_explorer_filters_pushed_to_parquet(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = _plan(E.queries()["filtered_explorer"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(tv), IsNotNull(sales), In(influencer" in plan
    assert "GreaterThanOrEqual(tv,100.0)" in plan


@pytest.mark.parametrize("key", ["score_requests", "validate_requests", "train_test_split", "campaign_roi",
                                 "prepared_features", "filtered_explorer"])
def test_row_local_keys_do_not_shuffle(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan


def test_linked_panels_scan_once(spark):
    from adlift.plans.profiling import linked_panels
    plan = linked_panels(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
