"""Every query with SQL gives what DuckDB gives on the same tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from sheafwork.catalog import ORACLES, QUERIES
from sheafwork.catalog.derived import TABLES
from tools.check_oracles import rows_of


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows_of([tuple(r) for r in got.collect()], columns, got.columns) == rows_of(
        result.fetchall(), columns, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, sf, name):
    got = QUERIES[name](spark, sf)
    assert len(set(got.columns)) == len(got.columns)
    assert got.count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns == ["code", "n"]
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {
    "predict_type", "train_text_classifier", "corpus_palette", "near_duplicate_pairs", "near_duplicate_groups",
    "near_duplicate_pairs_fast", "near_duplicate_groups_fast", "stream_hot_folder", "stream_dedup_history",
    "stream_quiet_batches_closed"}))
def test_plan_has_no_cross_product(spark, sf, name):
    """Even when nothing may be broadcast, no query falls back to a product of its inputs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["failed_samples"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
    assert "o_totalprice" not in plan.split("ReadSchema")[1]
    plan = QUERIES["select_by_ids"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,P)" in plan
