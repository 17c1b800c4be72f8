"""Every registered query: shape of its plan, and its rows against its SQL."""

from __future__ import annotations

import re

import duckdb
import pytest

import __spark_entry__ as entry
from trajmill import registry
from tools.check_sql import TABLES, bag_of

# Caller-supplied Python, literal cells of foreign CSV files: the only Python in plans.
PYTHON = {"apply_map", "apply_group", "score_with", "scan_scored_csv"}
PYTHON_NODES = re.compile(r"(ArrowEval|BatchEval|MapIn|InPandas|InArrow|pythonUDF)")
BAD_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.fixture(scope="module")
def con(sf):
    link = duckdb.connect()
    for name in TABLES:
        link.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return link


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in BAD_JOINS)
    if name not in PYTHON:
        assert not PYTHON_NODES.search(plan)
    names, ours = bag_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    theirs, want = bag_of([d[0] for d in cursor.description], cursor.fetchall())
    assert names == theirs
    assert ours == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "pass_at_k", "prompts"] and df.count() > 0


def plan_of(spark, sf, name):
    return entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["select_topk", "select_topk_per_search", "best_k_of_n_accuracy", "dedupe_scored", "build_relabelled_set"]
)
def test_topk_is_limited_before_the_shuffle(spark, sf, name):
    plan = plan_of(spark, sf, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scan_reads_only_needed_columns(spark, sf):
    plan = plan_of(spark, sf, "pass_at_k_curve")
    assert "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_positive_filter_reaches_the_scan(spark, sf, tmp_path):
    from trajmill import schemas
    from trajmill.operators.conversations import filter_positive
    from trajmill.registry import tables
    from trajmill.sources.scans import scan_rollouts

    folder = str(tmp_path / "rollouts")
    tables.trajectories(spark, sf).select(*schemas.ROLLOUTS.names).write.parquet(folder)
    plan = filter_positive(scan_rollouts(spark, folder))._jdf.queryExecution().executedPlan()
    assert "EqualTo(label,true)" in plan.toString()
