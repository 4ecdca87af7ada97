"""Every registered query against its SQL, on the smallest driver tables."""

import os
import re
import time

import pytest

import __spark_entry__ as driver
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables")
@pytest.mark.parametrize("name", driver.queries())
def test_query(spark, name):
    problem, rows, *_ = compare(spark, FOLDER, name, driver.queries()[name], SQL.get(name))
    assert problem is None
    assert rows > 0 or name == "empty_scope_search"


def test_no_pairing_joins(spark):
    for name in ("mmr_search", "topk_cosine", "question_scopes", "change_plan", "error_gate",
                 "crawl_report_lines", "read_lines", "query_dimensions", "list_sources"):
        plan = driver.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
@pytest.mark.parametrize("name", ["mmr_search", "question_scopes", "text_search", "sliced_search"])
@pytest.mark.parametrize("how", ["", "NOT MATERIALIZED"])
def test_search_sql_stays_cheap_inlined(name, how):
    """No common table is named twice, so it does not matter whether they are inlined."""
    sql = SQL[name]
    names = re.findall(r"(\w+) AS (?:MATERIALIZED )?\(\s*SELECT", sql)
    for table in names:
        assert len(re.findall(rf"\b(?:FROM|JOIN|,) {table}\b", sql)) <= 1
    sql = re.sub(r"(\w+) AS (?:MATERIALIZED )?\((\s*SELECT)", rf"\1 AS {how} (\2", sql) if how else sql
    start = time.time()
    connect("/root/testdata/sf0.01").execute(sql).fetchall()
    assert time.time() - start < 3
