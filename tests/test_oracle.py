"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import importlib

import __spark_entry__ as entry
import pytest
from conftest import SMALL
from oracle import differences

CORE = {n: (q, m.SQL.get(n)) for m in (importlib.import_module(f"inkledger.plans.{x}") for x in entry._MODULES) for n, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if sql))
def test_same_rows_as_duckdb(spark, name):
    query, sql = CORE[name]
    assert differences(spark, SMALL, query, sql) == ""


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if not sql))
def test_queries_without_sql_run(spark, name):
    assert CORE[name][0](spark, SMALL).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
