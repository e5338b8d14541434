"""The registered queries of this subpackage on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL
from oracle import differences

from inkledger.llm import catalog

COLUMNS = {
    "p1_found": ["obs_id", "officer_id"],
    "p2_found": ["obs_id_a", "obs_id_b"],
    "p3_found": ["obs_id", "field_name", "mapped_code"],
    "p6_found": ["source_table", "id_a", "id_b"],
    "p7_found": ["cell_id", "field_name", "consensus"],
    "p8_ids": ["doc_id", "ids"],
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert df.columns == COLUMNS.get(name, df.columns)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_duckdb(spark, name):
    assert differences(spark, SMALL, catalog.QUERIES[name], catalog.SQL[name]) == ""
