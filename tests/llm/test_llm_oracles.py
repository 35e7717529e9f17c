"""Queries of the subpackage that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest
from cohortrail.llm.oracles import LLM_ORACLES
from cohortrail.llm.queries import LLM_QUERIES
from compare import TYPES, assert_same, duck
from conftest import SF_DIR

TYPES["boolean"] = "BOOLEAN"


@pytest.mark.parametrize("name", LLM_ORACLES)
def test_same_as_duckdb(spark, name):
    df = LLM_QUERIES[name](spark, SF_DIR)
    result = duck(SF_DIR).execute(LLM_ORACLES[name])
    assert df.count() > 0
    assert_same(df, result)
