"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Spark type -> DuckDB type
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def assert_same(df, result) -> None:
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    order = sorted(names)
    left = sorted(tuple(repr(row[c]) for c in order) for row in df.collect())
    right = sorted(tuple(repr(row[names.index(c)]) for c in order) for row in expected)
    assert len(left) == len(right)
    assert left == right
