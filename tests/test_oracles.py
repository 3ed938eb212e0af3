"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from sensorloom import workload  # noqa: E402

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the given tables are not here")
QUERIES, ORACLES = workload.queries(), workload.oracles()
SQL_TYPE = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    found = ordered(tuple(row[c] for c in columns) for row in df.collect())
    relation = tables.sql(ORACLES[name])
    assert columns == sorted(relation.columns)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    assert {c: SQL_TYPE[k] for c, k in df.dtypes} == kinds
    at = [relation.columns.index(c) for c in columns]
    assert found == ordered(tuple(row[i] for i in at) for row in relation.fetchall())
