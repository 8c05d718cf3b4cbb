"""Every registered query against its SQL in DuckDB, and what the driver expects of the entry."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry_points  # noqa: E402

duckdb = pytest.importorskip("duckdb")
TABLES = Path(entry_points.SMALL_TABLES)
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for file in TABLES.glob("*.parquet"):
        connection.sql(f"create view {file.stem} as select * from '{file}'")
    return connection


def ordered(table, columns):
    rows = zip(*[table[c].to_pylist() for c in columns])
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, sql, name):
    rows = entry_points.queries()[name](spark, str(TABLES))
    columns = sorted(rows.columns)
    assert len(columns) == len(set(columns))
    found = rows.select(*columns).toArrow()
    statement = entry_points.oracle_sql().get(name)
    if statement is None:
        assert found.num_rows > 0
        return
    expected = sql.sql(statement).to_arrow_table()
    assert sorted(expected.column_names) == columns
    assert ordered(found, columns) == ordered(expected, columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
