"""Every registered query against its SQL on the smallest driver tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
from check import connect, rows_of

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    if not Path(FOLDER).exists():
        pytest.skip("driver tables are not here")
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, database, name):
    frame = QUERIES[name](spark, FOLDER)
    rows = rows_of(frame.columns, frame.collect())
    if name not in SQL:
        assert rows
        return
    cursor = database.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
