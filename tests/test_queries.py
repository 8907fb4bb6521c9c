"""Every query with SQL gives the rows that DuckDB gives."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import registry

SQL = registry.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    return round(value, 6) + 0.0 if isinstance(value, float) and value == value else value


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf, duck):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = ordered([tuple(map(plain, r)) for r in df.select(*columns).collect()])
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = ordered([tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()])
    assert rows == expected


def test_names_can_be_read_without_a_session():
    code = "import __spark_entry__ as e; assert e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)
