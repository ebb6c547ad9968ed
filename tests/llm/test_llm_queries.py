"""Every query of the package that has SQL, against it, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from marlspike.llm import queries
from verify import rows_of

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracles()))
def test_same_rows(spark, tables, name):
    df = queries.queries()[name](spark, str(DATA))
    result = tables.execute(queries.oracles()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


@pytest.mark.parametrize("name", ["p2_found", "p7_clusters", "p8_fill", "p9_report", "p10_found"])
def test_runs(spark, name):
    assert queries.queries()[name](spark, str(DATA)).count() > 0
