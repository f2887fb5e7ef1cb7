"""Every query with SQL against DuckDB on the smallest tables, and the contract of the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from compare import norm
from strandframe.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = norm([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    res = con.execute(registry.oracle_sql()[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    assert got == norm([tuple(r[have.index(c)] for c in cols) for r in res.fetchall()])


#: Rules that no row of these tables meets; they are tested on fixtures of their own.
NONE_HERE = {"phase_masked", "path_bubbles", "path_flows"}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_gives_rows_once(spark, name):
    df = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert (len(rows) > 0) == (name not in NONE_HERE)
    assert len(rows) == len(set(rows)) and len(set(df.columns)) == len(df.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "strandframe"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "strandframe.llm" not in f.read_text(), f
