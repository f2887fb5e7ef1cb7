"""The training-data queries with SQL against DuckDB on small tables, and the others' invariants there."""

import os

import duckdb
import pytest

from compare import norm
from strandframe.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = norm([tuple(r) for r in df.select(*cols).collect()])
    res = con.execute(queries.SQL[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == cols
    assert got == norm([tuple(r[have.index(c)] for c in cols) for r in res.fetchall()])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_others_give_rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_every_document_has_a_place_and_uses(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.p7_containers(spark, SF).select("doc_id").distinct().count() == n
    assert queries.p8_uses(spark, SF).count() == n
