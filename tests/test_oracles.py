"""Every query with SQL gives the rows that DuckDB gives on the small tables."""

import duckdb
import pytest

import tidewatch.queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows(spark, db, name):
    got = q.QUERIES[name](spark, SF).toPandas()
    want = db.sql(q.ORACLE_SQL[name]).df()[list(got.columns)]
    keys = list(got.columns)
    got, want = (x.sort_values(keys).reset_index(drop=True).astype(str) for x in (got, want))
    assert len(got) == len(want)
    assert (got.replace("None", "nan") == want.replace("None", "nan")).all().all()
