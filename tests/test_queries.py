import duckdb
import pytest

from tablewatch import plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_its_sql(spark, oracle, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(str(tuple(r)) for r in df.select(*columns).collect())
    if name in plans.oracle_sql():
        theirs = oracle.sql(plans.oracle_sql()[name])
        assert sorted(theirs.columns) == columns
        assert ours == sorted(str(r) for r in theirs.project(", ".join(f'"{c}"' for c in columns)).fetchall())
