"""Every registered query with SQL gives the rows that DuckDB gives; the others run."""

import decimal

import duckdb
import pytest

from tickloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: str(float(x)) if isinstance(x, (float, decimal.Decimal)) else str(x)
    return sorted(tuple(text(x) for x in r) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, duck):
    own, sql = registry.queries()[name](spark, SF).toPandas(), registry.oracle_sql().get(name)
    if sql:
        want = duck.sql(sql).df()
        assert sorted(own.columns) == sorted(want.columns)
        assert rows(own) == rows(want)


def test_partitions_do_not_matter(spark):
    q = registry.queries()["e14_feature_frame"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(rows(q(spark, SF).toPandas()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
