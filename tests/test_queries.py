"""Every registered query of the library against its SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES = {name: q for module in __spark_entry__.LIBRARY for name, q in module.queries().items()}
SQL = {name: q for module in __spark_entry__.LIBRARY for name, q in module.oracle_sql().items()}
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def db():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return own


def plain(rows):
    one = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = plain(df.select(*cols).collect())
    assert got or name in MAY_BE_EMPTY
    if name in SQL:
        quoted = ", ".join(f'"{c}"' for c in cols)
        assert got == plain(db.execute(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())


def test_entry(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and __spark_entry__.entry(spark).count() > 0
