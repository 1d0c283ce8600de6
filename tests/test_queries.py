"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from codegrain.queries import oracle_sql, queries
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(listed):
    return sorted(repr([round(float(v), 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v for v in r]) for r in listed)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, duck, name):
    got = queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    assert rows(got.select(columns).collect()) == rows(duck.sql(f"select {order} from ({oracle_sql()[name]})").fetchall())


def test_entry_imports():
    import __spark_entry__

    assert set(queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
