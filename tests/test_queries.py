"""Every registered query with SQL must equal it, and no query may be vacuous."""

import duckdb
import pytest

from veilspan.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()
#: Queries that may be empty on the smallest tables.
MAY_BE_EMPTY = {"spans_card_pages", "spans_phone_pages", "spans_secret_context"}


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, sf_dir, con, name):
    df = catalog.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got or name in MAY_BE_EMPTY
    if name in SQL:
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
