"""Every query against its SQL in DuckDB on the same tables."""

import duckdb
import pytest

from randaudit.jobs import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(table, names):
    clean = lambda x: None if x is None or x != x else x
    return sorted((tuple(clean(r[n]) for n in names) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf, name):
    got = registry.queries()[name](spark, sf)
    names = sorted(got.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    assert sorted(columns) == names
    assert rows([r.asDict() for r in got.collect()], names) == rows(want, names)


def test_every_query_has_sql_or_a_test_of_its_own():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"weighted_classifier"}
