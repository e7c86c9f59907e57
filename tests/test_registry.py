import datetime

import duckdb
import pytest

from pathwatch.plans import contents, imports, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    q = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(dict(zip(names, r))[c]) for c in cols) for r in q.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_points_need_no_optional_subpackage():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
