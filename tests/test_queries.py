"""Every registered query beside its DuckDB SQL on the smallest tables."""

import os
from collections import Counter

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from isoframe.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}"
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def rows(records):
    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        return round(float(v), 6) + 0.0

    return Counter(tuple(plain(v) for v in r) for r in records)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    chosen = ", ".join('"{}"'.format(n.replace('"', '""')) for n in names)
    assert rows(got.select(*[f"`{n}`" for n in names]).collect()) == rows(duck.sql(f"SELECT {chosen} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
