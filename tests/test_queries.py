"""Every query outside the training-data subpackage against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tesserae.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rounded(rows):
    clean = [tuple(None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(clean, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect()]
    if name not in registry.ORACLE_SQL:
        assert got
        return
    rel = con.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    order = [list(rel.columns).index(c) for c in columns]
    assert rounded(got) == rounded([tuple(r[i] for i in order) for r in rel.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
