"""Every registered query with SQL equals DuckDB on the small tables."""

from __future__ import annotations

import datetime
import decimal
import math

import pytest

from corvane.plans import catalog
from corvane.plans.bind import counted

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert catalog.QUERIES[name].__doc__
    if name not in catalog.ORACLE_SQL:
        return
    found = db.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in found.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in order) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=repr)
    assert got == want


def test_counts_are_rewritten():
    assert counted("SELECT count_if(a IN (1, 2)) + count_if(b)") == "SELECT count(CASE WHEN a IN (1, 2) THEN 1 END) + count(CASE WHEN b THEN 1 END)"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["biblio_fields", "reference_kinds", "reference_matches", "volumes_and_pages"])
def test_keys_longer_than_a_page(spark, tmp_path, name):
    """Keys of seven digits and more, some of which end as others do: a page has six digits at most."""
    keys = [k + i for k in (0, 123_450, 999_980, 1_000_000, 1_123_450, 12_000_000, 3_000_000_000) for i in range(20)]
    spark.createDataFrame([(k, k % 50 + 1) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_reference_kinds_without_numbers(spark, tmp_path):
    """No key, keys below zero, and sizes that are none, below zero or longer than a volume."""
    keys, sizes = [None, None, -(2**63), -1_200_003, -7, -5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 1_000_000, 2**63 - 1], [None, -5, 0, 7, 9_999, 10_000, 123_456]
    spark.createDataFrame([(k, s) for k in keys for s in sizes], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    df = catalog.QUERIES["reference_kinds"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLE_SQL['reference_kinds']})").fetchall()
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)
