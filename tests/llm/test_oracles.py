import math

import pytest

from corvane.llm import queries
from corvane.llm.common import clear_scratch, scratch_dir, written

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    cols = sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == cols
    got = sorted((tuple(None if isinstance(r[c], float) and math.isnan(r[c]) else r[c] for c in cols) for r in df.collect()), key=repr)
    assert got == want


def test_scratch_is_cleared(spark):
    from pathlib import Path

    written(spark.range(3), "probe")
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    assert list(folder.glob("corvane-probe-*"))
    clear_scratch(spark)
    assert not list(folder.glob("corvane-probe-*"))
