import numpy as np
import pytest

from corvane.llm import embeddings, queries


def slow(rows, cosine=0.9):
    """rows: (id, vector or None). All pairs."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = {i: np.array(rows[i][1], dtype=float) / np.linalg.norm(np.array(rows[i][1], dtype=float)) for i in ok}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for size in {len(units[i]) for i in ok}:
        mine = [i for i in ok if len(units[i]) == size]
        m = np.array([units[i] for i in mine])
        for a, b in zip(*np.nonzero(np.triu(m @ m.T >= cosine, 1))):
            links[mine[a]] += 1
            links[mine[b]] += 1
            x, y = find(mine[a]), find(mine[b])
            parent[max(x, y)] = min(x, y)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return sorted(((k, links[i], least.get(find(i)) if i in units else k) for i, (k, _) in enumerate(rows)), key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in df.collect()), key=repr)


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert result(queries.op1_pivot_index(spark, sf_dir)) == slow(rows)


@pytest.mark.parametrize("block", [7, 1024])
def test_clusters_of_all_widths(spark, block):
    rng = np.random.default_rng(4)
    rows = []
    for spread in (0.0, 0.01, 0.03, 0.05, 0.06, 0.08):
        for _ in range(3):
            centre = rng.normal(size=64)
            centre /= np.linalg.norm(centre)
            for _ in range(60 if spread == 0.03 else 12):
                rows.append((len(rows) * 5 % 997, ((centre + spread * rng.normal(size=64)) * rng.uniform(0.5, 4)).tolist()))
    rows += [(2000 + i, rng.normal(size=64).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, block=block).collect()}
    want = {k: (n, c) for k, n, c in slow(rows)}
    assert got.keys() == want.keys()
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())


def test_odd_rows(spark):
    a = [1.0, 0.0, 0.5]
    rows = [(4, a), (2, a), (2, a), (None, [2 * x for x in a]), (7, None), (8, [0.0, 0.0, 0.0]), (9, [1.0, None, 0.5]), (10, [float("nan"), 1.0, 0.0]), (11, [float("inf"), 0.0, 1.0]), (12, []), (13, [1.0, 0.0]), (14, [3.0, 0.0]), (1, [1e-300, 0.0, 5e-301]), (15, [-1.0, 0.0, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as n", "2 as cls", "3 as key", "4 as v", "5 as kept")
    assert result(embeddings.near_duplicates(df)) == sorted([(4, 4, 1), (2, 4, 1), (2, 4, 1), (None, 4, 1), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 0, 11), (12, 0, 12), (13, 1, 13), (14, 1, 13), (1, 4, 1), (15, 0, 15)], key=repr)
    kept = {r.vec_id for r in embeddings.near_duplicates(df).collect() if r.kept}
    assert kept == {7, 8, 9, 10, 11, 12, 13, 1, 15}
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def clustered(n, size=64, seed=3):
    """Vectors of clusters of many widths and sizes, and as many alone."""
    rng = np.random.default_rng(seed)
    parts, held = [], 0
    while held < n:
        k = int(min(n - held, rng.integers(1, 40)))
        centre = rng.normal(size=size)
        parts.append(centre / np.linalg.norm(centre) + rng.uniform(0, 0.6) / np.sqrt(size) * rng.normal(size=(k, size)))
        held += k
    return np.concatenate(parts)[rng.permutation(n)]


def recall(spark, vectors, every=100):
    """(links found, links there are) of the vectors whose number ``every`` divides, against all."""
    import pyarrow as pa

    table = pa.table({"vec_id": pa.array(np.arange(len(vectors))), "embedding": pa.array(list(vectors.astype(np.float32)))})
    df = spark.createDataFrame(table).repartition(8)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df).where(f"vec_id % {every} = 0").collect()}
    units = vectors.astype(np.float32).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    want = {i: int((units[i : i + 1] @ units.T >= 0.9).sum()) - 1 for i in range(0, len(units), every)}
    assert all(got[i] <= want[i] for i in want)
    return sum(got.values()), sum(want.values())


def test_recall_at_20000(spark):
    found, there = recall(spark, clustered(20_000))
    assert there > 500 and found >= 0.95 * there


@pytest.mark.parametrize("size", [4, 16])
def test_recall_on_vectors_without_clusters(spark, size):
    """In few dimensions all vectors are near many; lists are crowded and cores large."""
    found, there = recall(spark, np.random.default_rng(size).normal(size=(1200, size)), every=3)
    assert found >= 0.95 * there and (size > 4 or there > 1000)


def test_sql_on_a_table_with_links(spark, tmp_path):
    """The given tables of the SQL comparison hold no link; this one does."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    v = clustered(300, seed=11).astype(np.float32)
    rows = [*v.tolist(), v[0].tolist(), (2 * v[1]).tolist(), None, [0.0] * 64]
    pq.write_table(pa.table({"vec_id": list(range(len(rows))), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({queries.ORACLE_SQL['op1_pivot_index']})").fetchall())
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op1_pivot_index(spark, str(tmp_path)).collect())
    assert got == want and sum(r[1] for r in got) > 300


if __name__ == "__main__":
    # python tests/llm/test_embeddings.py N: recall on N clustered vectors, of the rows that 100 divides against all.
    import sys
    import time

    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate()
    began = time.perf_counter()
    print(sys.argv[1], recall(session, clustered(int(sys.argv[1]))), f"{time.perf_counter() - began:.0f} s")
