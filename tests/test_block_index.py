"""The block index returns what a full scan returns, and reads less."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quarry.operators import block_index, retrieve

DOCS = "id long, dataset_id long, vector array<float>"
Q = "query_id long, query string, query_vector array<float>, user_id long, dataset string, k long"
DS = "id long, user_id long, name string"


def clustered(rnd, n, centers, dims=6, spread=0.05):
    return [[c + rnd.gauss(0, spread) for c in rnd.choice(centers)] for _ in range(n)]


def both(spark, tmp_path, docs, queries, datasets):
    d, q = spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(queries, Q)
    ds = spark.createDataFrame(datasets, DS)
    block_index.build(d, str(tmp_path / "index"))
    hits, work = block_index.search(q, ds, spark, str(tmp_path / "index"))
    want = retrieve.topk_search(q, ds, d)
    assert rows(hits, "query_id", "rank", "id", "distance") == rows(want, "query_id", "rank", "id", "distance")
    return {r.query_id: (r.n_vectors, r.n_compared) for r in work.collect()}


def test_clusters_are_skipped(spark, tmp_path):
    rnd = random.Random(1)
    centers = [[rnd.uniform(-5, 5) for _ in range(6)] for _ in range(25)]
    docs = [(i, 1 + i % 2, v) for i, v in enumerate(clustered(rnd, 1500, centers))]
    queries = [(i, "q", v, 7, "xy"[i % 2], rnd.choice([1, 5, 20])) for i, v in enumerate(clustered(rnd, 40, centers))]
    work = both(spark, tmp_path, docs, queries, [(1, 7, "x"), (2, 7, "y")])
    assert all(c <= n == 750 for n, c in work.values())
    assert sum(c for _, c in work.values()) < 0.3 * sum(n for n, _ in work.values())


def test_ties_copies_and_odd_vectors(spark, tmp_path):
    """Copies at the edge of a block and of the k, bad elements, other dimensions, more asked for than there is."""
    rnd = random.Random(2)
    docs = [(i, 1, [float(rnd.randrange(3)), float(rnd.randrange(2))]) for i in range(300)]
    docs += [(1000 + i, 1, [1.0, 1.0]) for i in range(150)]
    docs += [(2000, 1, [0.0, float("nan")]), (2001, 1, [1.0, None]), (2002, 1, None), (2003, 1, [0.0, 0.0, 0.0]), (2004, 1, []), (2005, 2, [1.0, 0.0])]
    queries = [(i, "q", [rnd.randrange(4) / 2, rnd.randrange(3) / 2], 7, "x", k) for i, k in enumerate([1, 3, 100, 151, 449, 450, 5000] * 3)]
    queries += [(90, "q", [0.0, 0.0, 1.0], 7, "x", 4), (91, "q", [0.0, 1.0], 7, "y", 4), (92, "q", [0.0, 1.0], 7, "nowhere", 4), (93, "q", [1.0], 7, "x", 4)]
    both(spark, tmp_path, docs, queries, [(1, 7, "x"), (2, 7, "y")])


@pytest.mark.parametrize("seed", [3, 4])
def test_random_vectors(spark, tmp_path, seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(block_index, "BLOCKS_PER_FOLDER", 3)
    monkeypatch.setattr(block_index, "GROUP_ROWS", 40)
    docs = [(i, 1 + i % 3 // 2, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    queries = [(i, "q", [rnd.gauss(0, 1) for _ in range(8)], 7, "xy"[i % 2], 1 + i) for i in range(12)]
    both(spark, tmp_path, docs, queries, [(1, 7, "x"), (2, 7, "y")])


def test_folders_are_pruned(spark, tmp_path):
    rnd = random.Random(5)
    docs = [(i, 1 + i % 9, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(3000)]
    d = spark.createDataFrame(docs, DOCS)
    block_index.build(d, str(tmp_path / "index"))
    table = spark.read.schema(block_index.ROWS).parquet(str(tmp_path / "index" / "rows"))
    assert table.select("folder").distinct().count() > 1 and table.count() == 3000
    wanted = spark.read.parquet(str(tmp_path / "index" / "blocks")).where("dataset_id = 1").select(
        "block", F.floor(F.col("block") / block_index.BLOCKS_PER_FOLDER).alias("folder"), F.lit(1).alias("query_id"), F.lit(1).alias("k"),
        F.array(*[F.lit(0.0).cast("float")] * 4).alias("query_vector"))
    plan = block_index._compared(F.broadcast(wanted), table)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_empty(spark, tmp_path):
    d = spark.createDataFrame([], DOCS)
    block_index.build(d, str(tmp_path / "index"))
    q = spark.createDataFrame([(1, "q", [1.0], 7, "x", 2)], Q)
    hits, work = block_index.search(q, spark.createDataFrame([(1, 7, "x")], DS), spark, str(tmp_path / "index"))
    assert hits.count() == 0 and work.count() == 0
