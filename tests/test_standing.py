"""Standing queries: after every batch equal to a search over all documents so far."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quarry.functions.vectors import word_count
from quarry.operators import retrieve, standing
from quarry.plans import checks

DOCS = "id long, dataset_id long, body string, vector array<float>"
Q = "query_id long, query string, query_vector array<float>, user_id long, dataset string, word_limit long, k long"
DS = "id long, user_id long, name string"


def case(seed, n=120):
    rnd = random.Random(seed)
    docs = [(i, 1 + i % 2, " ".join(["w"] * rnd.randint(1, 4)), [float(rnd.randint(0, 4)), float(rnd.randint(0, 3))]) for i in range(n)]
    docs += [(n, 1, "w", [0.0, None]), (n + 1, 1, "w", [1.0])]  # never returned
    queries = [(q, "q", [float(rnd.randint(0, 4)), 0.0], 7, "xy"[q % 2], rnd.choice([1, 7, 20, 60, 10**9]), rnd.randint(1, 9)) for q in range(8)]
    return rnd.sample(docs, len(docs)), queries, [(1, 7, "x"), (2, 7, "y")]


@pytest.mark.parametrize("seed", [1, 2])
def test_updates_equal_searches(spark, seed):
    docs, queries, datasets = case(seed)
    q, ds = spark.createDataFrame(queries, Q), spark.createDataFrame(datasets, DS)
    ask = standing.resolved(q, ds, "word_limit", "k")
    winners, frontiers = spark.createDataFrame([], standing.WINNERS), spark.createDataFrame([], standing.FRONTIERS)
    best = spark.createDataFrame([], "query_id long, id long, distance double, rank int")
    for at in range(0, len(docs), 31):
        new = spark.createDataFrame(docs[at:at + 31], DOCS)
        winners, frontiers = standing.update_budget(ask, winners, frontiers, new)
        best = standing.update_top_k(ask, best, new)
        winners, frontiers, best = (spark.createDataFrame(x.collect(), x.schema) for x in (winners, frontiers, best))
        so_far = spark.createDataFrame(docs[:at + 31], DOCS).select("id", "dataset_id", "vector", word_count("body").alias("word_count"))
        want = retrieve.budget_search(q, ds, so_far)
        cols = ("query_id", "id", "rank", "cumulative_words", "distance")
        assert rows(winners, *cols) == rows(want, *cols), at
        assert rows(best, "query_id", "id", "rank") == rows(retrieve.topk_search(q, ds, so_far), "query_id", "id", "rank"), at


def test_stream_reads_the_last_state_alone_and_replays(spark, tmp_path):
    from quarry.streaming import standing as stream

    docs, queries, datasets = case(5, 60)
    q, ds = spark.createDataFrame(queries, Q), spark.createDataFrame(datasets, DS)
    ask = standing.resolved(q, ds, "word_limit")
    store, src = str(tmp_path / "store"), str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame(docs[i * 20:i * 20 + 20] if i < 2 else docs[40:], DOCS).coalesce(1).write.mode("append").parquet(src)
        stream.start(spark, src, DOCS, ask, store, str(tmp_path / "progress")).awaitTermination()
    counted = spark.createDataFrame(docs, DOCS).select("id", "dataset_id", "vector", word_count("body").alias("word_count"))
    want = rows(retrieve.budget_search(q, ds, counted), "query_id", "id", "cumulative_words")
    assert rows(stream.read(spark, store), "query_id", "id", "cumulative_words") == want
    stream.update(spark.createDataFrame(docs[40:], DOCS), 2, ask, store)
    assert rows(stream.read(spark, store), "query_id", "id", "cumulative_words") == want
    plan = checks.plan_text(stream._state(spark, f"{store}/winners", standing.WINNERS, 1))
    assert "PartitionFilters: [isnotnull(batch_id" in plan
    assert spark.read.parquet(f"{store}/winners").select("batch_id").distinct().count() == 3
    assert spark.read.parquet(f"{store}/frontiers").where(F.col("batch_id") == 2).groupBy("query_id").count().where("count > 1").count() == 0
