"""The written store: pruned folders, joins without a shuffle, the same rows."""

from conftest import SF_SMALL, rows
from pyspark.sql import functions as F

from quarry.operators import retrieve, validate
from quarry.plans import checks
from quarry.sources import kb, store
from quarry.sources.tables import Catalog


def test_store_joins_without_exchange_and_prunes(spark):
    cat = Catalog(spark, SF_SMALL)
    at = store.write(kb.documents(cat), buckets=4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = checks.plan_text(at.documents)
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(at.documents.select("id", "title", "body")) == rows(kb.documents(cat).select("id", "title", "body"))
        q = kb.queries(cat).select("query_id", "query_vector", (F.col("query_id") % 3 + 1).alias("dataset_id")).where("query_id < 9")
        plan = checks.plan_text(retrieve.score_pairs(q, at.vectors, True))
        assert "dynamicpruning" in plan and "text" not in plan.lower().split("readschema", 1)[1].split("\n")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        at.drop()


def test_hot_dataset_is_spread_over_buckets(spark):
    d = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(7)).alias("dataset_id"), F.lit("t").alias("title"),
                                F.lit("").alias("url"), F.lit("a b").alias("body"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    at = store.write(d, buckets=4)
    try:
        assert at.vectors.where("dataset_id = 7").select(F.input_file_name()).distinct().count() == 4
        assert at.vectors.count() == 900 and at.texts.count() == 900 and {r[0] for r in at.vectors.select("word_count").distinct().collect()} == {2}
    finally:
        at.drop()


def test_retrieval_over_the_store(spark):
    cat = Catalog(spark, SF_SMALL)
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    want = retrieve.budget_search(req, kb.datasets(cat), kb.documents(cat))
    at = store.write(kb.documents(cat), buckets=3)
    got = retrieve.budget_search(req, kb.datasets(cat), at.vectors)
    at.drop()
    assert rows(got) == rows(want)
