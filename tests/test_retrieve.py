"""Retrieval edge cases (FIXTURES.md section 4) and properties."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from quarry.functions.vectors import l2_distance, word_count
from quarry.operators import retrieve, validate

DOC_SCHEMA = "id long, dataset_id long, body string, vector array<float>"
Q_SCHEMA = "query_id long, query string, query_vector array<float>, user_id long, dataset string, word_limit long"
DS_SCHEMA = "id long, user_id long, name string"


def _docs(spark, data):
    df = spark.createDataFrame(data, DOC_SCHEMA)
    return df.select("id", "dataset_id", "vector", word_count("body").alias("word_count"))


def _budget(spark, docs, queries, datasets, **kw):
    req = validate.accepted(validate.answer_requests(spark.createDataFrame(queries, Q_SCHEMA)))
    return retrieve.budget_search(req, spark.createDataFrame(datasets, DS_SCHEMA), _docs(spark, docs), **kw)


def test_ties_at_the_edge_are_all_or_nothing(spark):
    docs = [(i, 1, "w", [1.0, 0.0]) for i in (1, 2, 3)]
    ds = [(1, 7, "x")]
    out = _budget(spark, docs, [(1, "q", [0.0, 0.0], 7, "x", 2)], ds)
    assert out.count() == 0  # a pre-limit of 2 rows would wrongly return 2
    out = _budget(spark, docs, [(1, "q", [0.0, 0.0], 7, "x", 3)], ds)
    assert rows(out, "id", "cumulative_words") == [(1, 3), (2, 3), (3, 3)]


def test_first_document_too_long_gives_nothing(spark):
    docs = [(1, 1, " ".join(["w"] * 10), [0.1, 0.0]), (2, 1, "w", [0.5, 0.0])]
    out = _budget(spark, docs, [(1, "q", [0.0, 0.0], 7, "x", 5)], [(1, 7, "x")])
    assert out.count() == 0


def test_word_count_whitespace(spark):
    df = spark.createDataFrame([(" a  b ",), ("",), ("a",)], "t string")
    assert [r[0] for r in df.select(word_count("t")).collect()] == [4, 1, 1]


def test_tenant_filter(spark):
    docs = [(1, 1, "a", [0.0, 1.0]), (2, 2, "b", [0.0, 1.0])]
    ds = [(1, 1, "x"), (2, 2, "x")]
    out = _budget(spark, docs, [(1, "q", [0.0, 0.0], 2, "x", 10)], ds)
    assert rows(out, "id") == [(2,)]


def test_unknown_dataset_and_default(spark):
    docs = [(1, 1, "a", [0.0, 1.0])]
    ds = [(1, 1, "default")]
    out = _budget(spark, docs, [(1, "q", [0.0, 0.0], 1, "missing", 10), (2, "q", [0.0, 0.0], 1, "", 10)], ds)
    assert rows(out, "query_id", "id") == [(2, 1)]


def test_guards(spark):
    q = spark.createDataFrame([(1, "", [1.0], 1, "x", 5), (2, "q", [], 1, "x", 5), (3, "q", [1.0], 1, "x", 0),
                               (4, "q", [1.0], 1, "x", -1), (5, "q", [1.0], 1, "x", None)], Q_SCHEMA)
    v = validate.answer_requests(q)
    got = {r.query_id: (r.word_limit, r.error) for r in v.collect()}
    assert got[1][1] == "empty query"
    assert got[2][1] == "empty vector"
    assert got[3][1] == got[4][1] == "word limit must be greater than zero"
    assert got[5] == (512, None)
    s = validate.search_requests(q.withColumn("k", F.lit(0)), k_col="k")
    assert {r.error for r in s.where("query_id = 5").collect()} == {"k must be greater than zero"}


def test_dimension_mismatch_is_not_ranked_first(spark):
    docs = [(1, 1, "a", [0.0, 0.0, 0.0]), (2, 1, "b", [0.5, 0.5])]
    out = _budget(spark, docs, [(1, "q", [0.0, 0.0], 7, "x", 10)], [(1, 7, "x")])
    assert rows(out, "id") == [(2,)]


def _random_case(rng, n_docs=60, n_queries=6):
    docs, queries = [], []
    for i in range(n_docs):
        v = [float(rng.randint(0, 3)), float(rng.randint(0, 2))]  # few distinct vectors: many ties
        docs.append((i + 1, 1 + i % 2, " ".join(["w"] * rng.randint(1, 4)), v))
    for q in range(n_queries):
        queries.append((q + 1, "q", [float(rng.randint(0, 3)), 0.0], 7, "x" if q % 2 else "y", rng.randint(1, 25)))
    return docs, queries, [(1, 7, "x"), (2, 7, "y")]


def _full_window(spark, docs, queries, datasets):
    """The literal plan: distance, RANGE running sum over the whole dataset."""
    d = _docs(spark, docs)
    q = spark.createDataFrame(queries, Q_SCHEMA)
    ds = spark.createDataFrame(datasets, DS_SCHEMA)
    pairs = (q.join(ds.withColumnRenamed("user_id", "u").withColumnRenamed("id", "dataset_id"),
                    (q.dataset == F.col("name")) & (q.user_id == F.col("u")))
             .join(d, "dataset_id").select("query_id", "id", "word_count", "word_limit",
                                           l2_distance("vector", "query_vector").alias("distance")))
    w = Window.partitionBy("query_id").orderBy("distance")
    return pairs.withColumn("c", F.sum("word_count").over(w)).where("c <= word_limit")


def test_prelimit_equals_full_window_on_tie_heavy_data(spark):
    rng = random.Random(7)
    for _ in range(4):
        docs, queries, ds = _random_case(rng)
        fast = _budget(spark, docs, queries, ds)
        slow = _full_window(spark, docs, queries, ds)
        assert rows(fast, "query_id", "id", "cumulative_words") == rows(slow, "query_id", "id", "c")


def test_budget_is_monotone(spark):
    rng = random.Random(3)
    docs, queries, ds = _random_case(rng)
    small = [(q[0], q[1], q[2], q[3], q[4], 5) for q in queries]
    large = [(q[0], q[1], q[2], q[3], q[4], 15) for q in queries]
    a = set(rows(_budget(spark, docs, small, ds), "query_id", "id"))
    b = set(rows(_budget(spark, docs, large, ds), "query_id", "id"))
    assert a <= b


def test_shuffle_path_equals_broadcast_path(spark):
    rng = random.Random(11)
    docs, queries, ds = _random_case(rng)
    a = _budget(spark, docs, queries, ds, broadcast_queries=True)
    b = _budget(spark, docs, queries, ds, broadcast_queries=False)
    assert rows(a, "query_id", "id", "rank") == rows(b, "query_id", "id", "rank")


def test_topk_nested(spark):
    rng = random.Random(5)
    docs, queries, ds = _random_case(rng)
    req = validate.accepted(validate.search_requests(spark.createDataFrame(queries, Q_SCHEMA)))
    dsdf = spark.createDataFrame(ds, DS_SCHEMA)
    d = _docs(spark, docs)
    k3 = retrieve.topk_search(req.withColumn("k", F.lit(3)), dsdf, d)
    k4 = retrieve.topk_search(req.withColumn("k", F.lit(4)), dsdf, d)
    assert set(rows(k3, "query_id", "id")) <= set(rows(k4, "query_id", "id"))
    assert max(r[0] for r in rows(k3, "rank")) <= 3


def test_a_large_budget_changes_no_other_query(spark):
    rng = random.Random(21)
    docs, queries, ds = _random_case(rng, n_docs=80)
    docs.append((1000, 2, "w", [0.0, None]))  # a bad stored vector is never returned
    before = spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold")
    alone = _budget(spark, docs, queries, ds)
    with_large = _budget(spark, docs, [*queries, (99, "q", [0.0, 0.0], 7, "x", 3_000_000_000)], ds)
    cols = ("query_id", "id", "rank", "cumulative_words")
    assert rows(alone, *cols) == [r for r in rows(with_large, *cols) if r[0] != 99]
    assert with_large.where("query_id = 99").count() == 40
    assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == before


def test_hot_dataset_and_copies(spark):
    """A third of all documents in one dataset, most of them exact copies: ties stay whole."""
    docs = [(i, 1 if i % 3 else 2, "w", [1.0, 0.0] if i % 4 else [float(i), 0.0]) for i in range(1, 601)]
    q = [(1, "q", [1.0, 0.0], 7, "x", 10), (2, "q", [1.0, 0.0], 7, "x", 1000)]
    out = _budget(spark, docs, q, [(1, 7, "x"), (2, 7, "y")])
    assert out.where("query_id = 1").count() == 0  # 300 copies tie and don't fit
    assert out.where("query_id = 2").count() == 400


def test_dimension_errors_reported(spark):
    docs = spark.createDataFrame([(1, 1, "a", [0.0, 0.0, 0.0]), (2, 1, "b", [0.5, 0.5, 0.5])], DOC_SCHEMA)
    q = spark.createDataFrame([(1, "q", [0.0, 0.0], 7, "x", 10), (2, "q", [0.0, 0.0, 1.0], 7, "x", 10)], Q_SCHEMA)
    req = validate.accepted(validate.answer_requests(q))
    mixed = spark.createDataFrame([(1, 1, "a", [0.0, 0.0, 0.0]), (2, 1, "b", [0.5, 0.5])], DOC_SCHEMA)
    assert retrieve.dimension_errors(req, spark.createDataFrame([(1, 7, "x")], DS_SCHEMA), mixed).count() == 2
    errs = retrieve.dimension_errors(req, spark.createDataFrame([(1, 7, "x")], DS_SCHEMA), docs)
    assert rows(errs) == [(1, "vector dimension differs from its dataset")]


def test_large_requests_use_many_tasks_and_equal_the_window(spark):
    """Budgets from one word to more than all documents, ties over the borders of ranges."""
    rng = random.Random(8)
    docs, queries, ds = _random_case(rng, n_docs=3000)
    queries = [(q[0], q[1], q[2], q[3], q[4], [1, 50, 1500, 4000, 9000, 3_000_000_000][i]) for i, q in enumerate(queries)]
    fast = _budget(spark, docs, queries, ds)
    slow = _full_window(spark, docs, queries, ds)
    assert rows(fast, "query_id", "id", "cumulative_words") == rows(slow, "query_id", "id", "c")
    ranks = {}
    for q, rank in rows(fast, "query_id", "rank"):
        ranks.setdefault(q, []).append(rank)
    assert all(r == list(range(1, len(r) + 1)) for r in ranks.values())
    d = _docs(spark, docs).select("id", "dataset_id", "vector")
    req = validate.accepted(validate.search_requests(spark.createDataFrame(queries, Q_SCHEMA).withColumn("k", F.lit(2000).cast("long")), k_col="k"))
    hits = retrieve.topk_search(req, spark.createDataFrame(ds, DS_SCHEMA), d)
    assert {r["count"] for r in hits.groupBy("query_id").count().collect()} == {1500}
    assert hits.where("query_id = 1").agg(F.max("rank")).first()[0] == 1500


def test_running_sum_of_a_hot_group_is_spread(spark):
    from quarry.plans import scan

    rng = random.Random(9)
    data = [(1 if i % 3 else i % 7, rng.randrange(400), i, rng.randrange(5)) for i in range(4000)]
    df = spark.createDataFrame(data, "g long, o long, id long, v long").repartition(6)
    ranged = scan.ranged(df, ["g"], [F.col("o")], 8)
    assert ranged.where("g = 1").select(scan.RANGE).distinct().count() > 3
    got = scan.running(df, ["g"], [F.col("o")], {"s": "v"}, "p", [F.col("id")], 8, {"m": "v"})
    w = Window.partitionBy("g").orderBy("o")
    want = df.withColumns({"s": F.sum("v").over(w), "m": F.max("v").over(w), "p": F.row_number().over(w.orderBy("o", "id")) - 1})
    cols = ("g", "o", "id", "v", "s", "p", "m")
    assert rows(got, *cols) == rows(want, *cols)
    assert scan.running(df.limit(0), ["g"], [F.col("o")], {"s": "v"}).count() == 0


def test_parts_give_the_rows_of_their_join(spark):
    """Texts and vectors apart: the same rows as from their join, with repeated and null ids, and copies whose ids meet."""
    texts = spark.createDataFrame([(1, 0, 1, "a b"), (1, 0, 1, "c"), (2, 0, 1, "d"), (3, 0, 1, "no vector"), (None, 0, 1, "e"), (4, 0, 1, "f g h"),
                                   (2, 1, 1, "i j"), (5, 1, 1, "k")], "id long, copy int, dataset_id long, body string")
    vectors = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 0, [0.0, 2.0]), (2, 0, [3.0, 0.0]), (None, 0, [0.0, 0.0]), (4, 0, [9.0, 0.0]), (6, 0, [0.0, 0.0]),
                                     (2, 1, [3.0, 0.0]), (5, 0, [1.0, 1.0])], "id long, copy int, vector array<float>")
    documents = texts.join(vectors, ["id", "copy"])
    parts = retrieve.Parts(texts, vectors.select("id", "copy"))
    datasets = spark.createDataFrame([(1, 7, "x")], DS_SCHEMA)
    req = validate.accepted(validate.answer_requests(spark.createDataFrame(
        [(1, "q", [0.0, 0.0], 7, "x", 1000), (2, "q", [0.0, 0.0], 7, "x", 30)], Q_SCHEMA)))
    cols = ("query_id", "id", "word_count", "cumulative_words", "distance")
    whole = retrieve.budget_search(req, datasets, documents)
    apart = retrieve.budget_search(req, datasets, documents.drop("body"), parts=parts)
    assert whole.count() > 20 and rows(apart, *cols) == rows(whole, *cols)
    want = retrieve.attach(whole, documents, ("dataset_id", "body"))
    got = retrieve.attach(apart, documents, ("dataset_id", "body"), parts)
    assert rows(got, *cols, "dataset_id", "body") == rows(want, *cols, "dataset_id", "body")
