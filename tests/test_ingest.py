"""Decode, get-or-create, ids, ingest statuses, cascade, integrity."""

from pyspark.sql import functions as F

from conftest import rows
from quarry.operators import ingest, integrity

REQ = "request_id long, user_id long, title string, url string, body string, dataset string"
DS = "id long, user_id long, name string"


def test_decode(spark):
    raw = spark.createDataFrame([(1, "{bad"), (2, "{}"), (3, '{"title":"t","body":"b","dataset":"d"}')],
                                "request_id long, payload string")
    got = {r.request_id: (r.title, r.dataset, r.status) for r in ingest.decode_documents(raw).collect()}
    assert got == {1: (None, None, "invalid json"), 2: ("", "", "accepted"), 3: ("t", "d", "accepted")}
    bulk = spark.createDataFrame([(1, '[{"title":"a"},{"title":"b"}]'), (2, '[{"title":"a"},{"ti')],
                                 "batch_id long, payload string")
    assert rows(ingest.decode_bulk(bulk), "batch_id", "position", "status") == [
        (1, 1, "accepted"), (1, 2, "accepted"), (2, 0, "invalid json")]


def test_assign_ids_dense_and_ordered(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("k"))
    out = ingest.assign_ids(df, ["k"], base=100)
    got = rows(out, "k", "id")
    assert got == [(k, 101 + k) for k in range(1000)]


def test_get_or_create(spark):
    existing = spark.createDataFrame([(5, 1, "a")], DS)
    wanted = spark.createDataFrame([("b", 1), ("b", 1), ("a", 1), ("a", 2)], "name string, user_id long")
    resolved, all_ds = ingest.get_or_create(existing, wanted)
    # new ids follow (user_id, name) order after the current maximum
    assert rows(resolved, "name", "user_id", "id", "created") == [("a", 1, 5, False), ("a", 2, 7, True),
                                                                  ("b", 1, 6, True)]
    assert all_ds.count() == 3


def test_ingest_statuses(spark):
    req = spark.createDataFrame([(1, 1, "t", "", "b c", "new"), (2, 1, "t", "", "b", "new"),
                                 (3, 1, "t", "", "b", "new"), (4, 1, "t", "", "b", "other")], REQ)
    vec = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (4, [])], "request_id long, vector array<float>")
    out = ingest.ingest(req, vec, spark.createDataFrame([(1, 9, "x")], DS), doc_id_base=10)
    st = dict(out["status"].select("request_id", "status").collect())
    assert st == {1: "accepted", 2: "accepted", 3: ingest.ST_EMBED_FAILED, 4: ingest.ST_EMPTY_VECTOR}
    # the empty-vector document is rejected but its new dataset exists
    assert rows(out["datasets"], "name") == [("new",), ("other",), ("x",)]
    assert rows(out["documents"], "id", "request_id", "word_count") == [(11, 1, 2), (12, 2, 1)]


def test_nan_vector_rejected_at_ingest(spark):
    req = spark.createDataFrame([(1, 1, "t", "", "b", "x"), (2, 1, "t", "", "b", "x")], REQ)
    vec = spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [0.5, 1.0])], "request_id long, vector array<float>")
    out = ingest.ingest(req, vec, spark.createDataFrame([], DS), doc_id_base=0)
    assert dict(out["status"].select("request_id", "status").collect()) == {1: ingest.ST_BAD_VECTOR, 2: "accepted"}


def test_cascade(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, 2)], "id long, dataset_id long")
    gone = spark.createDataFrame([(2, 1, "x")], DS)
    assert rows(ingest.cascade_delete(docs, gone), "id") == [(1,)]
    moved = ingest.cascade_update(docs, spark.createDataFrame([(2, 20)], "old_id long, new_id long"))
    assert rows(moved, "id", "dataset_id") == [(1, 1), (2, 20), (3, 20)]


def test_constraint_report(spark):
    ds = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, 2, "a")], DS)
    docs = spark.createDataFrame([(1, 1, "t", "b", [1.0]), (1, 9, "t", "b", [1.0, float("nan")])],
                                 "id long, dataset_id long, title string, body string, vector array<float>")
    users = spark.createDataFrame([(1, "u", None)], "id long, username string, active boolean")
    tokens = spark.createDataFrame([(1, 1, "k"), (2, 3, "k")], "id long, user_id long, token string").withColumn("expiration", F.current_timestamp())
    sessions = spark.createDataFrame([("s", 1, ["m"], None), ("s", 1, ["m"], "x")], "id string, user_id long, messages array<string>, model string")
    got = dict(integrity.constraint_report(ds, docs, users, tokens, sessions).collect())
    assert got["datasets.pk"] == 1 and got["datasets.unique_name_user"] == 1
    assert got["documents.pk"] == 1 and got["documents.fk_dataset"] == 1 and got["documents.finite_vectors"] == 1
    assert got["sessions.pk"] == 1 and got["sessions.not_null"] == 1 and got["users.not_null"] == 1
    assert got["access_tokens.not_null"] == 0
    assert got["access_tokens.unique_token"] == 1 and got["access_tokens.fk_user"] == 1


def test_rejected_documents_set_no_dimension(spark):
    req = spark.createDataFrame([(i, 1, "t", "", "b", "x") for i in (1, 2, 3, 4)], REQ)
    vec = spark.createDataFrame([(1, [float("nan"), 1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0, None]), (4, [float("inf"), 1.0])],
                                "request_id long, vector array<float>")
    out = ingest.ingest(req, vec, spark.createDataFrame([], DS))
    assert dict(out["status"].select("request_id", "status").collect()) == {
        1: ingest.ST_BAD_VECTOR, 2: "accepted", 3: ingest.ST_BAD_VECTOR, 4: ingest.ST_BAD_VECTOR}
    assert {r.request_id: r.id for r in out["results"].collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_store_layouts_answer_alike(spark):
    import tempfile

    from conftest import SF_SMALL
    from quarry.operators import retrieve, validate
    from quarry.sources import kb
    from quarry.sources.tables import Catalog
    from quarry.functions.vectors import word_count

    cat = Catalog(spark, SF_SMALL)
    docs = kb.documents(cat).withColumn("word_count", word_count("body"))
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    want = retrieve.budget_search(req, kb.datasets(cat), docs)
    for buckets in (None, 4):
        path = tempfile.mkdtemp(prefix="quarry-store-") + "/docs"
        ingest.store_documents(docs, path, bucket_count=buckets)
        got = retrieve.budget_search(req, kb.datasets(cat), ingest.read_documents(spark, path, bucket_count=buckets))
        assert rows(got, "query_id", "id", "rank") == rows(want, "query_id", "id", "rank")


def test_one_dimension_per_dataset(spark):
    req = spark.createDataFrame([(1, 1, "t", "", "b", "x"), (2, 1, "t", "", "b", "x"), (3, 1, "t", "", "b", "x"),
                                 (4, 1, "t", "", "b", "y")], REQ)
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [0.5, 0.5]), (4, [1.0])],
                                "request_id long, vector array<float>")
    ds = spark.createDataFrame([(7, 1, "x")], DS)
    out = ingest.ingest(req, vec, ds)
    assert dict(out["status"].select("request_id", "status").collect()) == {
        1: "accepted", 2: ingest.ST_DIMENSION, 3: "accepted", 4: "accepted"}
    known = spark.createDataFrame([(7, 3)], "dataset_id long, dim int")
    out = ingest.ingest(req, vec, ds, dataset_dims=known)
    assert dict(out["status"].select("request_id", "status").collect()) == {
        1: ingest.ST_DIMENSION, 2: "accepted", 3: ingest.ST_DIMENSION, 4: "accepted"}


def test_decode_typed(spark):
    cases = {'{"title":"t","BODY":"b","Dataset":null,"x":[1]}': ("t", "", "b", "", "accepted"), "null": ("", "", "", "", "accepted"),
             "{}": ("", "", "", "", "accepted"), '{"title":5}': None, '{"title":true}': None, '{"url":["a"]}': None, '{"body":{"a":1}}': None,
             "[]": None, '"text"': None, "5": None, "": None, "{bad": None, '{"title":"a"}}': ("a", "", "", "", "accepted"), '{"title":"5"}': ("5", "", "", "", "accepted"),
             '{"more":{"title":7},"title":"é\\n\\u0041"}': ("é\nA", "", "", "", "accepted"), '{"titles":1}': ("", "", "", "", "accepted")}
    df = spark.createDataFrame([(i, p, "x") for i, p in enumerate(cases)] + [(99, None, "x")], "request_id long, payload string, kind string")
    got = {r.request_id: (r.title, r.url, r.body, r.dataset, r.status) for r in ingest.decode_typed(df).collect()}
    for i, (p, want) in enumerate(cases.items()):
        assert got[i] == (want or (None, None, None, None, "invalid json")), p
    assert got[99][4] == "invalid json"
