"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's tables (through ``sources.kb``) in full, so
its work grows with them. Output columns are flat scalars aliased to the
names used by ``plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.vectors import has_bad_element, l2_distance, word_count
from quarry.operators import answer, auth, block_index, constraints, context, embed, inference, ingest, intake, integrity, ledger, retrieve, sessions, standing, validate
from quarry.plans.parallel import spread
from quarry.plans.stage import fresh_path, shared_dir, staged
from quarry.sources import kb, store
from quarry.sources.tables import Catalog
from quarry.streaming import jobs, session_state
from quarry.streaming import standing as stream_standing

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def register(key: str):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = fn
        return fn
    return deco


def _parts(cat: Catalog) -> retrieve.Parts:
    """The tables that ``kb.documents`` joins."""
    return retrieve.Parts(kb.document_attrs(cat), kb.vector_ids(cat))


def _budget(spark: SparkSession, sf_dir: str, ties: bool) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    docs, parts = kb.documents(cat, with_body=False), _parts(cat)
    if ties:
        docs, parts = kb.ties(cat, with_body=False), retrieve.Parts(*map(kb.twice, parts))
    out = retrieve.budget_search(req, kb.datasets(cat), docs, parts=parts)
    return out.select("query_id", "rank", "id", "word_count", "cumulative_words",
                      F.round("distance", 6).alias("distance"))


@register("budget_search")
def budget_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir, ties=False)


@register("budget_search_ties")
def budget_search_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budget(spark, sf_dir, ties=True)


def _search_hits(spark: SparkSession, sf_dir: str):
    cat = Catalog(spark, sf_dir)
    req = validate.accepted(validate.search_requests(kb.queries(cat)))
    docs = kb.documents(cat, with_body=False)
    return cat, req, retrieve.topk_search(req, kb.datasets(cat), docs)


@register("vector_distance")
def vector_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    q = kb.queries(cat).withColumn("dataset", validate.default_if_empty(F.col("dataset"), D.DEFAULT_DATASET))
    resolved = retrieve.resolve_datasets(q, kb.datasets(cat))
    # one row per query: how many documents it was compared with, and their nearest, farthest and mean distance
    pairs = retrieve.score_pairs(resolved, kb.documents(cat, with_body=False), broadcast_queries=False)
    return pairs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("distance"), 6).alias("nearest"),
                                         F.round(F.max("distance"), 6).alias("farthest"), F.round(F.avg("distance"), 6).alias("mean"))


@register("word_count")
def word_count_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return cat.documents.select("doc_id", word_count("text").alias("word_count"))


@register("topk_single")
def topk_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-request form: first accepted search request, k = 5."""
    cat = Catalog(spark, sf_dir)
    req = validate.accepted(validate.search_requests(kb.queries(cat)))
    one = retrieve.resolve_datasets(req, kb.datasets(cat)).orderBy("query_id").limit(1)
    docs = kb.documents(cat, with_body=False)
    pairs = docs.select("id", "dataset_id", "vector").join(
        F.broadcast(one.select("dataset_id", "query_vector")), "dataset_id")
    best = (pairs.where(F.size("vector") == F.size("query_vector"))
            .select("id", l2_distance("vector", "query_vector").alias("distance"))
            .orderBy("distance", "id").limit(D.DEFAULT_TOP_K))
    out = kb.document_attrs(cat, with_body=False).select("id", "title", "url").join(F.broadcast(best), "id")
    return out.select("id", "title", "url", F.round("distance", 6).alias("distance"))


@register("topk_search")
def topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, _, ranked = _search_hits(spark, sf_dir)
    out = retrieve.attach(ranked, kb.document_attrs(cat, with_body=False), ("title", "url"))
    return out.select("query_id", "rank", "id", "title", "url", F.round("distance", 6).alias("distance"))


@register("budget_search_stored")
def budget_search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget retrieval over the written store: bucketed tables, one folder per dataset."""
    cat = Catalog(spark, sf_dir)
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    at = store.write(kb.documents(cat))
    try:
        hits = retrieve.budget_search(req, kb.datasets(cat), at.vectors)
        out = retrieve.attach(hits, at.texts, ("title",))
        return staged(out.select("query_id", "rank", "id", "title", "word_count", "cumulative_words", F.round("distance", 6).alias("distance")), "stored-hits")
    finally:
        at.drop()


@register("topk_pruned")
def topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k over the stored block index: blocks that cannot hold a winner are not read."""
    cat = Catalog(spark, sf_dir)
    req = validate.accepted(validate.search_requests(kb.queries(cat)))
    path = fresh_path(spark, "block-index")
    block_index.build(kb.documents(cat, with_body=False), path)
    hits, _ = block_index.search(req, kb.datasets(cat), spark, path)
    return hits.select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@register("search_response_json")
def search_response_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat, req, ranked = _search_hits(spark, sf_dir)
    hits = retrieve.attach(ranked, kb.document_attrs(cat), ("title", "url", "body"))
    return context.search_responses(req, hits)


@register("document_json")
def document_json_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return context.documents_json(kb.document_attrs(cat))


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    kept = retrieve.budget_search(req, kb.datasets(cat), kb.documents(cat, with_body=False), parts=_parts(cat))
    hits = retrieve.attach(kept, kb.document_attrs(cat), ("dataset_id", "title", "url", "body"))
    return context.build_prompts(req, hits)


@register("build_prompts")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prompts(spark, sf_dir)


@register("extract_citations")
def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.extract_citations(kb.replies(Catalog(spark, sf_dir)))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return context.resolve_citations(kb.replies(cat), kb.context(cat), scope="dataset_id").select("reply_id", "response")


@register("resolve_citations")
def resolve_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir)


@register("answer_json")
def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.answer_json(_resolved(spark, sf_dir))


AS_OF = "2002-02-13 00:00:00"
TEST_SECRET = "not a secret"


def _float(x: float | None):
    return F.array(F.lit(x).cast("float"))


def planted_queries(cat: Catalog) -> DataFrame:
    """kb queries with bad vectors planted: a NaN, NULL or infinite element, another dimension."""
    i, v = F.col("query_id") % 19, F.col("query_vector")
    bad = (F.when(i == 4, F.concat(v, _float(float("nan")))).when(i == 5, F.concat(v, _float(None)))
           .when(i == 6, F.concat(v, _float(float("inf")))).when(i == 7, F.slice(v, 1, 32)).otherwise(v))
    return kb.queries(cat).withColumn("query_vector", bad)


@register("validate_queries")
def validate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards and defaults, plus the dimension rule: an otherwise accepted
    request whose vector length no document of its dataset has is rejected."""
    cat = Catalog(spark, sf_dir)
    req = validate.answer_requests(planted_queries(cat))
    dims = retrieve.dimension_errors(validate.accepted(req), kb.datasets(cat),
                                     kb.documents(cat, with_body=False)).withColumnRenamed("error", "_dim_error")
    out = req.join(dims, "query_id", "left")
    return out.select("query_id", "dataset", "word_limit",
                      F.coalesce(F.col("error"), F.col("_dim_error")).alias("error"))


def search_urls(cat: Catalog) -> DataFrame:
    """GET request URLs built from the benchmark passages (every row)."""
    i = F.col("item_id")
    limit = (F.when(i % 7 == 0, F.lit("&limit=7")).when(i % 7 == 1, F.lit("&limit=%2B7"))
             .when(i % 7 == 2, F.lit("&limit=+7")).when(i % 7 == 3, F.lit("&limit=7x"))
             .when(i % 7 == 4, F.lit("")).when(i % 7 == 5, F.lit("&limit=0"))
             .otherwise(F.lit("&limit=3000000000")))
    # raw characters, an invalid escape before a good value, a repeated key, an escaped newline
    extra = (F.when(i % 8 == 1, F.lit("|{x}")).when(i % 8 == 2, F.lit("&query=second"))
             .when(i % 8 == 3, F.lit("&limit=7%0A")).otherwise(F.lit("")))
    first = F.when(i % 8 == 4, F.lit("/query?query=%zz&query=")).when(i % 8 == 5, F.lit("/query?a;b=1&query=")).otherwise(F.lit("/query?query="))
    ds = F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("&dataset=ds"), (i % 4).cast("string")))
    q = F.when(i % 9 == 0, F.lit("")).otherwise(F.url_encode("text"))
    return cat.benchmark.select(i.alias("request_id"),
                                F.concat(first, q, extra, limit, ds).alias("url"))


@register("parse_query_urls")
def parse_query_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = validate.parse_search_urls(search_urls(Catalog(spark, sf_dir)))
    return parsed.select("request_id", "query", "k", "dataset", "error")


@register("live_access_tokens")
def live_access_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth.live_per_user(kb.access_tokens(Catalog(spark, sf_dir)), AS_OF)


@register("issue_tokens")
def issue_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a fixed secret, so that they can be compared; a deployment's is drawn per run."""
    return auth.issue_tokens(kb.users(Catalog(spark, sf_dir)), AS_OF, secret=TEST_SECRET)


@register("authorize_requests")
def authorize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return auth.authorize(kb.requests(cat), kb.access_tokens(cat), AS_OF)


@register("unauthorized_requests")
def unauthorized_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return auth.unauthorized(kb.requests(cat), kb.access_tokens(cat), AS_OF)


@register("authorize_at_request_time")
def authorize_at_request_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request judged at its own time: the same token is good for some of its requests and expired for others."""
    cat = Catalog(spark, sf_dir)
    return auth.authorize_at(kb.timed_requests(cat), kb.token_lifetimes(cat))


@register("session_messages")
def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sessions.session_messages(kb.messages(Catalog(spark, sf_dir)))
    return out.select("session_id", "n", "messages")


def session_changes(cat: Catalog) -> DataFrame:
    """Save log: every turn re-saves its session (version = turn) with the
    turn's lines as the whole message array and a model that changes."""
    m = kb.messages(cat)
    conv = F.col("session_id").cast("long")
    return m.select(F.col("session_id").alias("id"),
                    ((conv + F.col("turn")) % 5 + 1).alias("user_id"),
                    F.split("content", "\n", -1).alias("messages"),
                    F.concat(F.lit("model-"), (F.col("turn") % 3).cast("string")).alias("model"),
                    F.col("turn").alias("version"))


@register("session_upsert")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions.upsert(None, session_changes(Catalog(spark, sf_dir)))
    return s.select("id", "user_id", "model", F.array_join("messages", "\n").alias("messages"), "version")


def session_lookup_requests(cat: Catalog) -> DataFrame:
    c = F.col("conv_id")
    sid = (F.when(c % 7 == 0, F.concat(F.lit("x"), c.cast("string")))
           .when(c % 11 == 0, F.lit("")).otherwise(c.cast("string")))
    # every conversation row looks up its session
    return cat.conversations.select(c.alias("request_id"), "turn", sid.alias("session_id"))


@register("session_lookup")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    s = sessions.upsert(None, session_changes(cat))
    out = sessions.lookup(session_lookup_requests(cat), s)
    return out.select("request_id", "turn", "session_id", "found", "model",
                      F.array_join("messages", "\n").alias("messages"), "error")


@register("assign_session_ids")
def assign_session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = kb.messages(Catalog(spark, sf_dir)).select("session_id").distinct()
    return sessions.assign_ids(ids, "session_id", salt="quarry")


def doc_items(cat: Catalog) -> DataFrame:
    """Add-document request bodies built from every document (url omitted
    for every fifth, as an encoder with omitempty does)."""
    d = cat.documents
    i = F.col("doc_id")
    title = F.concat(F.lit("Document "), i.cast("string")).alias("title")
    ds = F.concat(F.lit("ds"), (i % 4).cast("string")).alias("dataset")
    url = F.concat(F.lit("https://kb.example/"), F.col("lang"), F.lit("/"), i.cast("string")).alias("url")
    item = (F.when(i % 5 == 0, F.to_json(F.struct(title, F.col("text").alias("body"), ds)))
            .otherwise(F.to_json(F.struct(title, url, F.col("text").alias("body"), ds))))
    return d.select(i.alias("request_id"), F.floor(i / 4).cast("long").alias("batch_id"), item.alias("item"))


def doc_payloads(cat: Catalog) -> DataFrame:
    """Single-document requests: every 13th malformed (a stray '{bad '
    before the whole body), every 17th an empty object, the rest as built."""
    i = F.col("request_id")
    payload = (F.when(i % 13 == 0, F.concat(F.lit("{bad "), F.col("item")))
               .when(i % 17 == 0, F.lit("{}")).otherwise(F.col("item")))
    return doc_items(cat).select("request_id", "batch_id", payload.alias("payload"))


@register("decode_documents")
def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.decode_documents(doc_payloads(Catalog(spark, sf_dir)))
    return out.select("request_id", "title", "url", "body", "dataset", "status")


def typed_payloads(cat: Catalog) -> DataFrame:
    """Requests as clients get them wrong: names in capitals, numbers and lists for strings, nulls, no object at all."""
    d = cat.documents
    i = F.col("doc_id")
    title, body, ds = F.concat(F.lit("Document "), i.cast("string")), F.col("text"), F.concat(F.lit("ds"), (i % 4).cast("string"))
    made = lambda *fields: F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    payload = (F.when(i % 9 == 0, made(title.alias("TITLE"), body.alias("Body"), ds.alias("dataSet")))
               .when(i % 9 == 1, made(i.alias("title"), body.alias("body")))
               .when(i % 9 == 2, made(title.alias("title"), F.lit(None).cast("string").alias("body"), ds.alias("dataset")))
               .when(i % 9 == 3, F.lit("null")).when(i % 9 == 4, F.concat(F.lit("["), made(body.alias("body")), F.lit("]")))
               .when(i % 9 == 5, made(title.alias("title"), F.array(body).alias("body")))
               .when(i % 9 == 6, made(title.alias("title"), body.alias("body"), F.struct(i.alias("title")).alias("more")))
               .when(i % 9 == 7, F.concat(made(body.alias("body")), F.lit("}")))
               .otherwise(made(title.alias("title"), (i % 2 == 0).alias("url"), body.alias("body"))))
    return d.select(i.alias("request_id"), payload.alias("payload"))


@register("decode_documents_typed")
def decode_documents_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.decode_typed(typed_payloads(Catalog(spark, sf_dir)))
    return out.select("request_id", "title", "url", "body", "dataset", "status")


@register("bulk_ingest_status")
def bulk_ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = doc_items(Catalog(spark, sf_dir))
    # every document, in batches of four items; every tenth batch is malformed
    # (a stray ",}" before the closing bracket, all items kept whole)
    batches = p.groupBy("batch_id").agg(context.ordered_join_sep("request_id", "item", ",").alias("items"))
    tail = F.when(F.col("batch_id") % 10 == 3, F.lit(",}]")).otherwise(F.lit("]"))
    body = F.concat(F.lit("["), F.col("items"), tail)
    items = ingest.decode_bulk(batches.select("batch_id", body.alias("payload")))
    good = items.where("position > 0")
    # items go on one by one: embedded (the vector of their document), given a dataset and an id
    cat = Catalog(spark, sf_dir)
    req = good.select((F.col("batch_id") * 4 + F.col("position") - 1).alias("request_id"), (F.col("batch_id") % 5 + 1).alias("user_id"),
                      "title", "url", "body", "dataset", F.md5("body").alias("body_md5"))
    done = ingest.ingest(req, ingest_inputs(cat)[1], kb.datasets(cat), keep=("title", "url", "body_md5"))["results"]
    named = done.select(F.floor(F.col("request_id") / 4).cast("long").alias("batch_id"), (F.col("request_id") % 4 + 1).cast("int").alias("position"),
                        "title", "url", "body_md5", "dataset", "dataset_id", "id", "status")
    refused = items.where("position = 0").select(
        "batch_id", "position", "title", "url", F.md5("body").alias("body_md5"), "dataset", F.lit(None).cast("long").alias("dataset_id"),
        F.lit(None).cast("long").alias("id"), "status")
    return named.unionByName(refused)


def planted_vector(i, v):
    """An embedding, or a bad one: empty, with a NaN, NULL or infinite element, of another dimension."""
    return (F.when(i == 7, F.array().cast("array<float>")).when(i == 8, F.concat(F.slice(v, 1, 63), _float(float("nan"))))
            .when(i == 9, F.concat(F.slice(v, 1, 63), _float(None)))
            .when(i == 11, F.concat(F.slice(v, 1, 63), _float(float("inf")))).when(i == 12, F.slice(v, 1, 32)).otherwise(v))


def vector_digest(v):
    """All elements of a vector, to six places, as one value."""
    return F.md5(F.array_join(F.transform(v, lambda x: F.round(x.cast("double") * 1000000).cast("long").cast("string")), ","))


def ingest_inputs(cat: Catalog):
    d = cat.documents
    i = F.col("doc_id")
    ds = (F.when(i % 6 == 0, F.lit("")).when(i % 9 == 0, F.concat(F.lit("new"), (i % 3).cast("string")))
          .otherwise(F.concat(F.lit("ds"), (i % 4).cast("string"))))
    req = d.select(i.alias("request_id"), (i % 5 + 1).alias("user_id"),
                   F.concat(F.lit("Document "), i.cast("string")).alias("title"),
                   F.lit("").alias("url"), F.col("text").alias("body"), ds.alias("dataset"))
    e = cat.embeddings
    vec = e.select(F.col("vec_id").alias("request_id"),
                   planted_vector(F.col("vec_id") % 50, F.col("embedding")).alias("vector"))
    return req, vec


@register("dataset_get_or_create")
def dataset_get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    req, vec = ingest_inputs(cat)
    res = ingest.ingest(req, vec, kb.datasets(cat))["resolved"]
    return res.select("id", "name", "user_id", "created")


@register("ingest_documents")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    req, vec = ingest_inputs(cat)
    # digests are taken where the texts and vectors are read: neither is moved
    req = req.withColumns({"body_md5": F.md5("body"), "word_count": word_count("body")})
    out = ingest.ingest(req, vec, kb.datasets(cat), keep=("title", "url", "body_md5", "word_count"))["results"]
    digests = vec.select("request_id", F.when(F.col("vector").isNotNull() & ~has_bad_element("vector"), vector_digest(F.col("vector"))).alias("vector_md5"))
    ok = F.col("id").isNotNull()
    return out.join(digests, "request_id", "left").select(
        "request_id", "user_id", "dataset", "dataset_id", "status", "id", "title", "url", "body_md5", "word_count",
        F.when(ok, F.col("dim")).alias("dim"), F.when(ok, F.col("vector_md5")).alias("vector_md5"))


@register("cascade_delete")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    gone = kb.datasets(cat).where(F.col("user_id") == 3)
    left = ingest.cascade_delete(kb.document_attrs(cat, with_body=False), gone)
    return left.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))


@register("cascade_update")
def cascade_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User 2's datasets get new ids; their documents follow."""
    cat = Catalog(spark, sf_dir)
    moved = kb.datasets(cat).where(F.col("user_id") == 2).select(F.col("id").alias("old_id"), (F.col("id") + 1000).alias("new_id"))
    docs = ingest.cascade_update(kb.document_attrs(cat, with_body=False), moved)
    return docs.select("id", "dataset_id")


def planted_documents(cat: Catalog) -> DataFrame:
    """kb documents plus planted violations: every 50th re-inserted under a
    dataset that does not exist (duplicate id, dangling key), every 97th
    copied with half its vector (mixed dimensions), every 89th copied with a
    NaN or NULL element."""
    kd = kb.documents(cat)
    dup = kd.where(F.col("id") % 50 == 1).withColumn("dataset_id", F.col("dataset_id") + 100)
    half = (kd.where(F.col("id") % 97 == 5)
            .withColumn("id", F.col("id") + 5000000)
            .withColumn("vector", F.slice("vector", 1, 32)))
    bad = kd.where(F.col("id") % 89 == 4).withColumn("id", F.col("id") + 7000000).withColumn(
        "vector", planted_vector(8 + F.col("id") % 2, F.col("vector")))
    return kd.unionByName(dup).unionByName(half).unionByName(bad)


def planted_sessions(cat: Catalog) -> DataFrame:
    """The saved sessions, with every 40th saved twice and every 41st without a model."""
    s = sessions.upsert(None, session_changes(cat)).select("id", "user_id", "messages", "model")
    i = F.col("id").cast("long")
    s = s.withColumn("model", F.when(i % 41 != 0, F.col("model")))
    return s.unionByName(s.where(i % 40 == 0))


@register("constraint_report")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    return integrity.constraint_report(kb.datasets(cat), planted_documents(cat), kb.users(cat),
                                       kb.access_tokens(cat), planted_sessions(cat))


@register("constraint_report_incremental")
def constraint_report_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tables in three batches; each is checked against the counts of those before. Parents may come after their children."""
    cat = Catalog(spark, sf_dir)
    tables = [(kb.datasets(cat), "id"), (planted_documents(cat), "id"), (kb.users(cat), "id"), (kb.access_tokens(cat), "id"), (planted_sessions(cat), "id")]
    tables = [(staged(df, "planted"), key) for df, key in tables]
    counters, totals = constraints.empty(spark)
    for part in range(3):
        new = [df.where(F.coalesce(F.pmod(F.xxhash64(key), F.lit(3)), F.lit(0)) == part) for df, key in tables]
        touched, totals = constraints.update(counters, totals, constraints.batch_counters(*new))
        counters = constraints.merged(counters, touched)
    return totals


# Job configuration (the deployment supplies its own system prompt).
SYSTEM_PROMPT = "Answer the question using only the search results above."
HASH_DIM = 64


@register("chat_requests")
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _prompts(spark, sf_dir)
    return p.select("query_id", inference.chat_request(F.col("prompt"), SYSTEM_PROMPT).alias("payload"))


@register("search_word_requests")
def search_word_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = kb.queries(Catalog(spark, sf_dir))
    return q.select("query_id", inference.search_words_request(F.col("query")).alias("payload"))


@register("embedding_requests")
def embedding_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = kb.queries(Catalog(spark, sf_dir))
    return q.select("query_id", inference.embedding_request(F.col("query")).alias("payload"))


def chat_bodies(cat: Catalog) -> DataFrame:
    """Model server replies built from the assistant replies; every tenth
    has no choices, every tenth+1 is not JSON."""
    r = kb.replies(cat)
    i = F.col("conv_id")
    ok = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"),
                                                      F.col("response").alias("content")).alias("message")))
                            .alias("choices")))
    body = F.when(i % 10 == 0, F.lit('{"choices":[]}')).when(i % 10 == 1, F.lit("not json")).otherwise(ok)
    return r.select("reply_id", body.alias("body"))


@register("parse_chat_responses")
def parse_chat_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = chat_bodies(Catalog(spark, sf_dir))
    content, error = inference.parse_chat_response(F.col("body"))
    return b.select("reply_id", content.alias("content"), error.alias("error"))


def embedding_bodies(cat: Catalog) -> DataFrame:
    e = cat.embeddings
    i = F.col("vec_id")
    ok = F.to_json(F.struct(F.array(F.struct(F.col("embedding").alias("embedding"))).alias("data")))
    body = (F.when(i % 10 == 0, F.lit('{"data":[]}')).when(i % 10 == 1, F.lit('{"data":'))
            .when(i % 10 == 2, F.replace(ok, F.lit("]}]}"), F.lit(",null]}]}"))).otherwise(ok))
    return e.select("vec_id", body.alias("body"))


@register("parse_embedding_responses")
def parse_embedding_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = embedding_bodies(Catalog(spark, sf_dir))
    vec, error = inference.parse_embedding_response(F.col("body"))
    return b.select("vec_id", F.when(vec.isNotNull(), F.size(vec)).alias("dim"), vector_digest(vec).alias("vector_md5"), error.alias("error"))


@register("embed_lookup")
def embed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cat = Catalog(spark, sf_dir)
    vectors = cat.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    out = embed.lookup(cat.documents.select("doc_id"), vectors, "doc_id", "embedding")
    return out.select("doc_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dim"),
                      F.when(F.col("vector").isNull(), F.lit("could not get document embedding"))
                      .alias("error"))


@register("hash_embedding")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.token_buckets(Catalog(spark, sf_dir).documents, "doc_id", "text", HASH_DIM)


def upload_files(cat: Catalog) -> DataFrame:
    """Each page as an uploaded file: named after its URL's last path
    segment plus a suffix that cycles through cases; size scaled from the
    page's bytes so that some pass and some exceed the cap."""
    p = cat.pages
    ext = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".Pdf", ".txt", "")]),
                       (F.col("page_id") % 5 + 1).cast("int"))
    name = F.concat(F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1), ext)
    # every 23rd without a name, every 29th without a size
    return p.select("page_id", F.when(F.col("page_id") % 23 != 0, name).alias("name"),
                    F.when(F.col("page_id") % 29 != 0, F.octet_length("html").cast("long") * 2048).alias("length"))


@register("intake_gate")
def intake_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intake.intake_gate(upload_files(Catalog(spark, sf_dir)))
    return out.select("page_id", "name", "length", "accepted", "reason")


@register("page_text")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spread(Catalog(spark, sf_dir).pages)
    return p.select("page_id", intake.html_text(F.col("html")).alias("text"))


@register("page_text_extracted")
def page_text_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as uploaded files: bytes through the per-file extractor."""
    files = Catalog(spark, sf_dir).pages.select(F.col("page_id").cast("string").alias("path"), F.encode("html", "UTF-8").alias("content"))
    out = intake.extract_text(files, intake.html_extractor)
    return out.select(F.col("path").cast("long").alias("page_id"), "text", "error")


def query_bodies(cat: Catalog) -> DataFrame:
    """POST /query bodies built from every conversation turn: with and without
    a limit (0, NULL, absent), a model, a dataset; every 13th malformed."""
    c = cat.conversations
    i = F.col("conv_id") * 3 + F.col("turn")
    query = F.when(i % 11 == 0, F.lit("")).otherwise(F.col("text"))
    ds = F.when(i % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("ds"), (i % 4).cast("string")))
    model = F.when(i % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("model-"), (i % 3).cast("string")))
    fields = [query.alias("query"), F.col("conv_id").cast("string").alias("session_id"), model.alias("model"), ds.alias("dataset")]
    limit = (F.when(i % 6 == 0, F.lit(0)).when(i % 6 == 1, F.lit(None)).when(i % 6 == 2, F.lit(3_000_000_000)).otherwise(i % 700)).cast("long")
    body = F.when(i % 7 == 0, F.to_json(F.struct(*fields))).otherwise(
        F.to_json(F.struct(*fields, limit.alias("limit")), {"ignoreNullFields": "false"}))
    return c.select("conv_id", "turn", F.when(i % 13 == 0, F.concat(F.lit("{bad "), body)).otherwise(body).alias("payload"))


@register("decode_query_requests")
def decode_query_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate.decode_query_requests(query_bodies(Catalog(spark, sf_dir)))
    return out.select("conv_id", "turn", "query", "session_id", "word_limit", "model", "dataset", "error")


def citing_client():
    """A deterministic stand-in for the model server: it cites the first
    document of its prompt and one that is not there, and fails on every
    question of a length divisible by nine."""
    import json
    import re

    def client(payloads):
        out = []
        for p in payloads:
            prompt = json.loads(p)["messages"][-1]["content"]
            if len(prompt) % 9 == 0:
                out.append('{"choices":[]}')
                continue
            first = re.search(r'"id":([0-9]+)', prompt)
            text = f"n={len(prompt)} [citation]{first.group(1)}[/citation]" if first else f"n={len(prompt)} none"
            out.append(json.dumps({"choices": [{"message": {"role": "assistant", "content": text + " [citation]0[/citation]\\n."}}]}))
        return out

    return client


@register("answer_questions")
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole answer path over every query, with a deterministic client."""
    cat = Catalog(spark, sf_dir)
    return answer.answer_questions(planted_queries(cat), kb.datasets(cat), kb.documents(cat, with_body=False), citing_client, SYSTEM_PROMPT,
                                   parts=_parts(cat))


@register("rewrite_turns_once")
def rewrite_turns_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rewriting of every conversation turn through a ledger: a text that many turns repeat is asked once."""
    turns = Catalog(spark, sf_dir).conversations.select(F.struct("conv_id", "turn").alias("key"), "text")
    payloads = turns.select("key", inference.search_words_request(F.col("text")).alias("payload"))
    raw = ledger.run_model(payloads, "payload", citing_client, "key", fresh_path(spark, "ledger"))
    content, parse_err = inference.parse_chat_response(F.col("response"))
    return raw.select("key.conv_id", "key.turn", content.alias("search_words"), F.coalesce(F.col("error"), parse_err).alias("error"))


@register("rewrite_queries")
def rewrite_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query rewriting of every query, with the same client."""
    return answer.rewrite_queries(kb.queries(Catalog(spark, sf_dir)), citing_client)


def _stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's input, output and progress."""
    import uuid

    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


SLICES = 3


def _in_slices(df: DataFrame, slice_no, path: str, kind: str) -> int:
    """Writes ``df`` as files slice by slice (0 to SLICES - 1), so that a stream takes a slice per
    micro-batch or several; the number of files of a slice."""
    files = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    for i in range(SLICES):
        df.where(F.coalesce(slice_no, F.lit(0)) == i).repartition(files).write.mode("append").format(kind).save(path)
    return files


STREAM_REQUEST_SCHEMA = "request_id long, user_id long, title string, url string, body string, dataset string"


@register("stream_ingest")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ingest request through the streaming job; its stored documents."""
    cat = Catalog(spark, sf_dir)
    req, vec = ingest_inputs(cat)
    at = _stream_folder(spark)
    # in order of request_id, as ids follow arrival
    most = req.agg(F.max("request_id")).first()[0] or 0
    files = _in_slices(req, F.least(F.floor(F.col("request_id") * SLICES / (most + 1)), F.lit(SLICES - 1)), f"{at}/in", "json")
    embedder = lambda batch: batch.select("request_id").join(vec, "request_id")
    jobs.start_ingest(spark, f"{at}/in", STREAM_REQUEST_SCHEMA, embedder, f"{at}/store", f"{at}/progress", max_files_per_trigger=files).awaitTermination()
    docs = spark.read.schema(jobs.DOCUMENT_SCHEMA).parquet(f"{at}/store/documents")
    return docs.select("request_id", "id", "title", F.md5("body").alias("body_md5"), "word_count", vector_digest(F.col("vector")).alias("vector_md5"))


def _late_saves(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """The save log as files, the odd versions last: half of the saves come late. (folder, files per slice)"""
    at = _stream_folder(spark)
    late = F.when(F.col("version") % 4 == 2, F.lit(0)).when(F.col("version") % 2 == 0, F.lit(1)).otherwise(F.lit(2))
    return at, _in_slices(session_changes(Catalog(spark, sf_dir)), late, f"{at}/in", "json")


@register("stream_session_upsert")
def stream_session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session save through the streaming job, in several micro-batches and out of order; the sessions it left."""
    at, files = _late_saves(spark, sf_dir)
    jobs.start_session_upsert(spark, f"{at}/in", at, f"{at}/progress", max_files_per_trigger=files, compact_every=2).awaitTermination()
    return jobs.read_sessions(spark, at).select("id", "user_id", "model", F.array_join("messages", "\n").alias("messages"), "version")


@register("stream_session_state")
def stream_session_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same saves through keyed state: first owner and last save of each session."""
    at, files = _late_saves(spark, sf_dir)
    session_state.start(spark, f"{at}/in", at, f"{at}/progress", max_files_per_trigger=files).awaitTermination()
    return session_state.read(spark, at).select("id", "user_id", "model", F.array_join("messages", "\n").alias("messages"), "version")


@register("stream_standing_budget")
def stream_standing_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every budget query standing, while the documents arrive in several micro-batches."""
    cat = Catalog(spark, sf_dir)
    at = _stream_folder(spark)
    docs = kb.documents(cat).select("id", "dataset_id", "body", "vector")
    files = _in_slices(docs, F.col("id") * 7 % SLICES, f"{at}/in", "parquet")
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    queries = standing.resolved(req, kb.datasets(cat), "word_limit")
    stream_standing.start(spark, f"{at}/in", "id long, dataset_id long, body string, vector array<float>", queries, at, f"{at}/progress",
                          max_files_per_trigger=files).awaitTermination()
    return stream_standing.read(spark, at).select("query_id", "rank", "id", "word_count", "cumulative_words", F.round("distance", 6).alias("distance"))


@register("stream_answers")
def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query through the streaming answer job, with the deterministic client."""
    cat = Catalog(spark, sf_dir)
    at = _stream_folder(spark)
    files = _in_slices(planted_queries(cat), F.col("query_id") % SLICES, f"{at}/in", "parquet")
    schema = "query_id long, query string, query_vector array<float>, user_id long, dataset string, word_limit long"
    jobs.start_answering(spark, f"{at}/in", schema, kb.datasets(cat), kb.documents(cat, with_body=False), f"{at}/out", f"{at}/progress",
                         client_factory=citing_client, system_prompt=SYSTEM_PROMPT, max_files_per_trigger=files, parts=_parts(cat)).awaitTermination()
    return spark.read.parquet(f"{at}/out/answers").select("query_id", "json", "error")
