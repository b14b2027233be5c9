"""Question answering as one job: the whole request path, set-at-a-time.

validate -> word-budget retrieval -> prompts -> model (injected client,
``mapInPandas``) -> citation rewrite -> JSON. One row per request: its answer,
or the reason why it has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import context, inference, retrieve, validate


def answer_questions(requests: DataFrame, datasets: DataFrame, documents: DataFrame,
                     client_factory, system_prompt: str, dims: DataFrame | None = None, parts: retrieve.Parts | None = None) -> DataFrame:
    """query_id, json, error: one row per request.

    ``requests``: query_id, query, query_vector, user_id, dataset, word_limit
    and, if given, model. ``documents``: id, dataset_id, title, url, body,
    vector (and word_count); where it joins texts and vectors, ``parts`` names the two
    and it needs no body. The model's replies are read once, by one chain of
    operators, so every question is asked once and its text and links come from
    the same reply.
    """
    req = validate.answer_requests(requests)
    wrong = retrieve.dimension_errors(validate.accepted(req), datasets, documents, dims)
    req = req.join(wrong.withColumnRenamed("error", "_dim"), "query_id", "left").withColumn(
        "error", F.coalesce("error", "_dim")).drop("_dim")
    ok = validate.accepted(req)
    kept = retrieve.budget_search(ok, datasets, documents, parts=parts)
    hits = retrieve.attach(kept, documents, ("dataset_id", "title", "url", "body"), parts)
    prompts = context.build_prompts(ok, hits)
    model = F.col("model") if "model" in requests.columns else None
    payloads = prompts.select("query_id", inference.chat_request(F.col("prompt"), system_prompt, model).alias("payload"))
    raw = inference.run_model(payloads, "payload", client_factory, "query_id")
    content, parse_err = inference.parse_chat_response(F.col("response"))
    replies = raw.select(F.col("query_id").alias("reply_id"), content.alias("response"), F.coalesce(F.col("error"), parse_err).alias("error"))
    ctx = hits.select(F.col("query_id").alias("reply_id"), "id", "title", "url")
    answers = context.resolve_citations(replies, ctx)
    done = answers.select(F.col("reply_id").alias("query_id"),
                          F.when(F.col("error").isNull(), context.response_json("response")).alias("json"), "error")
    refused = validate.rejected(req).select("query_id", F.lit(None).cast("string").alias("json"), "error")
    return done.unionByName(refused)


def rewrite_queries(requests: DataFrame, client_factory, model=None) -> DataFrame:
    """query_id, search_words, error: every query rewritten by the model, called once."""
    payloads = requests.select("query_id", inference.search_words_request(F.col("query"), model).alias("payload"))
    raw = inference.run_model(payloads, "payload", client_factory, "query_id")
    content, parse_err = inference.parse_chat_response(F.col("response"))
    return raw.select("query_id", content.alias("search_words"), F.coalesce(F.col("error"), parse_err).alias("error"))
