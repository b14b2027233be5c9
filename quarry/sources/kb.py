"""The knowledge-base tables, derived from the driver's parquet tables.

A deployment stores these tables itself (see ``operators.ingest``); for the
driver's data they are derived by the rules below, which are the same rules
the DuckDB oracle inlines as CTEs (``plans.oracle``). Each function returns a
lazy DataFrame over the whole input tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import Catalog


def _source_no(source_col="source"):
    # 'src12' -> 12
    return F.substr(F.col(source_col), F.lit(4)).cast("long")


def users(cat: Catalog) -> DataFrame:
    r = cat.region
    return r.select((F.col("r_regionkey").cast("long") + 1).alias("id"),
                    F.col("r_name").alias("username"),
                    (F.col("r_regionkey") != 4).alias("active"))


def datasets(cat: Catalog) -> DataFrame:
    n = cat.documents.select(_source_no().alias("n")).distinct()
    return n.select((F.col("n") + 1).alias("id"),
                    (F.col("n") % 5 + 1).alias("user_id"),
                    F.concat(F.lit("ds"), (F.col("n") % 4).cast("string")).alias("name"))


def documents(cat: Catalog, with_body: bool = True) -> DataFrame:
    """id, dataset_id, title, url, body, vector (only documents with a vector).

    With the body, the scan is spread over the cores when under-split (word
    counts and JSON over whole texts are the CPU-heavy part); without it the
    scan is left as it arrives.
    """
    d = (cat.spread("documents") if with_body else cat.documents).alias("d")
    e = cat.embeddings.alias("e")
    cols = [(F.col("d.doc_id") + 1).alias("id"),
            (_source_no("d.source") + 1).alias("dataset_id"),
            F.concat(F.lit("Document "), F.col("d.doc_id").cast("string")).alias("title"),
            F.when(F.col("d.doc_id") % 5 == 0, F.lit(""))
             .otherwise(F.concat(F.lit("https://kb.example/"), F.col("d.lang"), F.lit("/"),
                                 F.col("d.doc_id").cast("string"))).alias("url")]
    if with_body:
        cols.append(F.col("d.text").alias("body"))
    cols.append(F.col("e.embedding").alias("vector"))
    return d.join(e, F.col("e.vec_id") == F.col("d.doc_id"), "inner").select(*cols)


def document_attrs(cat: Catalog, with_body: bool = True) -> DataFrame:
    """id, dataset_id, title, url[, body] of every document (no vector join).

    For late materialisation: winners already passed the vector join, so
    their attributes come straight from the documents table.
    """
    d = cat.documents
    cols = [(F.col("doc_id") + 1).alias("id"), (_source_no() + 1).alias("dataset_id"),
            F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
            F.when(F.col("doc_id") % 5 == 0, F.lit(""))
             .otherwise(F.concat(F.lit("https://kb.example/"), F.col("lang"), F.lit("/"),
                                 F.col("doc_id").cast("string"))).alias("url")]
    if with_body:
        cols.append(F.col("text").alias("body"))
    return d.select(*cols)


def vector_ids(cat: Catalog) -> DataFrame:
    """id of every vector: with ``document_attrs`` the parts that ``documents`` joins."""
    return cat.embeddings.select((F.col("vec_id") + 1).alias("id"))


def twice(df: DataFrame) -> DataFrame:
    """Every row twice, the second copy's id offset by 1,000,000; ``copy`` tells them apart where ids meet."""
    return df.withColumn("copy", F.lit(0)).unionByName(df.withColumns({"id": F.col("id") + 1000000, "copy": F.lit(1)}))


def ties(cat: Catalog, with_body: bool = True) -> DataFrame:
    """Every document twice: same vector, same whole text, so every distance ties with its twin."""
    return twice(documents(cat, with_body)).drop("copy")


def queries(cat: Catalog) -> DataFrame:
    """query_id, query, query_vector, user_id, dataset, word_limit."""
    e = cat.embeddings.alias("e")
    b = cat.benchmark.alias("b")
    v = F.col("e.vec_id")
    key = (v * 7 + 3)
    return e.join(b, F.col("b.item_id") == v, "inner").select(
        v.alias("query_id"),
        F.col("b.text").alias("query"),
        F.col("e.embedding").alias("query_vector"),
        (key % 5 + 1).alias("user_id"),
        F.when(v % 13 == 0, F.lit("missing"))
         .when(v % 11 == 0, F.lit(""))
         .otherwise(F.concat(F.lit("ds"), (key % 4).cast("string"))).alias("dataset"),
        F.when(v % 3 == 0, F.lit(None).cast("bigint"))
         .when(v % 31 == 5, F.lit(3_000_000_000))
         .otherwise((F.lit(100) * (v % 17)).cast("bigint")).alias("word_limit"))


def access_tokens(cat: Catalog) -> DataFrame:
    last = (cat.orders.groupBy("o_custkey")
            .agg(F.max("o_orderdate").alias("last_order")))
    c = cat.customer
    return c.join(last, last.o_custkey == c.c_custkey, "inner").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_custkey") % 5 + 1).alias("user_id"),
        F.md5(F.col("c_custkey").cast("string")).alias("token"),
        (F.col("last_order").cast("timestamp_ntz") + F.expr("INTERVAL '1' YEAR")).alias("expiration"))


def requests(cat: Catalog) -> DataFrame:
    ev = cat.events
    tok = F.md5(F.col("user_id").cast("string"))
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("string"))
         .when(F.col("event_id") % 10 == 1, F.concat(F.lit("Token "), tok))
         .otherwise(F.concat(F.lit("Bearer "), tok)).alias("auth_header"))


def token_lifetimes(cat: Catalog) -> DataFrame:
    """Every order renews its customer's token for a year: token, user_id, issued, expiration."""
    o = cat.orders
    issued = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(F.md5(F.col("o_custkey").cast("string")).alias("token"), (F.col("o_custkey") % 5 + 1).alias("user_id"),
                    issued.alias("issued"), (issued + F.expr("INTERVAL '1' YEAR")).alias("expiration"))


def timed_requests(cat: Catalog) -> DataFrame:
    """The requests, their month of events stretched eighty times over the years of the orders: request_id, ts, auth_header."""
    r = requests(cat)
    seconds = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    at = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(seconds * 80).cast("decimal(18,6)"))
    return r.withColumn("ts", at)


def messages(cat: Catalog) -> DataFrame:
    return cat.conversations.select(F.col("conv_id").cast("string").alias("session_id"),
                                    "turn", "role", F.col("text").alias("content"))


def replies(cat: Catalog) -> DataFrame:
    """Every assistant turn: reply_id (conversation and turn), conv_id, the
    dataset its documents come from, response."""
    return cat.conversations.where(F.col("role") == "assistant").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("reply_id"), "conv_id",
        (F.col("conv_id") % 20 + 1).alias("dataset_id"),
        F.concat(F.col("text"), F.lit(" [citation]"), (F.col("conv_id") % 700 + 1).cast("string"),
                 F.lit("[/citation] and [citation]"), (F.col("conv_id") % 7 + 1).cast("string"),
                 F.lit("[/citation]")).alias("response"))


def context(cat: Catalog) -> DataFrame:
    """The documents a reply may cite are those of its dataset: dataset_id, id, title, url."""
    return documents(cat, with_body=False).select("dataset_id", "id", "title", "url")
