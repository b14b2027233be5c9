"""Embedders that return a vector column.

* ``lookup``: join to a precomputed vector table (a missing row = failure).
* ``hashed_bag_of_words``: a deterministic embedding from SQL functions
  only (md5 bucket + sign per token), usable with no model at all.
* any model: ``operators.inference.run_model`` + ``parse_embedding_response``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.defaults import WORD_SPLIT_PATTERN
from quarry.plans.parallel import spread


def lookup(requests: DataFrame, vectors: DataFrame, key: str, vector_col: str = "vector") -> DataFrame:
    """requests + ``vector`` (NULL when the table has no row for the key)."""
    v = vectors.select(key, F.col(vector_col).alias("vector"))
    return requests.join(v, key, "left")


def token_buckets(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """(id, bucket, value): signed token counts per md5 bucket, non-zero only.

    Tokens explode inside the task that holds the document, and the
    aggregate combines map-side, so the shuffle carries at most ``dim`` rows
    per document whatever the text length.
    """
    tokens = F.filter(F.split(F.lower(F.col(text_col)), WORD_SPLIT_PATTERN, -1), lambda t: t != "")
    t = spread(df.select(id_col, text_col)).select(id_col, F.explode(tokens).alias("tok"))
    t = t.withColumn("h", F.md5("tok"))
    bucket = (F.conv(F.substr("h", F.lit(1), F.lit(8)), 16, 10).cast("long") % dim).cast("int")
    sign = F.when(F.conv(F.substr("h", F.lit(9), F.lit(1)), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    agg = t.groupBy(id_col, bucket.alias("bucket")).agg(F.sum(sign).cast("long").alias("value"))
    return agg.where(F.col("value") != 0)


def hashed_bag_of_words(df: DataFrame, id_col: str, text_col: str, dim: int) -> DataFrame:
    """Dense unit-length float vectors from :func:`token_buckets` (one row per id).

    Each group holds at most ``dim`` bucket rows, so collecting it is bounded.
    """
    b = token_buckets(df, id_col, text_col, dim)
    dense = b.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "value"))).alias("m"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                      lambda i: F.coalesce(F.element_at("m", i), F.lit(0)).cast("double"))
    with_raw = dense.select(id_col, raw.alias("v"))
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-12))
    return with_raw.select(id_col, F.transform("v", lambda x: (x / norm).cast("float")).alias("vector"))


def with_model(df: DataFrame, key_col: str, text_col: str, client_factory, model=None) -> DataFrame:
    """(key, vector, error) from a model server client (batched, one per partition)."""
    from quarry.operators import inference

    req = df.select(key_col, inference.embedding_request(F.col(text_col), model).alias("payload"))
    raw = inference.run_model(req, "payload", client_factory, key_col)
    vec, parse_err = inference.parse_embedding_response(F.col("response"))
    return raw.select(key_col, vec.alias("vector"), F.coalesce(F.col("error"), parse_err).alias("error"))
