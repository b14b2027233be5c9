"""Request defaults and argument guards (set-at-a-time).

Each request row gets its defaults filled in and an ``error`` column: NULL
for accepted rows, a reason otherwise. Rejected rows are a side output,
never silently dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.text import atoi_or, url_param
from quarry.functions.vectors import has_bad_element


def default_if_empty(c: Column, value: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(value))


def answer_requests(queries: DataFrame, default_limit: int = D.DEFAULT_WORD_LIMIT) -> DataFrame:
    """Defaults + guards for question answering (word budget).

    Input: query_id, query, query_vector, user_id, dataset, word_limit (nullable).
    Adds: dataset defaulted, word_limit defaulted, error.
    Guard order follows the service: empty query, then the vector, then the budget.
    """
    limit = F.coalesce(F.col("word_limit"), F.lit(default_limit)).cast("bigint")
    error = (F.when(F.coalesce(F.col("query"), F.lit("")) == "", F.lit(D.ERR_EMPTY_QUERY))
             .when(F.coalesce(F.size("query_vector"), F.lit(0)) <= 0, F.lit(D.ERR_EMPTY_VECTOR))
             .when(has_bad_element("query_vector"), F.lit(D.ERR_BAD_VECTOR))
             .when(limit <= 0, F.lit(D.ERR_BAD_BUDGET)))
    return (queries
            .withColumn("dataset", default_if_empty(F.col("dataset"), D.DEFAULT_DATASET))
            .withColumn("word_limit", limit)
            .withColumn("error", error))


def search_requests(queries: DataFrame, k_col: str | None = None,
                    default_k: int = D.DEFAULT_TOP_K) -> DataFrame:
    """Defaults + guards for plain top-k search. Adds ``k`` and ``error``."""
    k = (F.coalesce(F.col(k_col), F.lit(default_k)) if k_col else F.lit(default_k)).cast("bigint")
    error = (F.when(F.coalesce(F.col("query"), F.lit("")) == "", F.lit(D.ERR_EMPTY_QUERY))
             .when(F.coalesce(F.size("query_vector"), F.lit(0)) <= 0, F.lit(D.ERR_EMPTY_VECTOR))
             .when(has_bad_element("query_vector"), F.lit(D.ERR_BAD_VECTOR))
             .when(k <= 0, F.lit(D.ERR_BAD_K)))
    return (queries
            .withColumn("dataset", default_if_empty(F.col("dataset"), D.DEFAULT_DATASET))
            .withColumn("k", k)
            .withColumn("error", error))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNull()).drop("error")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("error").isNotNull())


QUERY_REQUEST_SCHEMA = "query string, session_id string, limit bigint, model string, dataset string"
CORRUPT = "_corrupt_record"


def decode_query_requests(raw: DataFrame, json_col: str = "payload", default_limit: int = D.DEFAULT_WORD_LIMIT) -> DataFrame:
    """POST /query bodies -> query, session_id, word_limit, model, dataset, error.

    Absent fields are empty; only an absent or null ``limit`` takes the
    default, 0 is a value (and is rejected by the budget guard). An empty
    model or dataset takes its default.
    """
    parsed = F.from_json(F.col(json_col), f"{QUERY_REQUEST_SCHEMA}, {CORRUPT} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    j = raw.withColumn("_j", parsed)
    bad = F.col("_j").isNull() | F.col(f"_j.{CORRUPT}").isNotNull()
    text = lambda f: F.when(~bad, F.coalesce(F.col(f"_j.{f}"), F.lit("")))
    limit = F.when(~bad, F.coalesce(F.col("_j.limit"), F.lit(default_limit)))
    error = (F.when(bad, F.lit(D.ERR_BAD_REQUEST))
             .when(text("query") == "", F.lit(D.ERR_EMPTY_QUERY))
             .when(limit <= 0, F.lit(D.ERR_BAD_BUDGET)))
    return j.select("*", text("query").alias("query"), text("session_id").alias("session_id"), limit.alias("word_limit"),
                    F.when(~bad, default_if_empty(F.col("_j.model"), D.DEFAULT_MODEL)).alias("model"),
                    F.when(~bad, default_if_empty(F.col("_j.dataset"), D.DEFAULT_DATASET)).alias("dataset"),
                    error.alias("error")).drop("_j")


def parse_search_urls(urls: DataFrame, url_col: str = "url",
                      default_k: int = D.DEFAULT_TOP_K) -> DataFrame:
    """GET /query?query=..&limit=..&dataset=.. -> query, k, dataset, error.

    ``limit`` must be a whole signed integer, anything else means the
    default; k <= 0 and an empty query are rejected.
    """
    q = url_param(url_col, "query")
    k = atoi_or(url_param(url_col, "limit"), default_k)
    ds = default_if_empty(url_param(url_col, "dataset"), D.DEFAULT_DATASET)
    error = (F.when(q == "", F.lit(D.ERR_EMPTY_QUERY))
             .when(k <= 0, F.lit(D.ERR_BAD_K)))
    return urls.select("*", q.alias("query"), k.alias("k"), ds.alias("dataset"), error.alias("error"))
