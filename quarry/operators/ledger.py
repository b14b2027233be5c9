"""A ledger of model calls: every distinct payload is paid for once.

The ledger is a table (digest, response), digest being the SHA-256 of a payload.
A set of requests is reduced to its distinct payloads (combined in each task, so a
payload that a third of all requests repeat is a row or two), those of the ledger
are left out, and the rest is called in waves. A wave is a job of
small tasks (a call or two of ``CALL`` payloads each); its replies are appended to
the ledger as one commit. So a lost task repeats a call or two, a lost job the calls
of one wave, and a later run none that a finished wave has made.

Failed calls are not entered: their requests get the error, and a later run asks
again. Replies are joined back by digest.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import inference
from quarry.plans.scan import numbered
from quarry.plans.stage import staged

CALL = 32
WAVE = 100_000  # payloads of a job
SCHEMA = "digest string, response string"


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: digest, response; one row per digest."""
    try:
        return spark.read.schema(SCHEMA).parquet(f"{path}/wave=*").groupBy("digest").agg(F.min("response").alias("response"))
    except AnalysisException:
        return spark.createDataFrame([], SCHEMA)


def run_model(df: DataFrame, request_col: str, client_factory: Callable[[], Callable[[list[str]], list]],
              key_col: str, path: str, wave: int = WAVE) -> DataFrame:
    """As ``inference.run_model`` (key, response, error), through the ledger at ``path``.

    A payload that is null is asked as the empty one.
    """
    spark = df.sparkSession
    payload = F.coalesce(F.col(request_col), F.lit(""))
    keyed = df.select(F.col(key_col), F.sha2(payload, 256).alias("digest"), payload.alias("payload"))
    wanted = keyed.groupBy("digest").agg(F.first("payload").alias("payload"))
    new = staged(numbered(wanted.join(entries(spark, path), "digest", "left_anti"), [], [F.col("digest")], "place"), "ledger-new")
    failed = spark.createDataFrame([], "digest string, error string")
    for first in range(0, new.count(), wave):
        part = new.where((F.col("place") >= first) & (F.col("place") < first + wave))
        calls = part.repartition(max(1, -(-part.count() // CALL)), F.floor(F.col("place") / CALL))
        got = staged(inference.run_model(calls, "payload", client_factory, "digest", CALL), "ledger-replies")
        got.where("error is null").select("digest", "response").write.parquet(f"{path}/wave={uuid.uuid4().hex}")
        failed = failed.unionByName(got.where("error is not null").select("digest", "error"))
    return (keyed.drop("payload").join(entries(spark, path), "digest", "left").join(failed, "digest", "left")
            .select(key_col, "response", F.when(F.col("response").isNull(), F.col("error")).alias("error")))
