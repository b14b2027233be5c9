"""Standing budget queries over a stream of documents.

Each micro-batch reads the state that the batch before it wrote and the new
documents, nothing else, and writes its own state. A replay reads the same
state and writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import standing
from quarry.streaming.jobs import _overwrite_partitions, _read_or_none


def _state(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The rows written by batch ``batch_id``; none if it is not there."""
    df = _read_or_none(spark, path, f"{schema}, batch_id long")
    if df is None:
        return spark.createDataFrame([], schema)
    return df.where(F.col("batch_id") == batch_id).drop("batch_id")


def update(batch: DataFrame, batch_id: int, queries: DataFrame, store: str) -> None:
    """One micro-batch of documents (id, dataset_id, body, vector)."""
    spark = batch.sparkSession
    winners = _state(spark, f"{store}/winners", standing.WINNERS, batch_id - 1)
    frontiers = _state(spark, f"{store}/frontiers", standing.FRONTIERS, batch_id - 1)
    kept, out = standing.update_budget(queries, winners, frontiers, batch)
    bid = F.lit(batch_id).cast("long")
    _overwrite_partitions(kept.withColumn("batch_id", bid), f"{store}/winners", "batch_id")
    _overwrite_partitions(out.withColumn("batch_id", bid), f"{store}/frontiers", "batch_id")


def start(spark: SparkSession, source: str, schema: str, queries: DataFrame, store: str, checkpoint: str,
          max_files_per_trigger: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Keeps the budget sets of ``queries`` (``operators.standing.resolved``) up to date with Parquet files of documents."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    out = (reader.parquet(source).writeStream.foreachBatch(lambda df, bid: update(df, bid, queries, store))
           .option("checkpointLocation", checkpoint))
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")
    return out.start()


def read(spark: SparkSession, store: str) -> DataFrame:
    """The winners after the last batch."""
    rows = spark.read.schema(f"{standing.WINNERS}, batch_id long").parquet(f"{store}/winners")
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.where(F.col("batch_id") == last).drop("batch_id")
