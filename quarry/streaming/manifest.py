"""Compaction of batch folders behind a manifest.

A table of batches is ``<root>/batch_id=<n>``; later batches replace rows of
earlier ones by a fold. ``compact`` folds all batches up to one into a snapshot
folder and then adds a manifest: one small file that names the snapshot and the
batch it goes up to. Readers take the newest manifest, its snapshot, and the
batch folders after it (a partition filter), so reading costs the live rows and
the few batches not yet folded, not all batches ever written.

The snapshot is complete before its manifest is written, and the manifest is one
file that appears by one rename. A crash before that leaves a folder that nobody
reads; a crash after it changes nothing. A second compaction that has fewer
batches than the newest manifest is ignored by readers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Fold = Callable[[DataFrame], DataFrame]  # rows with batch_id -> the row that stays of each key, with its batch_id

MANIFEST = "upto long, snapshot string"


def _newest(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(batch, snapshot folder) of the newest manifest; (-1, None) without one."""
    try:
        row = spark.read.schema(MANIFEST).parquet(f"{root}-manifests").agg(F.max(F.struct("upto", "snapshot")).alias("m")).first()
    except AnalysisException:
        return -1, None
    return (row["m"]["upto"], row["m"]["snapshot"]) if row["m"] else (-1, None)


def live(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    """Rows (with batch_id) of the snapshot and the batches after it; None before the first batch."""
    upto, snapshot = _newest(spark, root)
    try:
        batches = spark.read.schema(schema).parquet(root).where(F.col("batch_id") > upto)
    except AnalysisException:
        return None
    return batches if snapshot is None else spark.read.schema(schema).parquet(snapshot).unionByName(batches)


def compact(spark: SparkSession, root: str, schema: str, fold: Fold, upto: int) -> None:
    """Folds everything up to batch ``upto`` (one that will not be replayed) into a new snapshot."""
    rows = live(spark, root, schema)
    if rows is None or upto <= _newest(spark, root)[0]:
        return
    snapshot = f"{root}-snapshots/{uuid.uuid4().hex}"
    fold(rows.where(F.col("batch_id") <= upto)).write.parquet(snapshot)
    spark.createDataFrame([(upto, snapshot)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}-manifests")
