"""Helpers shared by the operators: tables and staged results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.plans.sketch import flagged, key_sketch, maybe_in
from quarry.plans.stage import fresh_path, staged  # noqa: F401 - for the operators


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Rows of a narrow stored table (about 100 bytes each at most) that may be broadcast: 20 MB.
FEW = 200_000


def are_few(stored: DataFrame) -> bool:
    """Whether a stored narrow table may be broadcast; its rows are counted."""
    return stored.count() <= FEW


def few(stored: DataFrame) -> DataFrame:
    """A stored narrow table, broadcast if its rows are counted to be few; else Spark deals both sides by key."""
    return F.broadcast(stored) if are_few(stored) else stored


#: Bytes of rows that Spark hands to a Python worker at once; the worker holds them twice, as Arrow and as Python strings.
BATCH_BYTES = 1 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose texts go to Python; the session's batches have ``BATCH_BYTES`` at most from now on (a lower limit stays)."""
    spark = df.sparkSession
    if not 0 < _bytes(spark.conf.get(BATCH_SETTING)) <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def _bytes(setting: str) -> int:
    """Bytes of a Spark setting such as 67108864b, 4m or 1gb; 0 if it can't be read."""
    m = re.fullmatch(r"(\d+)([kmgtp]?)b?", setting.strip().lower())
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ") if m else 0


ROW = "__row"


def text_hash(text: str = "text"):
    """128 bits of a text, as binary(16); null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def with_row_key(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``ROW``: one number (long) for each different (doc_id, text).

    It is the doc_id itself, but for rows without id and for all but the first
    text of an id: these get numbers above all ids, in order of id (null last)
    and text hash. Only ids are counted; texts are hashed and looked up for rows
    without id or of an id that occurs again; where they are scanned, in one
    pass, if the new numbers are few.
    """
    ids = docs.select(F.col("doc_id").alias("__id"))
    again = staged(ids.where("__id is not null").groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__id"), "repeated-ids")
    d = flagged(docs, key_sketch(again, "__id"), "doc_id", "__again").withColumn("__again", F.col("__again") | F.col("doc_id").isNull())
    seen = staged(d.where("__again").select(F.col("doc_id").alias("__id"), text_hash().alias("__text")).distinct(), "repeated-texts")
    first = seen.where("__id is not null").groupBy("__id").agg(F.min("__text").alias("__first"))
    later = seen.join(first, "__id").where("__text <> __first").select("__id", "__text")
    top = F.lit(docs.agg(F.greatest(F.max("doc_id").cast("long"), F.lit(0).cast("long")).alias("top")).first()["top"])
    extra = (seen.where("__id is null").unionByName(later).orderBy(F.asc_nulls_last("__id"), "__text")
             .withColumn("__number", top + 1 + F.monotonically_increasing_id()))
    extra = staged(extra, "row-keys")
    same_id, own = F.col("doc_id").eqNullSafe(F.col("__id")), F.col("doc_id").cast("long")
    if are_few(extra):
        found = d.join(F.broadcast(extra), same_id & (F.when(F.col("__again"), text_hash()) == F.col("__text")), "left")
        return found.select(*docs.columns, F.coalesce("__number", own).alias(ROW))
    found = d.where("__again").join(extra, same_id & (text_hash() == F.col("__text")), "left")
    return (d.where("not __again").select(*docs.columns, own.alias(ROW))
            .unionByName(found.select(*docs.columns, F.coalesce("__number", own).alias(ROW))))


def without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` (``with_row_key``) whose key is not in ``gone`` (doc_id), with all their columns but the key.

    Documents that surely stay are not moved: a fixed-size sketch of the keys
    that go picks out the few that must be looked up. If few go, all documents
    are looked up where they are scanned, in one pass.
    """
    cols = [c for c in keyed.columns if c != ROW]
    ids = staged(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    if are_few(ids):
        return keyed.join(F.broadcast(ids), F.col(ROW) == F.col("__gone"), "left_anti").select(*cols)
    marked = flagged(keyed, key_sketch(ids, "__gone"), ROW, "__maybe")
    looked_up = marked.where("__maybe").join(ids, F.col(ROW) == F.col("__gone"), "left_anti")
    return marked.where("not __maybe").unionByName(looked_up).select(*cols)
