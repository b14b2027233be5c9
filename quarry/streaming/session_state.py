"""Session saves as keyed streaming state.

The state of a session is its first owner (the user of the lowest version seen)
and its last save (the highest version). A save that comes late, early or twice
changes at most one of the two, so the sessions do not depend on the order of
arrival and equal the batch upsert of all saves.

Saves are combined in each task before they are dealt by session, so a hot
session reaches its state as a row or two per task. Each micro-batch writes the
sessions it touched to a folder of its own; a replay writes the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

SAVE_SCHEMA = "id string, user_id long, messages array<string>, model string, version long"
STATE_SCHEMA = "user_id long, first_version long, messages array<string>, model string, version long"
SESSION_SCHEMA = f"id string, {STATE_SCHEMA}"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _first(a: tuple, b: tuple) -> tuple:
    """The owner of two partial states: lowest version, then lowest user."""
    return min((a[1], a[0]), (b[1], b[0]))


def _text(messages) -> list:
    return [x or "" for x in messages] if messages is not None else []


def merge(a: tuple | None, b: tuple) -> tuple:
    """(user_id, first_version, messages, model, version) of two partial states."""
    if a is None:
        return b
    first, user = _first(a, b)
    last = max(a, b, key=lambda s: (s[4], _text(s[2]), s[3] or ""))
    return (user, first, *last[2:])


def _rows(b: pd.DataFrame) -> Iterator[tuple[str, tuple]]:
    for i, user, first, messages, model, version in zip(b["id"], b["user_id"], b["first_version"], b["messages"], b["model"], b["version"]):
        yield i, (int(user), int(first), None if messages is None else list(messages), model, int(version))


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per session of each batch of saves."""
    for b in batches:
        states: dict[str, tuple] = {}
        for i, s in _rows(b):
            states[i] = merge(states.get(i), s)
        yield pd.DataFrame([(i, *s) for i, s in states.items()], columns=["id", "user_id", "first_version", "messages", "model", "version"])


class Sessions(StatefulProcessor):
    """First owner and last save of a session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.session = handle.getValueState("session", STATE_SCHEMA)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.session.get()) if self.session.exists() else None
        before = state
        for b in rows:
            for _, s in _rows(b):
                state = merge(state, s)
        if state != before:
            self.session.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["id", "user_id", "first_version", "messages", "model", "version"])

    def close(self) -> None:
        pass


def current_sessions(saves: DataFrame) -> DataFrame:
    """A stream of saves -> a stream of the sessions that each micro-batch touched.

    Saves without id, user or version are refused upstream and left out here.
    """
    named = saves.where((F.coalesce("id", F.lit("")) != "") & F.col("version").isNotNull() & F.col("user_id").isNotNull())
    partial = named.withColumn("first_version", F.col("version")).mapInPandas(_combined, SESSION_SCHEMA)
    return partial.groupBy("id").transformWithStateInPandas(
        statefulProcessor=Sessions(), outputStructType=SESSION_SCHEMA, outputMode="update", timeMode="none")


def start(spark: SparkSession, source: str, store: str, checkpoint: str, max_files_per_trigger: int | None = None,
          available_now: bool = True) -> StreamingQuery:
    """Continuous session saves from JSON files; ``read`` gives the sessions.

    Keyed state of this kind needs the RocksDB provider; it is set for this stream
    alone (a stream keeps the settings it starts with).
    """
    reader = spark.readStream.schema(SAVE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def write(df: DataFrame, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store}/touched"))

    out = current_sessions(reader.json(source)).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    out = out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return out.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def read(spark: SparkSession, store: str) -> DataFrame:
    """The sessions: the row of the newest micro-batch that touched each."""
    rows = spark.read.schema(f"{SESSION_SCHEMA}, batch_id long").parquet(f"{store}/touched")
    cols = ["user_id", "first_version", "messages", "model", "version"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), "batch_id").alias("s")).select("id", "s.*")
