"""Chat sessions as tables: message arrays, last-write-wins upsert, lookups.

Upsert is an aggregate, not a window: ``max_by`` / ``min_by`` combine
map-side, so even a session holding a third of all changes reaches the
shuffle as one partial row per map task.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.plans.joins import lookup_join


def session_messages(turns: DataFrame, sep: str = "\n") -> DataFrame:
    """Turns -> one ordered message array per session.

    ``turns``: session_id, turn, content. Returns session_id, n, messages
    (the array joined with ``sep``) and ``message_array``.
    """
    agg = turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("turn", "content"))).alias("_items"))
    arr = F.transform("_items", lambda x: x["content"])
    return agg.select("session_id", "n", arr.alias("message_array"),
                      F.array_join(arr, sep).alias("messages"))


def upsert(current: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Last write wins per ``id``: messages and model from the highest version.

    ``user_id`` keeps the value of the lowest version ever seen (the service's
    conflict branch does not update it), which ``first_version`` tells: a save
    that comes late compares with it, not with the newest one. Inputs: id,
    user_id, messages, model, version; ``current`` has first_version too, else
    its owner stays. Rows with an empty id are rejected upstream (see
    :func:`rejected_saves`).
    """
    rows = changes.withColumn("first_version", F.col("version"))
    if current is not None:
        if "first_version" not in current.columns:
            current = current.withColumn("first_version", F.lit(-(1 << 63)).cast("long"))
        rows = current.unionByName(rows)
    rows = rows.where(F.coalesce(F.col("id"), F.lit("")) != "")
    latest = rows.groupBy("id").agg(
        F.max_by(F.struct("messages", "model"), "version").alias("_last"),
        F.min_by("user_id", "first_version").alias("user_id"),
        F.min("first_version").alias("first_version"),
        F.max("version").alias("version"))
    return latest.select("id", "user_id", F.col("_last.messages").alias("messages"),
                         F.col("_last.model").alias("model"), "version", "first_version")


def rejected_saves(changes: DataFrame) -> DataFrame:
    return (changes.where(F.coalesce(F.col("id"), F.lit("")) == "")
            .select("*", F.lit(D.ERR_EMPTY_SESSION).alias("error")))


def lookup(requests: DataFrame, sessions: DataFrame, id_col: str = "session_id", user_col: str | None = None) -> DataFrame:
    """Point lookups as a join: found flag, session fields, error for ''.

    The service finds a session by its id alone. With ``user_col`` (a column of
    the requests) only the session's owner finds it.
    """
    s = sessions.select(F.col("id").alias(id_col), "messages", "model", *([F.col("user_id").alias("_owner")] if user_col else []))
    out = lookup_join(requests, s, [id_col], "left")
    empty = F.coalesce(F.col(id_col), F.lit("")) == ""
    found = F.col("model").isNotNull() & ~empty
    if user_col:
        found = found & F.coalesce(F.col("_owner") == F.col(user_col), F.lit(False))
        out = out.withColumns({c: F.when(found, F.col(c)) for c in ("messages", "model")}).drop("_owner")
        found = F.col("model").isNotNull()
    return out.select(
        "*",
        found.alias("found"),
        F.when(empty, F.lit(D.ERR_EMPTY_SESSION)).alias("error"))


def assign_ids(df: DataFrame, key_col: str, salt: str | None = None) -> DataFrame:
    """Random-looking UUID v4 per key, stable under task retries.

    Derived from sha2(salt || key) with the version / variant bits set, so a
    recomputed partition yields the same ids; ``salt`` is drawn once per job.
    """
    salt = salt or secrets.token_hex(16)
    h = F.sha2(F.concat(F.lit(salt), F.col(key_col).cast("string")), 256)
    uuid = F.concat_ws("-", F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)),
                       F.concat(F.lit("4"), F.substr(h, F.lit(14), F.lit(3))),
                       F.concat(F.substr(F.lit("89ab"),
                                         (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1,
                                         F.lit(1)),
                                F.substr(h, F.lit(18), F.lit(3))),
                       F.substr(h, F.lit(21), F.lit(12)))
    return df.withColumn("uuid", uuid)
