"""Exact duplicate removal by 128-bit content hash, with byte comparison.

Two documents are copies when their texts are identical once the ASCII white
space ``[\\x20\\x09-\\x0D]`` is deleted (``normalised``).

1. One pass over the texts stores the digests of every row (MD5, SHA-256, code
   points). The MD5 is counted: 16 bytes and a count per document are all that is
   shuffled, combined in each task first.
2. Only texts whose hash occurs twice or more are moved. They are grouped by
   (hash, text itself), so the grouping compares bytes, and texts that merely
   collide fall into different groups. A fixed-size sketch of the ids that hold a
   repeated hash keeps all other texts from being hashed again, one of the hashes
   out of this shuffle. Copies met in one task are combined before the shuffle.
3. Groups of two or more, a few narrow rows, are joined back on (MD5,
   SHA-256). A hot group is split by the skew join; no group is collected.

Defined results: null text is the empty text, and all empty texts are one
group. Null ids never stay if the group has an id. The stable id of a group is
that of the longest original text (code points), then the smallest. Repeated
rows with one id all carry the same result; ``dedup`` returns the id once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import are_few, staged
from quarry.plans.sketch import flagged, key_sketch, maybe_in

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, "")


def content_hash(col):
    """128 bits, as binary(16)."""
    return F.unhex(F.md5(col))


def digests(docs: DataFrame, hash_fn=content_hash) -> DataFrame:
    """doc_id, hash, text_sha256 of every row, stored."""
    norm = docs.select("doc_id", normalised().alias("norm"))
    return staged(norm.select("doc_id", hash_fn(F.col("norm")).alias("hash"), F.sha2("norm", 256).alias("text_sha256")), "digests")


def copy_groups(docs: DataFrame, hash_fn=content_hash, light: DataFrame | None = None) -> DataFrame:
    """Groups of two or more copies: hash, text_sha256, keep_id, group_size; ``light``: the ``digests``, if there already (only hashes are needed)."""
    light = staged(docs.select("doc_id", hash_fn(normalised()).alias("hash")), "hashes") if light is None else light
    repeated = staged(light.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated-hashes")
    ids = maybe_in(light.select("doc_id", "hash"), key_sketch(repeated, "hash"), "hash").join(repeated, "hash").select("doc_id")
    near = maybe_in(docs.select("doc_id", "text"), key_sketch(ids, "doc_id"), "doc_id")
    d = near.select("doc_id", normalised().alias("norm"), F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("points"))
    candidates = maybe_in(d.withColumn("hash", hash_fn(F.col("norm"))), key_sketch(repeated, "hash"), "hash")
    by_length = candidates.groupBy("hash", "norm", "points").agg(
        F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    # a null id sorts behind every id of its length, and behind shorter texts with an id
    best = F.struct(F.col("id").isNotNull(), F.col("points"), -F.col("id").cast("decimal(20,0)"), F.col("id").alias("id"))
    return (by_length.groupBy("hash", "norm")
            .agg(F.max(best).alias("best"), F.sum("n").alias("group_size"))
            .where("group_size > 1")
            .select("hash", F.sha2("norm", 256).alias("text_sha256"), F.col("best.id").alias("keep_id"), "group_size"))


def exact_groups(docs: DataFrame, hash_fn=content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    light = digests(docs, hash_fn)
    out = light.join(copy_groups(docs, hash_fn, light), ["hash", "text_sha256"], "left")
    grouped = F.col("group_size").isNotNull()
    keep = F.when(grouped, F.col("keep_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", keep.alias("keep_id"),
                      F.coalesce(F.col("group_size"), F.lit(1)).cast("long").alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Documents whose hash surely occurs once are not moved; the others look up
    their group by hash. Of several rows of a kept id the one with the longest text
    is returned; of these the last in order of all columns, whatever the partitions.
    """
    cols = docs.columns
    g = staged(copy_groups(docs).select(F.col("hash").alias("__hash"), F.col("text_sha256").alias("__sha"),
                                        F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size")), "copy-groups")
    d = flagged(docs.withColumn("__hash", content_hash(normalised())), key_sketch(g, "__hash"), "__hash", "__maybe")
    if are_few(g):  # looked up where they are scanned: one pass for all that is single
        joined = d.withColumn("__sha", F.when(F.col("__maybe"), F.sha2(normalised(), 256))).join(F.broadcast(g), ["__hash", "__sha"], "left")
        single = joined.where(F.col("__size").isNull()).select(*cols)
    else:
        joined = d.where("__maybe").withColumn("__sha", F.sha2(normalised(), 256)).join(g, ["__hash", "__sha"], "left")
        single = d.where("not __maybe").select(*cols).unionByName(joined.where(F.col("__size").isNull()).select(*cols))
    kept = joined.where(F.col("__size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("__keep")))
    row = F.struct(*cols)
    best = kept.groupBy("__hash", "__sha").agg(F.max_by(row, F.struct(F.coalesce(F.char_length("text"), F.lit(0)), F.to_json(row))).alias("__row"))
    return single.unionByName(best.select("__row.*"))
