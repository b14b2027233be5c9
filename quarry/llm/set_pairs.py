"""Pairs of documents verified on their full shingle sets.

A pair is a leader and a member. The members' texts are dealt out by (leader,
chunk of its members) and read as a sorted stream behind the leader's text, so a
leader is shipped once for each ``CHUNK`` members, a hot leader's members are
spread over many tasks, and a task holds one batch of texts and one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import in_small_batches
from quarry.llm.shingles import shingle_sets
from quarry.plans.sketch import key_sketch, maybe_in

CHUNK = 64


def _similar(words: int, percent: int):

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader = None, []
        for batch in batches:
            out: list[tuple[int, int]] = []
            a, chunk, b, text = (batch.column(i) for i in range(4))
            texts = (t.as_py() for t in text)  # one block of them at a time becomes Python's
            for a, chunk, b, s in zip(a.to_pylist(), chunk.to_pylist(), b.to_pylist(), shingle_sets(texts, words)):
                if (a, chunk) != key:
                    key, leader = (a, chunk), []
                if b == a:  # texts of the leader stand first
                    leader.append(s)
                elif any(100 * both >= percent * (len(x) + len(s) - both) for x in leader if (both := len(np.intersect1d(x, s, assume_unique=True)))):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return similar


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b), a <> b, those similar enough on full sets. ``pairs`` is read more than once: hand over a stored table."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = maybe_in(docs.select(F.col("doc_id").cast("long"), "text"), key_sketch(ids, "doc_id"), "doc_id")
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1 << 20)).alias("dice"))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    dealt = dealt.join(sizes, "a").select("a", "b", (F.col("dice") % F.col("chunks")).alias("chunk"))
    leaders = dealt.select("a", "chunk").distinct().select("a", "chunk", F.col("a").alias("b"))
    rows = dealt.unionByName(leaders).join(texts.withColumnRenamed("doc_id", "b"), "b").withColumn("member", F.col("a") != F.col("b"))
    stream = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member").select("a", "chunk", "b", "text")
    return in_small_batches(stream).mapInArrow(_similar(words, percent), "a long, b long").distinct()
