"""Near-duplicate detection by fast similarity sketching.

Sketch. A document's set is its distinct five-word shingles. Round ``i`` hashes
every element into a bin with a value; a bin keeps the smallest (round, value).
Rounds go on until every bin is filled; from round ``t`` on, round ``t + j``
throws all elements into bin ``j``, so 2t rounds always fill the sketch. Two
sketches agree in a coordinate with the probability of the sets' similarity,
with the concentration of independent samples, and a large set needs one round.

Links. ``bands`` groups of ``rows`` coordinates are bucket keys. Two documents
at 0.75 share no bucket with probability (1 - 0.75^rows)^bands, 1e-6 as set.

1. Documents with equal sets are one class: the smallest id stands for it, and
   only representatives go on. No pair is made of copies.
2. Every document is compared, on full sets, with one leader: the smallest id of
   all its buckets. Links are contracted to components. Where a bucket's leader is
   still in another component, a document is compared with one more such leader.
3. In buckets that still hold several components, all members of different
   components are compared, so no link between different texts is lost. Pairs
   that can't be similar enough never leave the join: a set's profile has a bit
   for each of ``64 * PARTS`` hash classes, set if the class holds an odd number
   of its shingles. Two sets differ in at least as many shingles as their
   profiles differ in bits, which bounds their similarity from above.
4. Components of all links: smallest labels with pointer jumping. Each round is
   a written table in the shared folder; only a count comes to the driver.

Sketches, buckets and labels are narrow. Texts move only for documents that a
bucket pairs with another, through a sketch of their ids; a leader's text goes
once to each chunk of its members (``set_pairs``). Hot buckets are
pre-aggregated, and joins on them are split by the skew join.

Defined results: null text is empty; documents without words are linked with
nothing and are their own component. A document without id is not compared; its
component is null (``one_of_each`` compares it by a number of its own). Repeated
rows of one id are one document of that component. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import ROW, in_small_batches, staged, with_row_key, without
from quarry.llm.set_pairs import verified
from quarry.llm.shingles import WORDS, shingle_sets

PERCENT = 75
BANDS, ROWS = 72, 6
PARTS = 16  # longs of a profile
_BAND = np.random.default_rng(13).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.random.default_rng(11).integers(1, 1 << 63, 1, np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(12).integers(1, 1 << 63, 4 * BANDS * ROWS + 64, np.uint64)


def similarity_sketch(items: np.ndarray, t: int) -> np.ndarray:
    """t coordinates, each the smallest (round << 48 | value) thrown into it."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(t, empty, np.uint64)
    each = max(1, int(1.3 * t * np.log(t + 1) / len(items)))  # rounds thrown at once
    i = 0
    while i < 2 * t:
        r = np.arange(i, min(i + each, t if i < t else 2 * t))
        h = hashing.mix(items[None, :] ^ _SEEDS[r][:, None])
        bins = (h % np.uint64(t)).astype(np.int64) if i < t else np.broadcast_to((r - t)[:, None], h.shape)
        value = (r.astype(np.uint64) << np.uint64(48))[:, None] | (h >> np.uint64(16))
        np.minimum.at(out, bins.ravel(), value.ravel())
        if out.max() != empty:
            break
        i = int(r[-1]) + 1
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    mixed = (hashing.mix(sketch.reshape(bands, rows)) * _BAND[:rows]).sum(axis=1) + np.arange(bands, dtype=np.uint64)
    return hashing.mix(mixed).view(np.int64)


def sketched(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits of the whole set), bands, profile."""

    @F.pandas_udf("n_shingles long, set_a long, set_b long, bands array<long>, profile array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            out = []
            for s in shingle_sets(batch):
                if len(s):
                    ends = np.array([hashing.mix(s).sum(), (hashing.mix(s ^ _SEEDS[0]) * _C[0]).sum()]).view(np.int64)
                    odd = np.bincount((s % np.uint64(64 * PARTS)).astype(np.int64), minlength=64 * PARTS) & 1
                    profile = np.packbits(odd.astype(bool)).view(np.int64)
                    out.append((len(s), ends[0], ends[1], band_keys(similarity_sketch(s, bands * rows), bands, rows), profile))
                else:
                    out.append((0, 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)))
            yield pd.DataFrame(out, columns=["n_shingles", "set_a", "set_b", "bands", "profile"])

    return in_small_batches(docs).select("doc_id", sketch("text").alias("s")).select("doc_id", "s.*")


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the smallest id reachable over links (a, b); rounds go on until no label changes."""
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = staged(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component"))
                    .withColumnRenamed("a", "doc"), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("doc", "b").withColumnRenamed("component", "other"), "b")
                .groupBy("a").agg(F.min("other").alias("other")))
        least = labels.join(near, labels.doc == near.a).select(
            "doc", F.col("component").alias("old"), F.least("component", "other").alias("component"))
        jump = labels.select(F.col("doc").alias("component"), F.col("component").alias("jumped"))
        new = staged(least.join(jump, "component").select("doc", "old", F.least("component", "jumped").alias("component")), "labels")
        labels = new.select("doc", "component")
        if not new.where("old <> component").limit(1).count():
            return labels


def in_several(shared: DataFrame, found: DataFrame) -> DataFrame:
    """Members (key, doc, leader, component) of the buckets that hold several components, stored."""
    labelled = shared.join(found, "doc", "left").select("key", "doc", "leader", F.coalesce("component", "doc").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return staged(labelled.join(mixed.select("key"), "key"), "mixed")


def near_groups(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    sketches = staged(sketched(docs, bands, rows), "sketches")
    classes = staged(sketches.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
                     .agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "profile"), F.coalesce("doc_id", F.lit(0))).alias("s"))
                     .select("set_a", "set_b", "n_shingles", "rep", "s.*"), "classes")
    sizes = classes.where("rep is not null").select(F.col("rep").alias("doc"), F.col("n_shingles").alias("n"), "profile")
    keyed = classes.where("rep is not null").select(F.col("rep").alias("doc"), F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = staged(keyed.join(buckets.drop("members"), "key"), "buckets")

    # sets that differ in d shingles share (n_a + n_b - d) / 2 of (n_a + n_b + d) / 2
    differ = sum((F.bit_count(F.col("p_a")[i].bitwiseXOR(F.col("p_b")[i])) for i in range(1, PARTS)),
                 F.bit_count(F.col("p_a")[0].bitwiseXOR(F.col("p_b")[0])))
    differ = F.greatest(differ, F.abs(F.col("n_a") - F.col("n_b")))
    possible = (100 + percent) * differ <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    side = {c: sizes.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("profile").alias(f"p_{c}")) for c in "ab"}

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(side["a"], "a").join(side["b"], "b").where(possible).select("a", "b")
        return staged(verified(staged(near, "pairs"), docs, WORDS, percent), "links")

    # one leader for each document, then one of another component for those it did not link
    offers = shared.where("doc <> leader").groupBy("doc").agg(F.min("leader").alias("a")).select("a", F.col("doc").alias("b"))
    links = linked(offers)
    found = components(links)
    members = in_several(shared, found)
    leaders = members.where("doc = leader").select("key", "leader", F.col("component").alias("other"))
    offers = (members.join(leaders, ["key", "leader"]).where("component <> other").groupBy("doc").agg(F.min("leader").alias("a"))
              .select("a", F.col("doc").alias("b")))
    links = staged(links.unionByName(linked(offers)), "links")
    found = components(links)
    # what is left: all members of one bucket in different components
    members = in_several(shared, found)
    one = members.select("key", F.col("doc").alias("a"), F.col("component").alias("ca")).join(side["a"], "a")
    two = members.select("key", F.col("doc").alias("b"), F.col("component").alias("cb")).join(side["b"], "b")
    rest = one.join(two, "key").where(F.expr("a < b and ca <> cb") & possible).select("a", "b").distinct()
    more = staged(verified(staged(rest, "pairs"), docs, WORDS, percent), "links")
    if more.limit(1).count():
        found = components(links.union(more))
    rep = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = (sketches.join(classes.select("set_a", "set_b", "n_shingles", "rep"), ["set_a", "set_b", "n_shingles"], "left")
           .join(found.withColumnRenamed("doc", "rep"), "rep", "left"))
    return out.select("doc_id", "n_shingles", rep.alias("component_id"), F.col("doc_id").eqNullSafe(rep).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents that stay, one of each group, with all their columns.

    Rows without id are compared too, and so are the texts of one id; an id's
    first text stays before these.
    """
    docs = with_row_key(docs)
    return without(docs, near_groups(docs.select(F.col(ROW).alias("doc_id"), "text")).where(~F.col("kept")))
