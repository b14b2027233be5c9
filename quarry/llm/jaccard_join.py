"""Jaccard join on n-grams by grouped prefixes.

A document's set is its distinct three-word shingles. Two sets link when
100 * intersection >= 90 * union; the result is the components of all links.

1. Counts of all shingles of the corpus, folded into a table of bounded size,
   put the shingles in one order: rare ones first, equal counts by hash. Any one
   order gives exact results; this one keeps frequent shingles out of prefixes.
2. Documents of equal sets are one class. A class keeps its prefix: two sets
   that link share a shingle among the first ``n - ceil(0.9 n) + 1`` of each
   (of the smaller set, ``n - ceil(180/190 n) + 1`` are enough).
3. Classes of identical prefix and size are collapsed into one group. Only
   prefix shingles that several groups hold go on.
4. Leaders. Within a group every member is compared with the group's smallest
   id; every group is compared with one other group: of the buckets (shingle,
   size band) that hold it, the leader that has the shingle earliest. Verified
   links are contracted to components.
5. The rest, exactly: pairs of groups, taken apart by component, that share a
   prefix shingle, are not in one component, and pass the size filter, the
   position filter and a bound from bit profiles. These are expanded to members.

Texts are moved only for pairs whose members' own profiles allow a link. A profile
has a bit per hash class, set if the class holds an odd number of the set's
shingles: two sets differ in at least as many shingles as their profiles in bits.
It has two bits a shingle at least; a short one travels with prefix shingles, for
a group as the bits that all and that any of its members have.

No pair is made of copies. The members of a group or a bucket meet their leader
first, one row each; only what stays in different components is paired.

Defined results: null and empty texts and texts without words have an empty set
and are linked with nothing. A document without id is not compared and has no
component. Rows of one id are one document for the links of others; each row has
the component of its own text. Other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing
from quarry.llm.common import staged
from quarry.llm.minhash import components
from quarry.llm.set_pairs import verified
from quarry.llm.shingles import shingle_sets
from quarry.plans.sketch import key_sketch, maybe_in

WORDS, PERCENT = 3, 90
LEAST_SLOTS, MOST_SLOTS = 1 << 16, 1 << 24  # of the table of counts: a byte each in the broadcast
SLOTS_PER_DOC = 16
SLOTS_PER_CHUNK = 1 << 14
PARTS = 16  # longs of a profile at least; a larger set has two bits a shingle or more
SHORT = 4  # longs that travel with a prefix shingle
_SEED, _ODD = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def level_of(counts: np.ndarray) -> np.ndarray:
    """A byte that grows with the count: small counts as they are, large ones by their logarithm."""
    return np.where(counts <= 128, counts, np.minimum(255, 128 + 4 * np.log2(np.maximum(counts, 1) / 128))).astype(np.uint8)


def slot_levels(docs: DataFrame, slots: int, words: int = WORDS) -> np.ndarray:
    """The level of each slot's count of shingles over all sets.

    Each task adds up a table of its own and hands it on in compressed chunks; a
    chunk's tables are summed as a stream. ``slots`` bytes come to the driver.
    """
    size = min(slots, SLOTS_PER_CHUNK)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(slots, np.uint32)
        for b in batches:
            for _, group in hashing.blocks(b.text):
                for s in shingle_sets([t.decode() for t in group], words):
                    np.add.at(total, (s & np.uint64(slots - 1)).astype(np.int64), np.uint32(1))
        for at in range(0, slots, size):
            if total[at:at + size].any():
                yield pd.DataFrame({"chunk": [at // size], "counts": [zlib.compress(total[at:at + size].tobytes(), 1)]})

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.chunk.tolist(), b["counts"]):
                own = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield pd.DataFrame({"chunk": list(sums), "levels": [level_of(x).tobytes() for x in sums.values()]})

    tables = docs.select("text").mapInPandas(count, "chunk long, counts binary")
    got = tables.repartition(slots // size, "chunk").mapInPandas(added, "chunk long, levels binary").toArrow().to_pydict()
    out = np.zeros(slots, np.uint8)
    for chunk, levels in zip(got["chunk"], got["levels"]):
        out[chunk * size:(chunk + 1) * size] = np.frombuffer(levels, np.uint8)
    return out


def profile(s: np.ndarray, parts: int) -> np.ndarray:
    """64 * parts bits: whether a hash class (the hash modulo their number) holds an odd number of elements."""
    odd = np.bincount((s & np.uint64(64 * parts - 1)).astype(np.int64), minlength=64 * parts) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def described(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, set_a, set_b (128 bits of the set), prefix, pre_a, pre_b (128 bits of it), profile, short."""
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << math.ceil(math.log2(1 + docs.count() * SLOTS_PER_DOC))))
    shared = docs.sparkSession.sparkContext.broadcast(slot_levels(docs, slots, words))

    def ends(s: np.ndarray) -> list[int]:
        return np.array([hashing.mix(s).sum(), (hashing.mix(s ^ _SEED) * _ODD).sum()]).view(np.int64).tolist()

    @F.pandas_udf("n long, set_a long, set_b long, prefix array<long>, pre_a long, pre_b long, profile array<long>, short array<long>")
    def describe(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        level = shared.value
        for batch in texts:
            out = []
            for s in shingle_sets(batch, words):
                n = len(s)
                if not n:
                    none = s.view(np.int64)
                    out.append((0, 0, 0, none, 0, 0, none, none))
                    continue
                first = n + (-percent * n // 100) + 1
                prefix = s[np.argsort(level[(s & np.uint64(slots - 1)).astype(np.int64)], kind="stable")[:first]]
                parts = max(PARTS, 1 << (2 * n // 64).bit_length())
                out.append((n, *ends(s), prefix.view(np.int64), *ends(prefix), profile(s, parts), profile(s, SHORT)))
            yield pd.DataFrame(out, columns=["n", "set_a", "set_b", "prefix", "pre_a", "pre_b", "profile", "short"])

    return docs.select(F.col("doc_id").cast("long"), describe("text").alias("s")).select("doc_id", "s.*")


def differing(a: str, b: str):
    """Bits in which two profiles differ; of lengths that differ, the longer is folded to half (sizes of pairs differ little)."""
    least = F.least(F.size(a), F.size(b))
    fold = lambda p: F.when(F.size(p) > least, F.zip_with(F.slice(p, F.lit(1), least), F.slice(p, least + 1, least), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(p))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _total(parts):
    out = F.lit(0)
    for p in parts:
        out = out + p
    return out


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = staged(described(docs, words, percent), "jaccard-sets")
    first = F.struct("prefix", "pre_a", "pre_b", "profile", "short")
    classes = staged(rows.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n")
                     .agg(F.min("doc_id").alias("rep"), F.first(first).alias("s")).select("set_a", "set_b", "n", "rep", "s.*"), "jaccard-classes")
    groups = staged(classes.groupBy("n", "pre_a", "pre_b").agg(F.min("rep").alias("g"), F.first("prefix").alias("prefix")), "jaccard-groups")
    members = staged(classes.join(groups.select("n", "pre_a", "pre_b", "g"), ["n", "pre_a", "pre_b"]).select("g", "rep", "n", "profile", "short"), "jaccard-members")

    # prefix shingles that several groups hold
    held = groups.select("g", "n", F.posexplode("prefix").alias("pos", "token"))
    several = staged(held.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token"), "jaccard-tokens")
    held = staged(maybe_in(held, key_sketch(several, "token"), "token").join(several, "token"), "jaccard-prefixes")

    def close(a: str, b: str):
        """Size filter and position filter of a shared shingle."""
        n_a, n_b, at_a, at_b = (F.col(x) for x in (f"n_{a}", f"n_{b}", f"pos_{a}", f"pos_{b}"))
        most = F.least(at_a, at_b) + F.least(n_a - at_a, n_b - at_b)
        return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & ((100 + percent) * most >= percent * (n_a + n_b))

    def within(differ, n_both):
        return (100 + percent) * differ <= (100 - percent) * n_both

    # one leader for each group
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).alias("band")
    leaders = held.groupBy("token", band).agg(F.min(F.struct("pos", "g", "n")).alias("l")).select(
        "token", "band", F.col("l.pos").alias("pos_l"), F.col("l.g").alias("leader"), F.col("l.n").alias("n_l"))
    offers = (held.select("token", "g", F.col("n").alias("n_g"), F.col("pos").alias("pos_g"), band).join(leaders, ["token", "band"])
              .where((F.col("g") != F.col("leader")) & close("g", "l")))
    chosen = offers.groupBy("g").agg(F.min(F.struct("pos_l", "leader")).alias("l")).select(F.col("l.leader").alias("a"), F.col("g").alias("b"))
    inside = members.where("g <> rep").select(F.col("g").alias("a"), F.col("rep").alias("b"))
    of = {x: members.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("profile").alias(f"profile_{x}")) for x in "ab"}
    n_both = F.col("n_a") + F.col("n_b")
    alike = within(F.abs(F.col("n_a") - F.col("n_b")), n_both) & within(differing("profile_a", "profile_b"), n_both)

    def verified_links(pairs: DataFrame) -> DataFrame:
        near = pairs.join(of["a"], "a").join(of["b"], "b").where(alike).select("a", "b")
        return staged(verified(staged(near, "jaccard-pairs"), docs, words, percent), "jaccard-links")

    links = verified_links(chosen.unionByName(inside))
    found = components(links)

    # groups by component; what links different ones
    labelled = staged(members.join(found.withColumnRenamed("doc", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "jaccard-labels")
    short = [F.col("short")[i] for i in range(SHORT)]
    parts = labelled.groupBy("g", "component", "n").agg(*[F.bit_and(p).alias(f"all{i}") for i, p in enumerate(short)], *[F.bit_or(p).alias(f"any{i}") for i, p in enumerate(short)])
    named = held.join(parts.drop("n"), "g").withColumn("part", F.struct("g", "component"))
    mixed = named.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    named = staged(named.join(mixed, "token").drop("g"), "jaccard-mixed")
    x, y = (named.select("token", *[F.col(c).alias(f"{c}_{s}") for c in named.columns if c != "token"]) for s in "xy")
    apart = _total(F.bit_count(F.col(f"all{i}_x").bitwiseAND(F.bitwise_not(f"any{i}_y")).bitwiseOR(
        F.col(f"all{i}_y").bitwiseAND(F.bitwise_not(f"any{i}_x")))) for i in range(SHORT))
    # the smaller set's prefix may be shorter
    n_y = F.col("n_y")
    needed = (100 + percent) * (n_y - F.col("pos_y")) >= 2 * percent * n_y
    larger = (F.col("n_x") > n_y) | ((F.col("n_x") == n_y) & (F.col("part_x") > F.col("part_y")))
    across = x.join(y, "token").where(larger & (F.col("component_x") != F.col("component_y")) & needed & close("x", "y") & within(apart, F.col("n_x") + n_y))
    across = across.select("part_x", "part_y").distinct()
    one, two = (parts.select("g", *[F.col(c).alias(f"{c}_{s}") for c in parts.columns if c != "g"]) for s in "xy")
    inner = one.join(two, "g").where((F.col("component_x") < F.col("component_y")) & within(apart, 2 * F.col("n_x")))
    inner = inner.select(*[F.struct("g", F.col(f"component_{s}").alias("component")).alias(f"part_{s}") for s in "xy"])
    part = F.struct("g", "component")
    held_by = {x: labelled.select(part.alias(f"part_{x}"), F.col("rep").alias(x)) for x in "xy"}
    expanded = (across.unionByName(inner).join(held_by["x"], "part_x").join(held_by["y"], "part_y")
                .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    more = verified_links(expanded)
    if more.limit(1).count():
        found = components(links.unionByName(more))
    own = (rows.join(classes.select("set_a", "set_b", "n", "rep"), ["set_a", "set_b", "n"], "left")
           .join(found.withColumnRenamed("doc", "rep"), "rep", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
