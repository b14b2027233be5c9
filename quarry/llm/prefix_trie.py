"""Prefix trie of conversations, rolled up in bands of depth.

Every conversation ``c`` begins with the first ``h`` turns of conversation
``c - c % 100`` and goes on with its own turns after its first ``h``; a node is a
distinct sequence of first turns.

1. Turns are numbered by a distributed scan (``plans.scan``): only a digest and
   the length of a turn are moved, and one conversation may span many tasks.
2. A node's key is the hash of its turns, built from segments of ``HEIGHT``
   turns, segments of segments and so on: no task ever holds a whole
   conversation, and the depth costs a logarithm of rounds.
3. Nodes are counted by key; of a node stay its smallest member and its depth,
   which name it from here on.
4. Subtree sums. A node explodes only to its ancestors within its band of
   ``HEIGHT`` depths. The roots of all bands form a tree a ``HEIGHT``-th as deep,
   rolled up the same way; then the completed total of each band root is added
   to its ancestors in the band above. Rounds are logarithmic in the depth, the
   explosion is bounded by ``HEIGHT`` rows a node and round.
5. The digest of the conversations that end at a node reads them as a sorted
   stream of chunks, put together in parallel. No list of members is held.

Hot nodes (the root, a common first turn) are combined in each task before any
shuffle, and joins on them are split by the skew join.

Defined results: a null role or text is empty. Rows without conv_id belong to no
conversation. Turns of one number come in order of the digest of role and text;
repeated rows are turns of their own. An absent conversation gives no first turns.
An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import staged
from quarry.plans.scan import numbered

HEIGHT = 8  # depths of a band, and turns of a segment
SHARED = 100  # conversations that begin alike
MOST_SHARED = 5  # h is below 6
CHUNK = 4096  # ids hashed at once

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)


def digested(conversations: DataFrame) -> DataFrame:
    """c, turn, e, points: the digest and the length of each turn."""
    role, text = (F.coalesce(F.col(x), F.lit("")) for x in ("role", "text"))
    e = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    return (conversations.where(F.col("conv_id").isNotNull())
            .select(F.col("conv_id").cast("long").alias("c"), "turn", e.alias("e"), F.char_length(text).cast("long").alias("points")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """c, d, e, points, last: the d-th turn (from 1) of each rebuilt conversation, and its number of turns.

    ``turns``: c, pos, e, points. Each conversation also has a row of depth 0.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % (MOST_SHARED + 1)
    convs = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % SHARED).alias("s"))
    heads = (turns.where((F.col("c") % SHARED == 0) & (F.col("pos") < MOST_SHARED))
             .select(F.col("c").alias("s"), F.col("pos").alias("at"), "e", "points"))
    sizes = heads.groupBy("s").agg(F.count(F.lit(1)).alias("there"))
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    plan = staged(convs.join(sizes, "s", "left").select("c", "s", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("last")),
                  "trie-conversations")
    first = plan.join(heads, "s").where("at < h").select("c", (F.col("at") + 1).alias("d"), "e", "points", "last")
    own = turns.join(plan, "c").where("pos >= h").select("c", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("d"), "e", "points", "last")
    top = plan.select("c", F.lit(0).cast("long").alias("d"), F.lit("").alias("e"), F.lit(0).cast("long").alias("points"), "last")
    return top.unionByName(first).unionByName(own)


def prefix_keys(rows: DataFrame, most: int) -> DataFrame:
    """c, k, key: a hash of the elements 0 to k of each sequence.

    ``rows``: c, k, e, with k from 0 to at most ``most``.
    """
    along = Window.partitionBy("c", "segment").orderBy("k").rowsBetween(*UP_TO_HERE)
    inner = (rows.withColumn("segment", F.floor(F.col("k") / HEIGHT))
             .withColumn("inner", F.md5(F.concat_ws("", F.collect_list("e").over(along)))))
    if most < HEIGHT:
        return inner.select("c", "k", F.col("inner").alias("key"))
    inner = staged(inner.select("c", "k", "segment", "inner"), "trie-segments")
    whole = inner.where(F.col("k") % HEIGHT == HEIGHT - 1).select("c", F.col("segment").alias("k"), F.col("inner").alias("e"))
    before = prefix_keys(whole, most // HEIGHT).select("c", (F.col("k") + 1).alias("segment"), F.col("key").alias("before"))
    return inner.join(before, ["c", "segment"], "left").select("c", "k", F.md5(F.concat("inner", F.coalesce("before", F.lit("")))).alias("key"))


def subtree_sums(members: DataFrame, values: DataFrame, most: int, sums: list[str]) -> DataFrame:
    """m, k and each sum over a node's subtree.

    ``members``: c, k, m: conversation c belongs to the node (m, k), m its
    smallest member. ``values``: m, k and the node's own figures.
    """
    along = Window.partitionBy("c", "band").orderBy("k").rowsBetween(*UP_TO_HERE)
    of_band = members.withColumn("band", F.floor(F.col("k") / HEIGHT)).withColumn("path", F.collect_list("m").over(along))
    # the smallest member's path is its node's; it has the row below any band root of its own, too
    paths = staged(of_band.where((F.col("c") == F.col("m")) | (F.col("k") % HEIGHT == HEIGHT - 1)).select("c", "k", "m", "band", "path"), "trie-paths")

    def to_ancestors(rows: DataFrame) -> DataFrame:
        return (rows.select(F.posexplode("path").alias("up", "m"), "band", *sums)
                .select("m", (F.col("band") * HEIGHT + F.col("up")).alias("k"), *sums))

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("m", "k").agg(*[F.sum(s).alias(s) for s in sums])

    nodes = paths.where("c = m")
    inner = added(to_ancestors(nodes.select("m", "k", "band", "path").join(values, ["m", "k"])))
    if most < HEIGHT:
        return inner
    inner = staged(inner, "trie-bands")
    roots = inner.where(F.col("k") % HEIGHT == 0).withColumn("k", F.floor(F.col("k") / HEIGHT))
    tops = members.where(F.col("k") % HEIGHT == 0).withColumn("k", F.floor(F.col("k") / HEIGHT))
    complete = subtree_sums(tops, roots, most // HEIGHT, sums).where("k > 0")
    above = paths.select("c", "k", "band", "path")
    down = complete.select(F.col("m").alias("c"), (F.col("k") * HEIGHT - 1).alias("k"), *sums).join(above, ["c", "k"])
    return added(inner.unionByName(to_ancestors(down)))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one node's sorted ids as texts of at most CHUNK ids."""
    for b in batches:
        cut = ((b.m != b.m.shift()) | (b.d != b.d.shift())).cumsum()
        part = cut * (len(b) + 1) + b.groupby(cut).cumcount() // CHUNK
        yield (b.assign(ids=b.c.astype(str)).groupby(part, sort=False)
               .agg(m=("m", "first"), d=("d", "first"), c=("c", "first"), ids=("ids", ",".join)))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each node's chunks, one after the other."""
    node, h = None, None
    for b in batches:
        out = []
        for m, d, ids in zip(b.m.tolist(), b.d.tolist(), b.ids):
            if (m, d) == node:
                h.update(b"," + ids.encode())
                continue
            if node:
                out.append((*node, h.hexdigest()))
            node, h = (m, d), hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=["m", "d", "sha"])
    if node:
        yield pd.DataFrame([(*node, h.hexdigest())], columns=["m", "d", "sha"])


def id_digests(ends: DataFrame) -> DataFrame:
    """m, d, sha: SHA-256 of each node's sorted, comma-joined ids; ``ends``: m, d, c."""
    chunks = (ends.repartitionByRange("m", "d", "c").sortWithinPartitions("m", "d", "c")
              .mapInPandas(_chunks, "m long, d long, c long, ids string"))
    return (chunks.repartition("m", "d").sortWithinPartitions("m", "d", "c")
            .mapInPandas(_digests, "m long, d long, sha string"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = digested(conversations)
    turns = staged(numbered(turns, ["c"], [F.col("turn").asc_nulls_first(), F.col("e")], "pos").select("c", "pos", "e", "points"), "trie-turns")
    rows = staged(rebuilt(turns), "trie-rebuilt")
    most = rows.agg(F.max("d")).first()[0] or 0
    keys = prefix_keys(rows.where("d > 0").select("c", (F.col("d") - 1).alias("k"), "e"), max(most - 1, 0))
    keyed = rows.join(keys.select("c", (F.col("k") + 1).alias("d"), "key"), ["c", "d"], "left").select(
        "c", "d", "points", "last", F.coalesce("key", F.lit("")).alias("key"))
    keyed = staged(keyed, "trie-keys")
    at_end = F.col("d") == F.col("last")
    nodes = staged(keyed.groupBy("d", "key").agg(
        F.min("c").alias("m"), F.count(F.lit(1)).alias("n_convs"), F.first("points").alias("points"),
        F.count(F.when(at_end, F.lit(1))).alias("ends"), F.min(F.when(at_end, F.col("c"))).alias("end")), "trie-nodes")
    members = staged(keyed.select("c", "d", "key", "last").join(nodes.select("d", "key", "m", "ends"), ["d", "key"])
                     .select("c", "d", "m", "last", "ends"), "trie-members")
    parents = members.select(F.col("c").alias("m"), (F.col("d") + 1).alias("d"), F.col("m").alias("parent"))
    nodes = staged(nodes.join(parents, ["m", "d"], "left").select("m", "d", "parent", "n_convs", "points", "ends", "end"), "trie-parents")
    children = nodes.where("d > 0").groupBy(F.col("parent").alias("m"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(nodes.join(children, ["m", "d"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    own = nodes.select("m", F.col("d").alias("k"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("points")).alias("saved_tokens"))
    sums = subtree_sums(members.select("c", F.col("d").alias("k"), "m"), own, most, ["n_leaves", "saved_tokens"])
    shas = id_digests(members.where(at_end & (F.col("ends") > 1)).select("m", "d", "c"))
    out = nodes.join(sums.withColumnRenamed("k", "d"), ["m", "d"]).join(shas, ["m", "d"], "left")
    few = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256)  # no id or one
    return out.select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                      "n_leaves", "saved_tokens", F.coalesce("sha", few).alias("ends_sha256"))
