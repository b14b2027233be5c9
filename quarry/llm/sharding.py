"""Placement by a hierarchical weighted hash tree.

A topology is a tree region -> rack -> shard with a weight on every leaf; a
node weighs what its leaves weigh. A key descends the tree: at each level every
child draws ``-ln(u) / weight`` with ``u`` a hash of (key, child's name), and
the smallest draw wins. Draws of one child depend on nothing but the key and
that child's own weight, so a change of weights moves keys only between the
changed child and its siblings, and only inside subtrees that hold a change.

``grown_topology`` opens a region of its own for every shard beyond ``base``.
Then all older nodes keep their weights, and the new shard takes rows only into
itself (law ``key``).

Everything is a column expression; one narrow shuffle numbers the slots. Slots
are dealt in (hash bucket, id) order: rows are numbered within (shard, bucket),
and the offsets of the buckets come from their counts, a table of at most
shards x ``BUCKETS`` rows. So no shard meets in one task.

Defined results: a null id is a key like any other; a null text has size 1 and
the CRC-32 of the empty text. Repeated rows go to one shard, in slots of their
own. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024
RACK, REGION = 4, 8  # shards in a rack, shards in a region


def grown_topology(shards: int, base: int = 16) -> dict:
    """{region: {rack: {shard: weight}}} of equal weights."""
    tree: dict = {}
    for s in range(shards):
        region, rack = (f"r{s // REGION}", f"k{s // RACK}") if s < base else (f"grown{s}", f"grown{s}")
        tree.setdefault(region, {}).setdefault(rack, {})[s] = 1.0
    return tree


def weight(node) -> float:
    return sum(map(weight, node.values())) if isinstance(node, dict) else float(node)


def draw(key: Column, path: str, w: float) -> Column:
    """An exponential draw with rate ``w``, from 53 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 53))) / F.lit(w)


def descend(key: Column, tree: dict, path: str = "") -> Column:
    """The shard that ``key`` reaches; children of weight 0 are never chosen."""
    live = [(name, child, weight(child)) for name, child in tree.items()]
    live = [x for x in live if x[2] > 0]
    if not live:
        raise ValueError(f"no weight below {path or 'the root'}")
    below = [descend(key, child, f"{path}/{name}") if isinstance(child, dict) else F.lit(int(name)) for name, child, _ in live]
    if len(live) == 1:
        return below[0]
    draws = [draw(key, f"{path}/{name}", w) for name, _, w in live]
    least = F.least(*draws)
    out = below[-1]
    for d, b in list(zip(draws, below, strict=True))[-2::-1]:
        out = F.when(d == least, b).otherwise(out)
    return out


def place(docs: DataFrame, topology: dict) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
                         descend(F.col("doc_id"), topology).cast("int").alias("shard"))
    return with_slots(placed)


def with_slots(placed: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard."""
    # rows of one id (null ids among them) are spread by their content
    keyed = placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(BUCKETS)).cast("int"))
    counts = keyed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = keyed.withColumn("_rank", F.row_number().over(within) - 1)
    return (numbered.join(F.broadcast(offsets), ["shard", "_bucket"])
            .withColumn("slot", (F.col("_offset") + F.col("_rank")).cast("long")).drop("_bucket", "_rank", "_offset"))


def sharded(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document, with where it goes when one more shard is added."""
    out = place(docs, grown_topology(shards))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      descend(F.col("doc_id"), grown_topology(shards + 1, base=shards)).cast("int").alias("grown_shard"))
