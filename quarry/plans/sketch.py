"""Fixed-size membership sketches: which rows may match a set of keys.

A sketch is at most ``SLOTS`` rows of (slot, 64 bits), 2 MiB, whatever the
number of keys. That bound is why it may be broadcast. It has no false
negatives, so a scan filtered by it loses nothing; what passes by chance is
sorted out by the join that follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 17
SLOT, BITS = "__sketch_slot", "__sketch_bits"


def _slot(key: str):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS)).cast("int")


def _bit(key: str):
    return F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64(`{key}`), 32), 64) as int))")


def key_sketch(keys: DataFrame, key: str) -> DataFrame:
    """(slot, bits) of the keys in a column."""
    return keys.select(_slot(key).alias(SLOT), _bit(key).alias("__sketch_bit")).groupBy(SLOT).agg(F.bit_or("__sketch_bit").alias(BITS))


def maybe_in(df: DataFrame, sketch: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key may be in the sketch (a superset of those that are)."""
    return (df.withColumn(SLOT, _slot(key)).join(F.broadcast(sketch), SLOT, "inner")
            .where(F.col(BITS).bitwiseAND(_bit(key)) != 0).drop(SLOT, BITS))


def flagged(df: DataFrame, sketch: DataFrame, key: str, flag: str) -> DataFrame:
    """``df`` with a column that is false where the key is surely not in the sketch."""
    return (df.withColumn(SLOT, _slot(key)).join(F.broadcast(sketch), SLOT, "left")
            .withColumn(flag, F.coalesce(F.col(BITS).bitwiseAND(_bit(key)) != 0, F.lit(False))).drop(SLOT, BITS))
