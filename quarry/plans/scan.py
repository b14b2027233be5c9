"""Distributed prefix sums and maxima over groups of any size.

A window over a whole group runs in one task. Here rows are dealt to ranges of
(group, order): a hot group spans many ranges, and rows of equal order (peers)
stay together, since a range partitioner sends equal keys to one range.

1. Each range adds up what it holds of each group (combined in its task).
2. Offsets: the sums of the group's earlier ranges, one narrow row for each
   (group, range). Only a hot group has more than a row or two.
3. Each range sums its own rows from its offset on.

The ranges are a staged table, so a task that is computed again sees the same
rows and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.stage import staged

RANGE = "__range"


def ranged(df: DataFrame, by: list[str], order: list[Column], ranges: int | None = None) -> DataFrame:
    """``df`` staged with the number of each row's range of (by, order)."""
    keys = [F.col(b) for b in by] + order
    dealt = df.repartitionByRange(ranges, *keys) if ranges else df.repartitionByRange(*keys)
    return staged(dealt.withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str] | None = None, place: str | None = None,
            ties: list[Column] | None = None, ranges: int | None = None, most: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running sums and the place of each row in its group.

    ``sums``: new column -> integer column summed over the group up to the row and
    its peers (the RANGE frame of ``order``). ``most``: new column -> column whose
    greatest value so far is taken, over the same frame. ``place``: a column with the
    row's place, from 0, by ``order`` and then ``ties``, which make the order total.
    """
    sums, most = sums or {}, most or {}
    r = ranged(df, by, order, ranges)
    held = r.groupBy(*by, RANGE).agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(v).alias(f"__sum_{c}") for c, v in sums.items()],
                                     *[F.max(v).alias(f"__max_{c}") for c, v in most.items()])
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(*by, RANGE, *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(x) for x in ["__rows", *(f"__sum_{c}" for c in sums)]],
                         *[F.max(f"__max_{c}").over(earlier).alias(f"__max_{c}") for c in most])
    joined = r.join(before, [*by, RANGE])
    here = Window.partitionBy(*by, RANGE)
    peers = here.orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    added = {c: (F.col(f"__sum_{c}") + F.sum(v).over(peers)).cast("long") for c, v in sums.items()}
    for c, v in most.items():
        here_most = F.max(v).over(peers)
        added[c] = F.when(F.col(f"__max_{c}").isNull() | (here_most > F.col(f"__max_{c}")), here_most).otherwise(F.col(f"__max_{c}"))
    if place:
        added[place] = (F.col("__rows") + F.row_number().over(here.orderBy(*order, *(ties or []))) - 1).cast("long")
    return joined.withColumns(added).select(*df.columns, *added)


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """``df`` with each row's place in its group, from 0, in a total order."""
    return running(df, by, order, place=name, ranges=ranges)
