"""Spread small under-split input before CPU-heavy per-row work.

A table of at most ``MAX_BYTES`` in fewer partitions than the cluster has cores
(one row group, a small file) would keep most cores idle through tokenising,
regex or distances; a round-robin repartition spreads it. Larger tables are
never moved: their splits are the reader's business
(``spark.sql.files.maxPartitionBytes``). Both figures come from the plan; no
job runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

MAX_BYTES = 1 << 30


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > MAX_BYTES:
        return df
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
