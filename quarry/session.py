"""Session helpers.

Library code never invents storage locations: anything that must survive
executor loss (checkpoints, staged tables) goes under the folder the
cluster names in ``spark.checkpoint.dir``. Only :func:`local_session`
(tests, bench, smoke runs) sets one, and only when it is unset.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Conf the engine relies on; cluster deployments set the same keys with
# cluster-sized values (shuffle partitions, broadcast threshold).
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "quarry") -> SparkSession:
    """Single-JVM session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in ENGINE_CONF.items():
        builder = builder.config(key, value)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
               .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="quarry-wh-")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        # Only for local runs: a cluster names a shared folder itself.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-ckpt-"))
    return spark


def cluster_conf(input_bytes: int, executor_cores: int = 4, executors: int = 1000) -> dict[str, str]:
    """Recommended session settings for a cluster reading ``input_bytes``.

    * scan splits of 512 MiB keep task counts manageable at 100 TB (~200k
      tasks) while a split still fits an executor core's memory;
    * initial shuffle partitions: at least twice the cores, at most 20,000
      (map x reduce bookkeeping on the driver grows with the product; only
      narrow rows are shuffled, see the README), then AQE coalesces toward
      256 MiB and splits skewed partitions;
    * the broadcast threshold equals the bound the probes prove
      (``plans.broadcast.DEFAULT_MAX_BYTES``), so Spark never broadcasts more
      on its own estimate than this library does on proof.
    """
    from quarry.plans.broadcast import DEFAULT_MAX_BYTES

    mib = 1024 * 1024
    cores = executor_cores * executors
    partitions = max(2 * cores, min(20_000, input_bytes // (512 * mib)))
    return {
        **{k: v for k, v in ENGINE_CONF.items() if k != "spark.ui.enabled"},
        "spark.sql.files.maxPartitionBytes": str(512 * mib),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mib),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * mib),
        "spark.sql.autoBroadcastJoinThreshold": str(DEFAULT_MAX_BYTES),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(DEFAULT_MAX_BYTES),
    }
