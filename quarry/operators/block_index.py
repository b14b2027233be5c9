"""Exact top-k with a stored block index: blocks that cannot hold a winner are not read.

Index. Each dataset's vectors are dealt to blocks around pivots, the vector's
nearest of at most ``MOST_PIVOTS`` documents (about the square root of the
dataset, taken by id hash, so any run picks the same). A block keeps its centre,
its radius and its number of vectors. Vectors are stored sorted by block, in
folders of ``BLOCKS_PER_FOLDER`` blocks, so that a search reads the folders of its
blocks alone (dynamic partition pruning).

Search. For a query at distance d from a centre, all vectors of the block lie
between d - radius and d + radius (triangle inequality).

1. The k nearest vectors lie within the smallest bound under which the blocks'
   upper limits count k vectors.
2. The blocks nearest to the query, until they hold k vectors, are compared; the
   k-th distance found is a tighter bound.
3. Of the other blocks only those whose lower limit is within the bound are
   compared. A block at the bound is read, so ties are ranked as in a full scan.

A small slack covers rounding. Nothing here is approximate: the result equals the
full scan's. Vectors with an element that is no finite number are in no block (a
full scan never returns them), and a query meets the blocks of its dimension.

A hot dataset is dealt out by salts before its vectors are assigned; a hot block
(many copies of a vector) is spread over many files and split by the skew join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import has_bad_element, l2_distance
from quarry.operators.retrieve import resolve_datasets
from quarry.plans.scan import numbered
from quarry.plans.stage import staged

MOST_PIVOTS = 256
GROUP_ROWS = 20_000  # vectors that one task assigns at once
BLOCKS_PER_FOLDER = 64
SLACK = 1e-9

ASSIGNED = "dataset_id long, dim int, pivot long, id long, vector array<float>, distance double"
ROWS = "block long, id long, vector array<float>, folder long"
BLOCKS = "block long, dataset_id long, dim int, center array<float>, radius double, n long"


def _nearest(key, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Each vector with its nearest pivot; of equal ones the smallest id."""
    if not len(rows):
        return pd.DataFrame([], columns=[c.split()[0] for c in ASSIGNED.split(", ")])
    pivots = pivots.sort_values("pivot")
    v, p = (np.stack(x.to_numpy()).astype(np.float64) for x in (rows.vector, pivots.center))
    nearest = np.empty(len(v), np.int64)
    distance = np.empty(len(v))
    for at in range(0, len(v), 1024):
        part = v[at:at + 1024]
        d = (part ** 2).sum(1)[:, None] + (p ** 2).sum(1)[None] - 2 * part @ p.T
        nearest[at:at + 1024] = d.argmin(1)
        distance[at:at + 1024] = np.sqrt(((part - p[nearest[at:at + 1024]]) ** 2).sum(1))
    return pd.DataFrame({"dataset_id": key[0], "dim": key[1], "pivot": pivots["pivot"].to_numpy()[nearest], "id": rows.id.to_numpy(),
                         "vector": rows.vector.to_numpy(), "distance": distance})


def build(documents: DataFrame, path: str) -> None:
    """Writes the index of ``documents`` (id, dataset_id, vector) to ``path``."""
    group = ["dataset_id", "dim"]
    v = documents.where("vector is not null").select("id", "dataset_id", F.size("vector").alias("dim"), "vector")
    v = v.where(~has_bad_element("vector") & (F.col("dim") > 0))
    sizes = staged(v.groupBy(*group).agg(F.count(F.lit(1)).alias("n")), "index-sizes")
    sizes = sizes.select(*group, F.least(F.lit(MOST_PIVOTS), F.ceil(F.sqrt("n"))).alias("most"), F.ceil(F.col("n") / GROUP_ROWS).alias("salts"))
    order = Window.partitionBy(*group).orderBy(F.xxhash64("id"), "id")
    pivots = v.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_PIVOTS)
    pivots = staged(pivots.join(sizes, group).where("place <= most").select(*group, F.col("id").alias("pivot"), F.col("vector").alias("center"), "salts"), "index-pivots")
    salted = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    rows = v.join(sizes.select(*group, "salts"), group).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).drop("salts")
    dealt = [*group, "salt"]
    assigned = staged(rows.groupBy(*dealt).cogroup(salted.groupBy(*dealt)).applyInPandas(_nearest, ASSIGNED), "index-assigned")
    held = assigned.groupBy(*group, "pivot").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n"))
    blocks = numbered(held, [], [F.col("dataset_id"), F.col("dim"), F.col("pivot")], "block")
    blocks = blocks.join(pivots.select(*group, "pivot", "center"), [*group, "pivot"])
    blocks.select("block", *group, "center", "radius", "n", "pivot").write.mode("overwrite").parquet(f"{path}/blocks")
    numbers = documents.sparkSession.read.parquet(f"{path}/blocks").select(*group, "pivot", "block")
    out = assigned.join(numbers, [*group, "pivot"]).select("block", "id", "vector", F.floor(F.col("block") / BLOCKS_PER_FOLDER).alias("folder"))
    (out.repartitionByRange("block", "id").sortWithinPartitions("block", "id")
     .write.mode("overwrite").partitionBy("folder").parquet(f"{path}/rows"))


def _compared(wanted: DataFrame, rows: DataFrame) -> DataFrame:
    """query_id, id, distance, k of every vector of the wanted (query, block)s."""
    return rows.join(wanted, ["folder", "block"]).select("query_id", "id", l2_distance("vector", "query_vector").alias("distance"), "k")


def _best(pairs: DataFrame) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= F.col("k"))


def search(requests: DataFrame, datasets: DataFrame, spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, work), stored: query_id, rank, id, distance of the ``k`` nearest; query_id, n_vectors, n_compared.

    ``requests``: query_id, query_vector, user_id, dataset, k (accepted ones).
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    q = resolve_datasets(requests.select("query_id", "query_vector", "user_id", "dataset", "k"), datasets)
    met = q.join(blocks, "dataset_id").where(F.col("dim") == F.size("query_vector"))
    d = l2_distance("center", "query_vector")
    met = met.select("query_id", "query_vector", "k", "block", F.floor(F.col("block") / BLOCKS_PER_FOLDER).alias("folder"), "n",
                     (d - F.col("radius") - SLACK * (1 + d)).alias("low"), (d + F.col("radius") + SLACK * (1 + d)).alias("high"))
    # at most MOST_PIVOTS blocks a query
    nearest = Window.partitionBy("query_id").orderBy("low", "block").rowsBetween(Window.unboundedPreceding, -1)
    by_high = Window.partitionBy("query_id").orderBy("high", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.withColumns({"before": F.coalesce(F.sum("n").over(nearest), F.lit(0)), "held": F.sum("n").over(by_high)})
    whole = Window.partitionBy("query_id")
    met = met.withColumns({"bound": F.coalesce(F.min(F.when(F.col("held") >= F.col("k"), F.col("high"))).over(whole), F.lit(float("inf"))),
                           "n_vectors": F.sum("n").over(whole)})
    met = staged(met.drop("high", "held"), "index-blocks")
    sides = ("query_id", "query_vector", "k", "block", "folder")
    first = staged(_best(_compared(met.where("before < k").select(*sides), rows)), "index-first")
    kth = first.where("rank = k").select("query_id", F.col("distance").alias("kth"))
    rest = met.where("before >= k and low <= bound").join(kth, "query_id", "left").where("kth is null or low <= kth")
    rest = staged(rest.select(*sides, "n"), "index-rest")
    hits = _best(_compared(rest.drop("n"), rows).unionByName(first.drop("rank")))
    visited = met.where("before < k").select("query_id", "n").unionByName(rest.select("query_id", "n"))
    work = met.groupBy("query_id").agg(F.max("n_vectors").alias("n_vectors")).join(
        visited.groupBy("query_id").agg(F.sum("n").alias("n_compared")), "query_id")
    return staged(hits.select("query_id", "rank", "id", "distance"), "hits"), staged(work, "index-work")
