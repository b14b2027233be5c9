"""Standing queries: results kept up to date as documents arrive.

Each update merges the new documents with the queries' present winners; no
earlier document is read again, and the result equals a search over all of them.

* Top-k. The k nearest of all are the k nearest of the old winners and the new.
* Word budget. A document's running sum only grows when others come, so what was
  left out stays out, and the winners are a prefix in distance order. The
  distance of the nearest document left out (the frontier) is kept for each
  query: a new document at or behind it is out as well, for its running sum
  holds that document's. Winners and new documents before the frontier give the
  rest exactly.

Winners are bounded by k or the budget; running sums are distributed scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.vectors import is_finite
from quarry.operators.retrieve import resolve_datasets, score_pairs, word_counts
from quarry.plans.scan import running
from quarry.plans.stage import staged

WINNERS = "query_id long, id long, distance double, word_count long, cumulative_words long, rank int"
FRONTIERS = "query_id long, frontier double"


def resolved(requests: DataFrame, datasets: DataFrame, *cols: str) -> DataFrame:
    """The standing requests with their dataset, stored: query_id, query_vector, dataset_id, cols."""
    return staged(resolve_datasets(requests.select("query_id", "query_vector", "user_id", "dataset", *cols), datasets), "standing")


def update_top_k(queries: DataFrame, winners: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, id, distance, rank after ``documents`` have come; ``queries``: resolved, with k."""
    new = score_pairs(queries, documents, False, ("k",)).where(is_finite("distance"))
    old = winners.join(queries.select("query_id", "k"), "query_id").select("query_id", "id", "distance", "k")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    both = old.unionByName(new.select("query_id", "id", "distance", "k")).withColumn("rank", rank)
    return both.where(F.col("rank") <= F.col("k")).select("query_id", "id", "distance", "rank")


def update_budget(queries: DataFrame, winners: DataFrame, frontiers: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(winners, frontiers) after ``documents`` have come; ``queries``: resolved, with word_limit.

    ``documents``: id, dataset_id, vector and word_count or body.
    """
    new = score_pairs(queries, documents, False, ("word_limit",)).where(is_finite("distance")).join(frontiers, "query_id", "left")
    new = new.where("frontier is null or distance < frontier").join(word_counts(documents), "id")
    old = winners.join(queries.select("query_id", "word_limit"), "query_id")
    cols = ["query_id", "id", "distance", "word_count", "word_limit"]
    summed = running(old.select(*cols).unionByName(new.select(*cols)), ["query_id"], [F.col("distance")],
                     {"cumulative_words": "word_count"}, "place", [F.col("id")])
    summed = staged(summed, "standing-sums")
    fits = F.col("cumulative_words") <= F.col("word_limit")
    kept = summed.where(fits).select("query_id", "id", "distance", "word_count", "cumulative_words", (F.col("place") + 1).cast("int").alias("rank"))
    out = summed.where(~fits).select("query_id", F.col("distance").alias("frontier"))
    return kept, frontiers.unionByName(out).groupBy("query_id").agg(F.min("frontier").alias("frontier"))
