"""Exact nearest-neighbour retrieval for whole tables of queries.

Plan shape (see ``plans.checks``):

* queries are resolved to a dataset id (tenant filter: name + user) and staged;
* the query side is broadcast when one aggregate over it proves it small, so
  documents are streamed from the scan; otherwise both sides meet in a
  sort-merge join whose hot datasets adaptive execution splits;
* ranking rows are narrow (query_id, id, distance): no text is read before
  the candidates are known. Requests of up to ``GROUP_LIMIT`` rows are cut per map
  task (``WindowGroupLimit``), per (query, group of map tasks) and per query; in
  the same pass over the vectors, larger requests keep all their rows. Candidates
  are staged: vectors are scanned and compared once per set of requests;
* running word counts and ranks come from a distributed prefix sum
  (``plans.scan``): a request of any size is spread over many tasks;
* word counts and titles / urls / bodies are looked up for candidates and
  winners only; a sketch of their ids keeps all other texts out of the shuffle.
  Where ``documents`` is itself a join of texts and vectors, its ``Parts`` are
  looked up instead, since that join would move every text first.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.vectors import is_finite, l2_distance, word_count
from quarry.plans.broadcast import DEFAULT_MAX_BYTES, DEFAULT_MAX_ROWS, measure
from quarry.plans.joins import lookup_join
from quarry.plans.scan import numbered, running
from quarry.plans.sketch import key_sketch, maybe_in
from quarry.plans.stage import staged
from quarry.sources.store import MOST_FOLDERS

# Requests of up to this many rows are cut in each map task: Spark plans a group
# limit up to its default threshold, 1000.
GROUP_LIMIT = 1000
GROUPS = 64  # groups of map tasks that cut their candidates before the last limit


class Parts(NamedTuple):
    """The two tables that ``documents`` joins, for looking up texts where they are scanned."""

    texts: DataFrame  # title, url, body ... and the columns of ``vectors``: a row per text
    vectors: DataFrame  # id and any other columns both are joined by: a row per vector


def resolve_datasets(queries: DataFrame, datasets: DataFrame) -> DataFrame:
    """Attach ``dataset_id`` by (dataset name, user_id); unknown datasets drop out."""
    ds = datasets.select(F.col("name").alias("dataset"), "user_id", F.col("id").alias("dataset_id"))
    return lookup_join(queries, ds, ["dataset", "user_id"], "inner")


def score_pairs(queries: DataFrame, documents: DataFrame, broadcast_queries: bool,
                query_cols: tuple[str, ...] = ()) -> DataFrame:
    """query_id, id, distance (+ query_cols) of every (query, document of its dataset).

    ``queries``: query_id, dataset_id, query_vector (+ query_cols).
    ``documents``: id, dataset_id, vector (and folder: of a store). Pairs of differing
    dimension are dropped (``dimension_errors`` reports their queries).
    """
    q = queries.select("query_id", "dataset_id", "query_vector", *query_cols)
    on = ["dataset_id"]
    if "folder" in documents.columns:  # of a store (``sources.store``): folders of other datasets are pruned
        q, on = q.withColumn("folder", F.pmod("dataset_id", F.lit(MOST_FOLDERS))), [*on, "folder"]
    d = documents.select("id", "vector", *on)
    pairs = d.join(F.broadcast(q) if broadcast_queries else q, on, "inner")
    # The lambda fold measured 4.5x faster than a 64-term unrolled expression
    # (whose generated method is too large to JIT) on 4M pairs.
    return (pairs.where(F.size("vector") == F.size("query_vector"))
            .select("query_id", "id", l2_distance("vector", "query_vector").alias("distance"), *query_cols))


def top_rows(pairs: DataFrame, limit: str) -> DataFrame:
    """At least the first ``limit`` (a column) rows of each query by (distance, id), for requests above ``GROUP_LIMIT`` all.

    A row of a large request is a group of its own, so one pass serves both.
    Distances that are no number (a bad element in a stored vector) are never returned.
    """
    order = (F.col("distance"), F.col("id"))
    own = F.when(F.col(limit) > GROUP_LIMIT, F.col("id"))
    rows = pairs.where(is_finite("distance")).withColumns({"_own": own, "_group": F.pmod(F.spark_partition_id(), F.lit(GROUPS))})
    for spec in (Window.partitionBy("query_id", "_own", "_group"), Window.partitionBy("query_id", "_own")):
        rows = rows.withColumn("_place", F.row_number().over(spec.orderBy(*order))).where(F.col("_place") <= GROUP_LIMIT)
        rows = rows.where(F.col("_place") <= F.col(limit))
    return rows.drop("_own", "_group", "_place")


def word_counts(documents: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, word_count: as stored, else counted from the bodies."""
    return documents.select(*keys, "word_count" if "word_count" in documents.columns else word_count("body").alias("word_count"))


def within_budget(candidates: DataFrame, limit_col: str = "word_limit") -> DataFrame:
    """Documents in distance order while the running word count fits the budget.

    ``candidates``: at least the first ``budget + 1`` rows of each query, with
    word_count. The running sum uses the RANGE frame over ``distance`` (equal
    distances are peers and share the sum, so ties are kept or dropped
    together). The limit is exact: every word_count >= 1, so at most B documents
    fit budget B; a tie group cut by the limit contains row B + 1, whose sum
    exceeds B.
    """
    summed = running(candidates, ["query_id"], [F.col("distance")], {"cumulative_words": "word_count"}, "_place", [F.col("id")])
    return summed.where(F.col("cumulative_words") <= F.col(limit_col)).withColumn("rank", F.col("_place").cast("int") + 1).drop("_place")


def looked_up(rows: DataFrame, attrs: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``rows`` (a stored table: it is read twice) joined to ``attrs`` by id; attributes of other ids are left in their scan.

    With ``vectors`` (of ``Parts``), ``attrs`` counts as joined to them: its rows come once for each vector.
    """
    sketch, keys = key_sketch(rows, "id"), ["id"]
    if vectors is not None:
        rows, keys = rows.join(maybe_in(vectors, sketch, "id"), "id", "inner"), vectors.columns
    return rows.join(maybe_in(attrs, sketch, "id"), keys, "inner").drop(*[k for k in keys if k != "id"])


def attach(ranked: DataFrame, attrs: DataFrame, cols: tuple[str, ...], parts: Parts | None = None) -> DataFrame:
    """Late materialisation: document attributes for the winners only, from the ``parts`` of ``attrs`` if given."""
    if parts is not None:
        return looked_up(ranked, parts.texts.select(*parts.vectors.columns, *cols), parts.vectors)
    return looked_up(ranked, attrs.select("id", *cols))


def candidates(requests: DataFrame, datasets: DataFrame, documents: DataFrame, limit: Column, cols: tuple[str, ...],
               broadcast_queries: bool | None = None) -> tuple[DataFrame, int]:
    """(rows, most): query_id, id, distance and cols of the rows that may be returned, and the largest limit.

    ``limit``: how many rows a request needs at most, from its columns ``cols``.
    """
    resolved = resolve_datasets(requests.select("query_id", "query_vector", "user_id", "dataset", *cols), datasets)
    resolved = staged(resolved.withColumn("_rows", limit), "requests")
    n, size, most = measure(resolved, "_rows")
    small = n <= DEFAULT_MAX_ROWS and size <= DEFAULT_MAX_BYTES if broadcast_queries is None else broadcast_queries
    pairs = score_pairs(resolved.where("_rows > 0"), documents, small, (*cols, "_rows"))
    return top_rows(pairs, "_rows").drop("_rows"), most


def budget_search(requests: DataFrame, datasets: DataFrame, documents: DataFrame,
                  broadcast_queries: bool | None = None, parts: Parts | None = None) -> DataFrame:
    """Word-budget retrieval for every accepted request, as a stored table.

    ``requests``: validated rows (query_id, query_vector, user_id, dataset,
    word_limit); ``documents``: id, dataset_id, vector and, without ``parts``,
    word_count or body.
    Returns query_id, rank, id, word_count, cumulative_words, distance.
    """
    rows, _ = candidates(requests, datasets, documents, F.col("word_limit") + 1, ("word_limit",), broadcast_queries)
    counts = word_counts(parts.texts, parts.vectors.columns) if parts else word_counts(documents)
    counted = looked_up(staged(rows, "candidates"), counts, parts.vectors if parts else None)
    out = within_budget(counted).select("query_id", "rank", "id", "word_count", "cumulative_words", "distance")
    return staged(out, "hits")


def topk_search(requests: DataFrame, datasets: DataFrame, documents: DataFrame,
                broadcast_queries: bool | None = None) -> DataFrame:
    """Top-k retrieval for every accepted request (its own ``k``), as a stored table: query_id, rank, id, distance."""
    rows, most = candidates(requests, datasets, documents, F.col("k"), ("k",), broadcast_queries)
    order = [F.col("distance"), F.col("id")]
    if most > GROUP_LIMIT:
        ranked = numbered(rows, ["query_id"], order, "_place").withColumn("rank", F.col("_place").cast("int") + 1)
    else:  # at most ``GROUP_LIMIT`` rows a request
        ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return staged(ranked.where(F.col("rank") <= F.col("k")).select("query_id", "rank", "id", "distance"), "hits")


def dataset_dimensions(documents: DataFrame) -> DataFrame:
    """dataset_id, dims: the dimensions present (a tiny set per dataset, combined in each task)."""
    return documents.groupBy("dataset_id").agg(F.collect_set(F.size("vector")).alias("dims"))


def dimension_errors(requests: DataFrame, datasets: DataFrame, documents: DataFrame,
                     dims: DataFrame | None = None) -> DataFrame:
    """(query_id, error) for requests whose dataset holds a vector of another dimension.

    The service fails such a query. ``dims`` (dataset_id, dims) is read instead
    of the vectors when the store keeps it.
    """
    resolved = resolve_datasets(requests.select("query_id", "query_vector", "user_id", "dataset"), datasets)
    j = lookup_join(resolved, dataset_dimensions(documents) if dims is None else dims, ["dataset_id"], "inner")
    return (j.where(F.exists("dims", lambda d: d != F.size("query_vector")))
            .select("query_id", F.lit(D.ERR_DIMENSION).alias("error")))
