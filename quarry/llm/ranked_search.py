"""Ranked lexical search over pipelined term owners.

Index. Documents fall into blocks of at most ``BLOCK_DOCS`` rows and about
``BLOCK_BYTES`` of text where they are scanned, so nothing is shuffled to build
it. A block has one row per term (places of its documents, frequencies,
lengths) and one row of its documents' ids. Frequent terms are split by block.

Search. The items are the stated query set, worked through in waves of ``WAVE``.

1. Document frequency, weight and largest possible contribution of every term
   of the wave come from the whole index.
2. Terms go to owners by weight, the rarest terms to the first. Postings are
   written apart for each owner.
3. A bundle of ``BUNDLE`` items carries sparse accumulators (item, document,
   score) for a block. At each owner in turn it is cogrouped with that owner's
   postings of the block, which add their integer contributions.
4. After each owner the tenth best partial score of an item is a bound that its
   results reach. A document whose score and all that later owners may add stay
   below is dropped: exact, for contributions are never negative. So common terms
   meet few documents. The bounds are at most ``WAVE`` numbers on the driver.
5. Of what is left each block gives its best, and the best of these are ranked.

A term is its lower-cased text, not a hash. A group is one bundle and one block,
so it is bounded whatever the corpus; rows of a hot term are spread over blocks.

Defined results: every row is a document, also repeated ones and rows without
id (last among equal scores); null text has no terms. Items of one id and text are
one item; items of one id and different texts are ranked each; a null item id stays.
An item without terms, or that nothing holds, has no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import fresh_path, staged
from quarry.plans.scan import numbered

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(TERM.encode())  # bytes above 0x7F are parts of letters
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_DOCS, BLOCK_BYTES = 4096, 8 << 20
LONG_TEXT = 1 << 20  # bytes; the words of a longer text are counted one by one, not listed
BUNDLE, WAVE = 128, 8192
BEST = 10
#: least weight of the terms of each owner but the last
OWNERS = (5500, 4000, 2500, 1200)

INDEX = "block long, term string, docs array<int>, tfs array<int>, ns array<int>, ids array<long>"
CARRIED = "bundle long, block long, q array<int>, docs array<int>, scores array<long>, best_q array<int>, best array<long>"


def term_counts(text: str | None) -> Counter:
    data = (text or "").encode().lower()  # of bytes, lower() changes A-Z alone
    if len(data) > LONG_TEXT:
        return Counter(m.group() for m in TERM_BYTES.finditer(data))
    return Counter(TERM_BYTES.findall(data))


def _lists(values: list[list[int]], kind) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.fromiter((x for v in values for x in v), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _block(block: int, ids: list, counts: list[Counter]) -> pa.RecordBatch:
    docs: dict[bytes, list[int]] = {}
    for j, c in enumerate(counts):
        for t in c:
            docs.setdefault(t, []).append(j)
    sizes = [c.total() for c in counts]
    terms = [t.decode() for t in docs]
    tfs = [[counts[j][t] for j in places] for t, places in docs.items()]
    ns = [[sizes[j] for j in places] for places in docs.values()]
    n = len(terms) + 1
    none = pa.array([None], pa.list_(pa.int32()))
    whole = pa.array([sizes], pa.list_(pa.int32()))
    columns = [pa.array([block] * n, pa.int64()), pa.array([*terms, None], pa.string()),
               pa.concat_arrays([_lists(list(docs.values()), pa.int32()), none]), pa.concat_arrays([_lists(tfs, pa.int32()), none]),
               pa.concat_arrays([_lists(ns, pa.int32()), whole]), pa.array([None] * (n - 1) + [ids], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=["block", "term", "docs", "tfs", "ns", "ids"])


def _indexer(block_docs: int, block_bytes: int):

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, counts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                counts.append(term_counts(text))
                size += len(text or "")
                if len(ids) == block_docs or size >= block_bytes:
                    yield _block(at, ids, counts)
                    at, ids, counts, size = at + 1, [], [], 0
        if ids:
            yield _block(at, ids, counts)

    return indexed


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The inverted index of all documents, stored: one row per block and term, and one per block (term null) with ids and lengths."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_indexer(block_docs, block_bytes), INDEX)
    return staged(rows, "search-index")


def item_terms(items: DataFrame) -> DataFrame:
    """q (the item's number, from 0), item_id, terms: the distinct terms of each item."""
    d = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    terms = F.array_distinct(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0)))
    d = d.select("item_id", F.md5("text").alias("digest"), terms.alias("terms"))
    return staged(numbered(d, [], [F.col("item_id").asc_nulls_first(), F.col("digest")], "q"), "search-items")


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row (0 if there are fewer columns)."""
    if scores.shape[1] < k:
        return np.zeros(len(scores), np.int64)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def _owner_step(bound: np.ndarray, rest: np.ndarray, k: int):
    """Adds an owner's postings to a bundle's accumulators of a block; ``bound``, ``rest``: by number of the item in its wave."""

    def step(key, carried: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        bundle, block = key
        size = 1 + max([0, *(int(d[-1]) for d in postings.docs), *(int(d.max()) for d in carried.docs if len(d))])
        scores = np.zeros((BUNDLE, size), np.int64)
        for q, docs, s in zip(carried.q, carried.docs, carried.scores):
            scores[q, docs] = s
        for qs, w, docs, impacts in zip(postings.qs, postings.w, postings.docs, postings.impacts):
            scores[np.ix_(qs, docs)] += int(w) * np.asarray(impacts, np.int64)
        first = bundle * BUNDLE % WAVE
        low, may = (np.pad(x[first:first + BUNDLE], (0, max(0, first + BUNDLE - len(x)))) for x in (bound, rest))
        low = np.maximum(low, _kth(scores, k))  # the block's own k-th best is no better than that of all
        q, docs = np.nonzero((scores > 0) & (scores + may[:, None] >= low[:, None]))
        kept = scores[q, docs]
        best = np.sort(scores, axis=1)[:, -k:]
        best_q = np.nonzero(best)
        return pd.DataFrame({"bundle": [bundle], "block": [block], "q": [q.astype(np.int32)], "docs": [docs.astype(np.int32)], "scores": [kept],
                             "best_q": [best_q[0].astype(np.int32)], "best": [best[best_q]]})

    return step


def _selected(k: int):
    """q, doc_id, score: a block's best documents of each item, equal scores by id."""

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for bundle, qs, docs, scores, ids in zip(b.bundle, b.q, b.docs, b.scores, b.ids):
                ids = pd.array(ids, dtype="Int64")[docs]
                d = pd.DataFrame({"q": qs + bundle * BUNDLE, "doc_id": ids, "score": scores})
                yield d.sort_values(["q", "score", "doc_id"], ascending=[True, False, True], na_position="last").groupby("q").head(k)

    return select


def search(index: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    spark = index.sparkSession
    numbers = item_terms(items)
    heads = index.where("term is null")
    whole = heads.agg(F.sum(F.size(F.filter("ns", lambda n: n > 0))).alias("n"),
                      F.sum(F.aggregate("ns", F.lit(0).cast("long"), lambda a, n: a + n)).alias("l")).first()
    n_docs, n_terms = whole["n"] or 0, whole["l"] or 0
    best = None
    for first in range(0, numbers.count() if n_docs else 0, WAVE):
        wave = numbers.where((F.col("q") >= first) & (F.col("q") < first + WAVE))
        got = _wave(index, heads, wave, first, n_docs, n_terms, k)
        best = got if best is None else best.unionByName(got)
    if best is None:
        best = spark.createDataFrame([], "q long, doc_id long, score long")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbers.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def _wave(index: DataFrame, heads: DataFrame, items: DataFrame, first: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    spark = index.sparkSession
    wanted = staged(items.select("q", F.explode("terms").alias("term")), "search-terms")
    impact = F.expr(f"zip_with(tfs, ns, (tf, n) -> (1000000000L * tf) div (1000L * tf + 8L * (10L + (90L * n * {n_docs}L) div {n_terms}L)))")
    found = index.join(wanted.select("term").distinct(), "term").select("block", "term", "docs", impact.alias("impacts"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long")
    owner = sum(((F.col("w") < least).cast("int") for least in OWNERS), F.lit(0))
    stats = (found.groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("impacts")).alias("most"))
             .withColumn("w", weight).where("w > 0").select("term", "w", (F.col("w") * F.col("most")).alias("most"), owner.alias("owner")))
    stats = staged(stats, "search-weights")
    path = fresh_path(spark, "search-postings")
    found.join(stats.select("term", "owner"), "term").write.partitionBy("owner").parquet(path)

    # what each owner and those after it may add to each item at most: WAVE numbers an owner
    limits = wanted.join(stats, "term").groupBy("q", "owner").agg(F.sum("most").alias("most")).toArrow()
    size = min(WAVE, int(items.agg(F.max("q")).first()[0]) + 1 - first)
    may = np.zeros((len(OWNERS) + 2, size), np.int64)
    may[limits["owner"].to_numpy(), limits["q"].to_numpy() - first] = limits["most"].to_numpy()
    may = np.cumsum(may[::-1], axis=0)[::-1]
    asked = (wanted.join(stats.select("term", "w", "owner"), "term")
             .groupBy("term", F.floor(F.col("q") / BUNDLE).alias("bundle"), "w", "owner")
             .agg(F.collect_list((F.col("q") % BUNDLE).cast("int")).alias("qs")))  # at most BUNDLE
    asked = staged(asked, "search-bundles")

    bound = np.zeros(size, np.int64)
    carried = spark.createDataFrame([], CARRIED)
    owners = [r[0] for r in stats.select("owner").distinct().orderBy("owner").collect()]  # at most one an owner
    postings = spark.read.schema("block long, term string, docs array<int>, impacts array<long>, owner int").parquet(path) if owners else None
    for o in owners:
        own = (postings.where(F.col("owner") == o).drop("owner").join(asked.where(F.col("owner") == o).drop("owner"), "term")
               .select("bundle", "block", "w", "qs", "docs", "impacts"))
        step = _owner_step(bound, may[o + 1], k)
        carried = staged(carried.groupBy("bundle", "block").cogroup(own.groupBy("bundle", "block")).applyInPandas(step, CARRIED), "search-bundles")
        scores = carried.select("bundle", F.explode(F.arrays_zip("best_q", "best")).alias("s")).select(
            (F.col("bundle") * BUNDLE + F.col("s.best_q")).alias("q"), F.col("s.best").alias("score"))
        top = scores.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc())))
        kth = top.where(F.col("rank") == k).select("q", "score").toArrow()  # at most WAVE rows
        bound[kth["q"].to_numpy() - first] = kth["score"].to_numpy()
    ids = heads.select("block", "ids")
    return carried.select("bundle", "block", "q", "docs", "scores").join(ids, "block").mapInPandas(_selected(k), "q long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Index and search at once."""
    return search(build_index(docs), items, k)
