"""Benchmark decontamination with a positional inverted index, in SQL functions only.

Index. Every word of every training document whose term occurs in the test set
is stored as a posting (term, doc_id, pos) in the shared folder. Term counts
come from the stored postings, so they cover the whole corpus.

Phrases. A window is ``width`` consecutive words of a test item (a shorter item
is one window). Lists are intersected from the rarest terms on:

1. The two rarest places of every window look up their postings. A posting at
   ``pos`` for place ``j`` speaks for the alignment ``pos - j`` of document and
   item. Alignments with fewer than two places cannot hold a window. (An item
   of one word needs one.)
2. What survives is stored, then offset-adjusted lists of all other places are
   intersected: place ``j`` of alignment ``a`` needs the posting (term, a + j).
   Postings of other documents stay out by a fixed-size sketch of the ids.
3. Runs of ``width`` or more matched places are the occurrences, exactly.

Texts are read and split once. Terms, anchors and alignments are stored tables, so Spark knows their size and
broadcasts them only below its threshold; above it they are shuffled. Nothing
is keyed by a term alone except the small side, so a frequent word is no hot
key; aggregates combine in each task.

Defined results: null text has no words; each row is judged by its own text, also
rows without id and different texts of one id (``with_row_key``). A null item id
is not listed in ``items`` but its windows hit. Repeated rows change nothing. Items with
one id and different texts are separate, listed once. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import ROW, staged, with_row_key, without
from quarry.plans.sketch import key_sketch, maybe_in

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text"):
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.regexp_extract_all(folded, F.lit(WORD), F.lit(0))


def places(items: DataFrame) -> DataFrame:
    """One row per word of a test item: item, item_id, n, j, term."""
    w = (items.select("item_id", "text").distinct()
         .select(F.xxhash64("item_id", "text").alias("item"), "item_id", words().alias("w")))
    return w.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("j", "term"))


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The positional index (term, doc_id, pos), of all terms or of the given ones (a distinct column)."""
    out = docs.select("doc_id", F.posexplode(words()).alias("pos", "term")).select("term", "doc_id", "pos")
    return out if terms is None else out.join(terms, "term")


def anchors(test: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """(term, item, j, need): the two rarest places of every window that can occur at all."""
    counted = test.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    first, last = F.greatest(F.lit(0), F.col("j") - (width - 1)), F.least("j", F.greatest(F.lit(0), F.col("n") - width))
    windows = counted.select("*", F.explode(F.sequence(first, last)).alias("start"))
    rare = Window.partitionBy("item", "start").orderBy("count", "j")
    return (windows.withColumns({"rank": F.row_number().over(rare), "least": F.min("count").over(Window.partitionBy("item", "start"))})
            .where("rank <= 2 and least > 0")
            .select("term", "item", "j", F.least(F.lit(2), "n").alias("need")).distinct())


def occurrences(index: DataFrame, test: DataFrame, width: int = WIDTH) -> DataFrame:
    """Exact phrase matches: item, item_id, doc_id, start, end (word positions of maximal runs)."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    rare = staged(anchors(test, counts, width), "anchors")
    votes = index.join(rare, "term").select("item", "doc_id", (F.col("pos") - F.col("j")).alias("at"), "j", "need")
    alignments = staged(votes.groupBy("item", "doc_id", "at", "need").agg(F.min("j").alias("a"), F.max("j").alias("b"))
                        .where("need = 1 or a <> b").select("item", "doc_id", "at"), "alignments")
    wanted = alignments.join(test, "item").select("item", "item_id", "n", "doc_id", "at", "j", "term", (F.col("at") + F.col("j")).alias("pos"))
    near = maybe_in(index, key_sketch(alignments.select("doc_id"), "doc_id"), "doc_id").distinct()
    p = near.select(F.col("term").alias("p_term"), F.col("doc_id").alias("p_doc"), F.col("pos").alias("p_pos"))
    found = wanted.join(p, (F.col("term") == F.col("p_term")) & (F.col("pos") == F.col("p_pos"))
                        & F.col("doc_id").eqNullSafe(F.col("p_doc")))
    # places in a row: j minus its rank is the same along a run
    rank = F.row_number().over(Window.partitionBy("item", "doc_id", "at").orderBy("j"))
    return (found.withColumn("run", F.col("j") - rank)
            .groupBy("item", "item_id", "n", "doc_id", "at", "run").agg(F.min("j").alias("a"), F.max("j").alias("b"))
            .where(F.col("b") - F.col("a") + 1 >= F.least(F.lit(width), "n"))
            .select("item", "item_id", "doc_id", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.col("b")).alias("end")))


def proximity_matches(index: DataFrame, test: DataFrame, slop: int) -> DataFrame:
    """(item, item_id, doc_id, pos): places of an item's rarest term with all
    other terms of the item within ``slop`` words."""
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("count"))
    terms = test.groupBy("item", "item_id", "term").agg(F.min("j").alias("j"))
    ranked = (terms.join(counts, "term", "left").withColumn("count", F.coalesce("count", F.lit(0)))
              .withColumns({"rank": F.row_number().over(Window.partitionBy("item").orderBy("count", "j")),
                            "size": F.count(F.lit(1)).over(Window.partitionBy("item"))}))
    ranked = staged(ranked.where("count > 0"), "proximity")
    pivot = index.join(ranked.where("rank = 1"), "term").select("item", "item_id", "doc_id", "pos", "size").distinct()
    others = ranked.where("rank > 1").select("item", F.col("term"))
    cell = lambda c: F.floor(c / F.lit(2 * slop + 1))
    need = (pivot.join(others, "item")
            .withColumn("cell", F.explode(F.array_distinct(F.array(cell(F.col("pos") - slop), cell(F.col("pos") + slop))))))
    p = index.select(F.col("term").alias("p_term"), F.col("doc_id").alias("p_doc"), F.col("pos").alias("p_pos"), cell(F.col("pos")).alias("p_cell"))
    near = need.join(p, (F.col("term") == F.col("p_term")) & (F.col("cell") == F.col("p_cell")) & F.col("doc_id").eqNullSafe(F.col("p_doc"))
                     & (F.abs(F.col("pos") - F.col("p_pos")) <= slop))
    full = (near.groupBy("item", "item_id", "doc_id", "pos", "size").agg(F.count_distinct("term").alias("k"))
            .where("k = size - 1").select("item", "item_id", "doc_id", "pos"))
    return full.unionByName(pivot.where("size = 1").select("item", "item_id", "doc_id", "pos"))


def indexed(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index, sizes) of rows with a key ``ROW``, from one pass over the texts, stored.

    index: (term, doc_id, pos) of the given terms, doc_id being the row's key.
    sizes: (row, doc_id, n_words) of every row.
    """
    ended = F.concat(words(), F.array(F.lit(None).cast("string")))  # the place behind the last word tells their number
    places = docs.select(F.col(ROW).alias("row"), "doc_id", F.posexplode(ended).alias("pos", "term"))
    marked = terms.select("term", F.lit(True).alias("wanted"))
    stored = staged(places.join(marked, "term", "left").where("wanted or term is null")
                    .select("term", "row", F.when(F.col("term").isNull(), F.col("doc_id")).alias("doc_id"), "pos"), "postings")
    index = stored.where("term is not null").select("term", F.col("row").alias("doc_id"), "pos")
    return index, stored.where("term is null").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; each row is judged by its own text."""
    return _contamination(with_row_key(docs.select("doc_id", "text")), benchmark, width).drop("row")


def _contamination(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    test = staged(places(benchmark), "test-places")
    terms = staged(test.select("term").distinct(), "test-terms")
    index, sizes = indexed(docs, terms)
    hits = staged(occurrences(index, test, width).withColumnRenamed("doc_id", "row"), "occurrences")
    covered = (hits.select("row", F.explode(F.sequence("start", "end")).alias("pos")).distinct()
               .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    items = (hits.select("row", F.col("item_id").cast("string").alias("id")).distinct()
             .groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("ids")))  # at most the items of the test set
    out = sizes.join(covered.join(items, "row"), "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                      F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any occurrence, with all their columns; each row is judged by its own text."""
    docs = with_row_key(docs)
    hit = _contamination(docs.select(ROW, "doc_id", "text"), benchmark, width).where("contaminated")
    return without(docs, hit.select(F.col("row").alias("doc_id")))
