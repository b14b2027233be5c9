"""Document ingest as set-at-a-time jobs.

decode JSON -> embed (a vector lookup or any embedder returning a column)
-> default dataset -> get-or-create datasets -> assign ids -> append.
Each request keeps a status; one failing item never stops the others.

Everything that decides about a request is narrow: its keys, and the size and
validity of its vector. Bodies and vectors are left where they are until the
accepted documents are written; no text is sorted, numbered or joined for a
status or an id.

Surrogate keys (``assign_ids``) are an exclusive scan of row counts per written
partition of the keys (``plans.scan``). The id equals base + global rank, so it
is stable across retries and equal to ``ROW_NUMBER() OVER (ORDER BY key)`` in
any engine; the number of partitions follows the number of keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.vectors import has_bad_element, word_count
from quarry.operators.validate import default_if_empty
from quarry.plans.joins import lookup_join
from quarry.plans.scan import numbered
from quarry.plans.stage import staged

DOC_REQUEST_SCHEMA = "title string, url string, body string, dataset string"
CORRUPT = "_corrupt_record"

ST_OK = "accepted"
ST_BAD_JSON = "invalid json"
ST_EMBED_FAILED = "could not get document embedding"
ST_EMPTY_VECTOR = "vector cannot be empty"
ST_BAD_VECTOR = D.ERR_BAD_VECTOR
ST_DIMENSION = D.ERR_DIMENSION


def _fields_or_empty(s: Column) -> list[Column]:
    # Go decodes absent fields to '' (zero value); Spark gives NULL.
    return [F.coalesce(s[f], F.lit("")).alias(f) for f in ("title", "url", "body", "dataset")]


def decode_documents(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """One JSON object per row -> title, url, body, dataset, status."""
    parsed = F.from_json(F.col(json_col), f"{DOC_REQUEST_SCHEMA}, {CORRUPT} string",
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    j = raw.withColumn("_j", parsed)
    bad = F.col(f"_j.{CORRUPT}").isNotNull() | F.col("_j").isNull()
    fields = [F.when(~bad, F.coalesce(F.col(f"_j.{f}"), F.lit(""))).alias(f)
              for f in ("title", "url", "body", "dataset")]
    out = j.select("*", *fields,
                   F.when(bad, F.lit(ST_BAD_JSON)).otherwise(F.lit(ST_OK)).alias("status"))
    return out.drop("_j")


def decode_typed(raw: DataFrame, json_col: str = "payload") -> DataFrame:
    """Like ``decode_documents``, with the service's rules of types and names.

    The payload is a VARIANT, so a number is told from a string: a field of any
    type but string makes the request invalid. Names match in any case. A field
    that is null, or a payload that is the word null, leaves fields empty; other
    payloads that are no object are invalid, unknown fields are ignored. Of a field
    written in several cases the last in order of names counts; a payload that
    repeats a name to the letter is invalid.
    """
    v = F.try_parse_json(F.col(json_col))  # the first value; what follows it is ignored, as the service does
    j = raw.withColumn("_v", v).withColumn("_kind", F.schema_of_variant("_v"))
    members = F.when(F.col("_kind").startswith("OBJECT"), F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>")))
    j = j.withColumn("_members", F.transform(members, lambda e: F.struct(
        F.lower(e["key"]).alias("name"), F.schema_of_variant(e["value"]).alias("kind"), F.try_variant_get(e["value"], "$", "string").alias("text"))))
    names = ("title", "url", "body", "dataset")
    wrong = F.exists("_members", lambda m: m["name"].isin(*names) & ~m["kind"].isin("STRING", "VOID"))
    good = F.coalesce((F.col("_kind") == "VOID") | (F.col("_kind").startswith("OBJECT") & ~wrong), F.lit(False))

    def field(name: str):
        own = F.filter("_members", lambda m: (m["name"] == name) & (m["kind"] == "STRING"))
        return F.when(good, F.coalesce(F.try_element_at(own, F.lit(-1))["text"], F.lit(""))).alias(name)

    return j.select(*raw.columns, *[field(n) for n in names],
                    F.when(good, F.lit(ST_OK)).otherwise(F.lit(ST_BAD_JSON)).alias("status"))


def decode_bulk(raw: DataFrame, json_col: str = "payload", batch_col: str = "batch_id") -> DataFrame:
    """One JSON array per row -> one row per item (position 1-based).

    An array that does not decode rejects the whole batch (one row with
    position 0), as the service answers such a request with one error.
    """
    parsed = F.from_json(F.col(json_col), f"array<struct<{DOC_REQUEST_SCHEMA.replace(' string', ':string')}>>")
    j = raw.select(batch_col, parsed.alias("_items"))
    items = (j.where(F.col("_items").isNotNull())
             .select(batch_col, F.posexplode("_items").alias("_pos", "_it"))
             .select(batch_col, (F.col("_pos") + 1).alias("position"), *_fields_or_empty(F.col("_it")),
                     F.lit(ST_OK).alias("status")))
    bad = (j.where(F.col("_items").isNull())
           .select(batch_col, F.lit(0).alias("position"),
                   *[F.lit(None).cast("string").alias(f) for f in ("title", "url", "body", "dataset")],
                   F.lit(ST_BAD_JSON).alias("status")))
    return items.unionByName(bad)


def assign_ids(keys: DataFrame, order_cols: list[str], base: Column | int = 0, id_col: str = "id") -> DataFrame:
    """Dense ids base+1, base+2, ... in the order of ``order_cols`` (a unique key); hand over narrow rows."""
    base = base if isinstance(base, Column) else F.lit(base)
    placed = numbered(keys, [], [F.col(c) for c in order_cols], "_place")
    return placed.withColumn(id_col, (base + F.col("_place") + 1).cast("long")).drop("_place")


def get_or_create(existing: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets by (name, user_id); create the missing ones.

    ``existing``: id, user_id, name. ``wanted``: name, user_id (duplicates ok).
    Returns (resolved, all_datasets): resolved = name, user_id, id, created
    for every distinct wanted pair; all_datasets = existing + new rows.
    """
    ex = existing.select("id", "user_id", "name")
    pairs = staged(wanted.select("name", "user_id").distinct().join(ex.withColumnRenamed("id", "_id"), ["name", "user_id"], "left"), "wanted-datasets")
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    created = assign_ids(pairs.where("_id is null").select("name", "user_id"), ["user_id", "name"], int(top))
    created = staged(created.select("name", "user_id", "id"), "new-datasets")
    resolved = (pairs.where("_id is not null").select("name", "user_id", F.col("_id").alias("id"), F.lit(False).alias("created"))
                .unionByName(created.withColumn("created", F.lit(True))))
    return resolved, ex.unionByName(created.select("id", "user_id", "name"))


def ingest(requests: DataFrame, vectors: DataFrame, datasets: DataFrame, doc_id_base: int = 0,
           dataset_dims: DataFrame | None = None, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Whole ingest pipeline.

    ``requests``: request_id (unique), user_id, title, url, body, dataset.
    ``vectors``: request_id, vector (the embedder's output; a missing row
    means the embedding call failed). It is read more than once: an embedder
    that calls a model hands over a stored table (``streaming.jobs`` does).
    Returns ``results`` (every request with dataset_id, status, the narrow
    columns ``keep`` of its request, dim (the size of its vector) and, where
    accepted, its document id), ``status``, ``documents`` (the accepted rows as
    the store keeps them), ``datasets`` (existing + created) and ``resolved``.
    Datasets are created for every request that embedded, even when its
    vector is then rejected (the service creates the dataset first).
    One vector dimension per dataset: from ``dataset_dims`` (dataset_id, dim;
    e.g. read from the store), else from the dataset's earliest request with a
    valid vector; other dimensions are rejected.
    """
    req = requests.select("request_id", "user_id", default_if_empty(F.col("dataset"), D.DEFAULT_DATASET).alias("dataset"), *keep)
    facts = vectors.where("vector is not null").select("request_id", F.size("vector").alias("dim"), has_bad_element("vector").alias("_bad"))
    emb = staged(req.join(facts, "request_id", "left"), "ingest-requests")
    resolved, all_ds = get_or_create(datasets, emb.where("dim is not null").select(F.col("dataset").alias("name"), "user_id"))
    ids = resolved.select(F.col("name").alias("dataset"), "user_id", F.col("id").alias("dataset_id"))
    # min_by combines map-side, so a hot dataset reaches the shuffle as one row per task
    first = emb.where("dim > 0 and not _bad").groupBy("dataset", "user_id").agg(F.min_by("dim", "request_id").alias("_first_dim"))
    known = lookup_join(ids, first, ["dataset", "user_id"], "left")
    dim = F.col("_first_dim")
    if dataset_dims is not None:
        known = lookup_join(known, dataset_dims.select("dataset_id", F.col("dim").alias("_known_dim")), ["dataset_id"], "left")
        dim = F.coalesce("_known_dim", "_first_dim")
    joined = lookup_join(emb, known.select("dataset", "user_id", "dataset_id", dim.alias("_dim")), ["dataset", "user_id"], "left")
    status = (F.when(F.col("dim").isNull(), F.lit(ST_EMBED_FAILED))
              .when(F.col("dim") == 0, F.lit(ST_EMPTY_VECTOR))
              .when(F.col("_bad"), F.lit(ST_BAD_VECTOR))
              .when(F.col("dim") != F.col("_dim"), F.lit(ST_DIMENSION))
              .otherwise(F.lit(ST_OK)))
    st = staged(joined.withColumn("status", status).select("request_id", "user_id", "dataset", "dataset_id", "status", "dim", *keep), "ingest-status")
    numbers = assign_ids(st.where(F.col("status") == ST_OK).select("request_id"), ["request_id"], doc_id_base)
    results = st.join(numbers, "request_id", "left")
    return {"results": results, "status": st.select("request_id", "user_id", "dataset", "dataset_id", "status"),
            "documents": accepted_documents(results, requests, vectors), "datasets": all_ds, "resolved": resolved}


def accepted_documents(results: DataFrame, requests: DataFrame, vectors: DataFrame) -> DataFrame:
    """The new documents among the results of an ingest, as the store keeps them."""
    ok = results.where(F.col("status") == ST_OK).select("request_id", "id", "dataset_id")
    return (requests.select("request_id", "title", "url", "body").join(ok, "request_id").join(vectors.select("request_id", "vector"), "request_id")
            .select("id", "dataset_id", "title", "url", "body", "vector", word_count("body").alias("word_count"), "request_id"))


def store_documents(docs: DataFrame, path: str, bucket_count: int | None = None,
                    mode: str = "append", partitions: int | None = None) -> None:
    """Write documents to the store, laid out for tenant pruning.

    Up to a few thousand datasets: one folder per ``dataset_id``, so the
    retrieval's dataset-id IN filter (from its probe) prunes folders. Beyond
    that (``bucket_count``): folders by ``dataset_id % N`` with rows sorted
    by dataset_id inside, so row-group min/max still skip other datasets
    without a small-file explosion. Rows are range-partitioned on
    (dataset_id, id) first: a hot dataset spans many balanced tasks and each
    task writes files for only a few datasets.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, "dataset_id", "id").sortWithinPartitions("dataset_id", "id")
    if bucket_count:
        ordered = ordered.withColumn("dataset_bucket", F.pmod(F.col("dataset_id"), F.lit(bucket_count)))
        ordered.write.mode(mode).partitionBy("dataset_bucket").parquet(path)
    else:
        ordered.write.mode(mode).partitionBy("dataset_id").parquet(path)


def read_documents(spark, path: str, bucket_count: int | None = None) -> DataFrame:
    """The stored documents (id, dataset_id, title, url, body, vector, word_count)."""
    df = spark.read.parquet(path)
    return df.drop("dataset_bucket") if bucket_count else df


def cascade_delete(documents: DataFrame, deleted_datasets: DataFrame) -> DataFrame:
    """Documents left after deleting datasets (ON DELETE CASCADE)."""
    gone = deleted_datasets.select(F.col("id").alias("dataset_id")).distinct()
    return lookup_join(documents, gone, ["dataset_id"], "left_anti")


def cascade_update(documents: DataFrame, id_map: DataFrame) -> DataFrame:
    """ON UPDATE CASCADE: id_map(old_id, new_id) rewrites dataset_id."""
    m = id_map.select(F.col("old_id").alias("dataset_id"), "new_id")
    return (lookup_join(documents, m, ["dataset_id"], "left")
            .withColumn("dataset_id", F.coalesce("new_id", "dataset_id")).drop("new_id"))
