"""Structured Streaming versions of ingest, session upsert and answering.

Each job reads a stream of request files and runs the batch operator on
every micro-batch inside ``foreachBatch``. Outputs are plain parquet
folders partitioned by ``batch_id`` and written with dynamic partition
overwrite, and every batch reads only state written by *earlier* batches,
so replaying a batch after a failure rewrites exactly the same rows
(exactly-once output without a transactional table format).

No watermark is used: the service never de-duplicates or expires
documents, and sessions keep their last write for ever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import answer, context, ingest, retrieve, sessions, validate
from quarry.plans.stage import staged
from quarry.streaming import manifest

Embedder = Callable[[DataFrame], DataFrame]  # requests -> (request_id, vector)


def _read_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The folder as a DataFrame, or None before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return None


def _earlier(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows of a batch-partitioned folder written by batches before ``batch_id``."""
    df = _read_or_none(spark, path, schema)
    if df is None:
        return spark.createDataFrame([], schema).drop("batch_id")
    return df.where(F.col("batch_id") < batch_id).drop("batch_id")


def _overwrite_partitions(df: DataFrame, path: str, *cols: str) -> None:
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*cols).parquet(path))


DATASET_SCHEMA = "id long, user_id long, name string, batch_id long"
VECTOR_SCHEMA = "request_id long, vector array<float>, batch_id long"
RESULT_SCHEMA = "request_id long, user_id long, dataset string, dataset_id long, status string, dim int, id long, batch_id long"
MARK_SCHEMA = "max_id long, batch_id long"
DIM_SCHEMA = "dataset_id long, dim int, batch_id long"
DOCUMENT_SCHEMA = ("id long, title string, url string, body string, vector array<float>, "
                   "word_count long, request_id long, dataset_id long, batch_id long")


def ingest_batch(batch: DataFrame, batch_id: int, embedder: Embedder, store: str) -> None:
    """One micro-batch of A4: embed, get-or-create datasets, append documents."""
    spark = batch.sparkSession
    ds_path, doc_path, st_path = f"{store}/datasets", f"{store}/documents", f"{store}/status"
    mark_path, dim_path = f"{store}/id_marks", f"{store}/dims"
    existing = _earlier(spark, ds_path, batch_id, DATASET_SCHEMA)
    # one row per dataset: the vector dimension fixed by its first batch
    dims = _earlier(spark, dim_path, batch_id, DIM_SCHEMA)
    # the next id comes from a one-row-per-batch high-water mark, not from a
    # scan of every stored document
    marks = _earlier(spark, mark_path, batch_id, MARK_SCHEMA)
    base = marks.agg(F.coalesce(F.max("max_id"), F.lit(0))).first()[0]
    bid = F.lit(batch_id).cast("long")
    # the model is called once per document: its output is stored before anything reads it
    _overwrite_partitions(embedder(batch).select("request_id", "vector").withColumn("batch_id", bid), f"{store}/vectors", "batch_id")
    vectors = spark.read.schema(VECTOR_SCHEMA).parquet(f"{store}/vectors").where(F.col("batch_id") == batch_id).drop("batch_id")
    out = ingest.ingest(batch, vectors, existing, doc_id_base=int(base), dataset_dims=dims)
    new_ds = out["resolved"].where("created").select("id", "user_id", "name", bid.alias("batch_id"))
    _overwrite_partitions(new_ds, ds_path, "batch_id")
    # the batch's results are computed once and stored; all that follows reads them
    _overwrite_partitions(out["results"].withColumn("batch_id", bid), f"{store}/results", "batch_id")
    results = spark.read.schema(RESULT_SCHEMA).parquet(f"{store}/results").where(F.col("batch_id") == batch_id).drop("batch_id")
    docs = ingest.accepted_documents(results, batch, vectors)
    _overwrite_partitions(docs.withColumn("batch_id", bid), doc_path, "dataset_id", "batch_id")
    accepted = results.where("id is not null")
    status = results.select("request_id", "user_id", "dataset", "dataset_id", "status")
    _overwrite_partitions(status.withColumn("batch_id", bid), st_path, "batch_id")
    mark = accepted.agg(F.coalesce(F.max("id"), F.lit(int(base))).alias("max_id")).withColumn("batch_id", bid)
    _overwrite_partitions(mark, mark_path, "batch_id")
    new_dims = (accepted.groupBy("dataset_id").agg(F.min("dim").alias("dim"))
                .join(dims.select("dataset_id"), "dataset_id", "left_anti"))
    _overwrite_partitions(new_dims.withColumn("batch_id", bid), dim_path, "batch_id")


def start_ingest(spark: SparkSession, source: str, request_schema: str, embedder: Embedder,
                 store: str, checkpoint: str, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Continuous document ingest from JSON request files."""
    reader = spark.readStream.schema(request_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(source)
    w = stream.writeStream.foreachBatch(lambda df, bid: ingest_batch(df, bid, embedder, store))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


SESSION_SCHEMA = "id string, user_id long, messages array<string>, model string, version long, first_version long, batch_id long"


def _latest(rows: DataFrame) -> DataFrame:
    """Latest row per session across batch folders (the newest batch wins), with its batch."""
    return (rows.groupBy("id").agg(F.max_by(F.struct("user_id", "messages", "model", "version", "first_version"), F.col("batch_id")).alias("s"),
                                   F.max("batch_id").alias("batch_id"))
            .select("id", "s.*", "batch_id"))


def upsert_batch(batch: DataFrame, batch_id: int, store: str, compact_every: int = 0) -> None:
    """One micro-batch of session saves.

    Writes only the sessions this batch touches, merged with their state
    from earlier batches (read for those ids only, via a semi join), so a
    batch costs what it changes, not the size of the table. Readers take the
    newest row per id (:func:`read_sessions`). Every ``compact_every`` batches
    the folders of earlier batches are folded into a snapshot
    (``streaming.manifest``). A replay re-reads the same earlier state and
    rewrites the same rows.
    """
    spark = batch.sparkSession
    path = f"{store}/sessions"
    changes = batch.select("id", "user_id", "messages", "model", "version")
    prev = None
    s = manifest.live(spark, path, SESSION_SCHEMA)
    if s is not None:
        touched = changes.select("id").distinct()
        prev = _latest(s.where(F.col("batch_id") < batch_id).join(touched, "id", "left_semi")).drop("batch_id")
    merged = sessions.upsert(prev, changes)
    _overwrite_partitions(merged.withColumn("batch_id", F.lit(batch_id).cast("long")), path, "batch_id")
    if compact_every and batch_id and batch_id % compact_every == 0:
        manifest.compact(spark, path, SESSION_SCHEMA, _latest, batch_id - 1)  # this batch may still be replayed


def read_sessions(spark: SparkSession, store: str) -> DataFrame:
    """Current sessions: the newest row of each id in the snapshot and the batch folders after it."""
    return _latest(manifest.live(spark, f"{store}/sessions", SESSION_SCHEMA)).drop("batch_id")


def start_session_upsert(spark: SparkSession, source: str, store: str, checkpoint: str,
                         available_now: bool = True, max_files_per_trigger: int | None = None, compact_every: int = 0) -> StreamingQuery:
    """Continuous session saves (id, user_id, messages, model, version) from JSON files."""
    schema = "id string, user_id long, messages array<string>, model string, version long"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(source)
    w = (stream.writeStream.foreachBatch(lambda df, bid: upsert_batch(df, bid, store, compact_every))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def answer_batch(batch: DataFrame, batch_id: int, datasets: DataFrame, documents: DataFrame, out: str,
                 client_factory=None, system_prompt: str = "", dims: DataFrame | None = None, parts: retrieve.Parts | None = None) -> None:
    """One micro-batch of questions: budget retrieval -> prompts, and with a
    model client the whole answer (model call, citations, JSON)."""
    bid = F.lit(batch_id).cast("long")
    if client_factory is not None:
        answers = answer.answer_questions(batch, datasets, documents, client_factory, system_prompt, dims, parts)
        _overwrite_partitions(answers.withColumn("batch_id", bid), f"{out}/answers", "batch_id")
        return
    req = validate.answer_requests(batch)
    ok = validate.accepted(req)
    kept = retrieve.budget_search(ok, datasets, documents, parts=parts)
    hits = retrieve.attach(kept, documents, ("dataset_id", "title", "url", "body"), parts)
    prompts = context.build_prompts(ok, hits)
    _overwrite_partitions(prompts.withColumn("batch_id", bid), f"{out}/prompts", "batch_id")
    rej = validate.rejected(req).select("query_id", "error", bid.alias("batch_id"))
    _overwrite_partitions(rej, f"{out}/rejected", "batch_id")


def start_answering(spark: SparkSession, source: str, query_schema: str, datasets: DataFrame,
                    documents: DataFrame, out: str, checkpoint: str, available_now: bool = True,
                    client_factory=None, system_prompt: str = "", max_files_per_trigger: int | None = None,
                    parts: retrieve.Parts | None = None) -> StreamingQuery:
    """Continuous question answering: query stream x static knowledge base.

    Ranking needs ``row_number``, which a streaming DataFrame does not allow,
    so each micro-batch runs the batch retrieval. The dimensions of the
    datasets are stored once; ``parts``: see ``answer.answer_questions``.
    """
    dims = staged(retrieve.dataset_dimensions(documents), "dimensions") if client_factory is not None else None
    reader = spark.readStream.schema(query_schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    w = (stream.writeStream
         .foreachBatch(lambda df, bid: answer_batch(df, bid, datasets, documents, out,
                                                    client_factory, system_prompt, dims, parts))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
