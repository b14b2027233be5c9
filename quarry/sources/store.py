"""The knowledge base as a written store, laid out for retrieval.

Two bucketed tables, both by document id, so that they join without a shuffle:

* ``vectors`` (id, dataset_id, word_count, vector), in one folder per dataset:
  ranking reads the folders of the requests' datasets alone (dynamic partition
  pruning) and never a text; budgets read stored word counts.
* ``texts`` (id, title, url, body): read for winners only.

There are at most ``MOST_FOLDERS`` folders; beyond as many datasets a folder holds
several, sorted by dataset, so row groups of other datasets are skipped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import word_count
from quarry.plans.stage import fresh_path

BUCKETS = 32
MOST_FOLDERS = 4096


class Store:
    """Names of the two tables; a table's files lie under a folder of the caller's."""

    def __init__(self, spark: SparkSession, vectors: str, texts: str):
        self.spark, self.names = spark, (vectors, texts)

    @property
    def vectors(self) -> DataFrame:
        """id, dataset_id, word_count, vector, folder."""
        return self.spark.table(self.names[0])

    @property
    def texts(self) -> DataFrame:
        """id, title, url, body."""
        return self.spark.table(self.names[1])

    @property
    def documents(self) -> DataFrame:
        """Whole documents; the join has no exchange."""
        return self.vectors.drop("folder").join(self.texts, "id")

    def drop(self) -> None:
        """Forgets the tables; the files stay."""
        for n in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {n}")


def write(documents: DataFrame, path: str | None = None, buckets: int = BUCKETS) -> Store:
    """Stores ``documents`` (id, dataset_id, title, url, body, vector).

    Rows are dealt by bucket first, so a bucket of a folder is one file; a hot
    dataset is spread over all buckets.
    """
    spark = documents.sparkSession
    path = path or fresh_path(spark, "store")
    tag = uuid.uuid4().hex
    store = Store(spark, f"quarry_vectors_{tag}", f"quarry_texts_{tag}")
    counted = documents.withColumn("word_count", word_count("body")) if "word_count" not in documents.columns else documents
    vectors = counted.select("id", "dataset_id", "word_count", "vector", F.pmod("dataset_id", F.lit(MOST_FOLDERS)).alias("folder"))
    for name, rows, keys in ((store.names[0], vectors, ["folder"]), (store.names[1], documents.select("id", "title", "url", "body"), [])):
        w = rows.repartition(buckets, "id").write.mode("overwrite").format("parquet").option("path", f"{path}/{name}")
        w = w.partitionBy(*keys) if keys else w
        w.bucketBy(buckets, "id").sortBy(*(["dataset_id", "id"] if keys else ["id"])).saveAsTable(name)
    return store
