"""Integrity report for the constraints the table DDL declares.

Parquet tables enforce no keys, so each rule is a query: duplicate keys
(aggregate), dangling foreign keys (anti join), NULLs (count), plus the
one-dimension-per-dataset and finite-vector rules retrieval depends on. One row
per rule: rule, violations (number of offending keys / rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.vectors import has_bad_element


def _rule(name: str, n_df: DataFrame) -> DataFrame:
    return n_df.select(F.lit(name).alias("rule"), F.col("n").cast("long").alias("violations"))


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Number of key values that occur more than once (NULL keys ignored)."""
    keyed = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
    dups = keyed.groupBy(*cols).count().where(F.col("count") > 1)
    return dups.agg(F.count(F.lit(1)).alias("n"))


def dangling(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose foreign key has no parent row (NULL keys ignored)."""
    p = parent.select(F.col(pk).alias(fk)).distinct()
    return (child.where(F.col(fk).isNotNull()).join(p, fk, "left_anti")
            .agg(F.count(F.lit(1)).alias("n")))


def nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.agg(F.count(F.when(cond, 1)).alias("n"))


def document_checks(documents: DataFrame) -> DataFrame:
    """not_null, one_dimension and finite_vectors in one pass over the documents.

    One group per dataset (combined map-side, so a hot dataset is fine);
    the vector column is read once for all three rules.
    """
    null_cond = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in
                                            ("id", "dataset_id", "title", "body", "vector")])
    per_ds = documents.groupBy("dataset_id").agg(
        F.countDistinct(F.size("vector")).alias("dims"),
        F.count(F.when(null_cond, 1)).alias("nulls"),
        F.count(F.when(has_bad_element("vector"), 1)).alias("bad"))
    total = per_ds.agg(F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
                       F.count(F.when(F.col("dims") > 1, 1)).alias("mixed"),
                       F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(c).cast("long").alias("violations"))
                     for name, c in (("documents.not_null", "nulls"), ("documents.one_dimension", "mixed"),
                                     ("documents.finite_vectors", "bad"))])
    return total.select(F.explode(rows).alias("r")).select("r.rule", "r.violations")


def constraint_report(datasets: DataFrame, documents: DataFrame, users: DataFrame,
                      tokens: DataFrame, sessions: DataFrame) -> DataFrame:
    parts = [
        _rule("datasets.pk", duplicate_keys(datasets, ["id"])),
        _rule("datasets.unique_name_user", duplicate_keys(datasets, ["name", "user_id"])),
        _rule("datasets.not_null", nulls(datasets, ["id", "user_id", "name"])),
        _rule("documents.pk", duplicate_keys(documents, ["id"])),
        _rule("documents.fk_dataset", dangling(documents, "dataset_id", datasets, "id")),
        document_checks(documents),
        _rule("users.pk", duplicate_keys(users, ["id"])),
        _rule("users.unique_username", duplicate_keys(users, ["username"])),
        _rule("users.not_null", nulls(users, ["id", "username", "active"])),
        _rule("access_tokens.not_null", nulls(tokens, ["id", "user_id", "token", "expiration"])),
        _rule("access_tokens.pk", duplicate_keys(tokens, ["id"])),
        _rule("access_tokens.unique_token", duplicate_keys(tokens, ["token"])),
        _rule("access_tokens.fk_user", dangling(tokens, "user_id", users, "id")),
        _rule("sessions.pk", duplicate_keys(sessions, ["id"])),
        _rule("sessions.not_null", nulls(sessions, ["id", "user_id", "messages", "model"])),
    ]
    return reduce(DataFrame.unionByName, parts)
