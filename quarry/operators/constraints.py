"""The constraint report kept up to date: a batch is checked against counts, not against rows.

State, as two tables:

* counters: one row per (rule, key): how often a key occurs; for a foreign key, its
  parents and its children; for a dataset, the smallest and largest dimension;
  for rules without a key, the number of offending rows;
* totals: violations per rule.

A batch of new rows is aggregated to counters (combined in each task, so a hot key is
a row per task), joined with the state of the keys it touches, and the totals
move by the difference of what these keys violate now and before. A parent that
arrives after its children clears their violations. The report equals
``integrity.constraint_report`` over all rows that came.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import has_bad_element
from quarry.plans.stage import staged

COUNTERS = "rule string, key string, n long, m long, lo long, hi long"
TOTALS = "rule string, violations long"
UNIQUE, FOREIGN, ROWS, SPREAD = "unique", "foreign", "rows", "spread"

#: kind of each rule
RULES = {
    "datasets.pk": UNIQUE, "datasets.unique_name_user": UNIQUE, "datasets.not_null": ROWS,
    "documents.pk": UNIQUE, "documents.fk_dataset": FOREIGN, "documents.not_null": ROWS, "documents.one_dimension": SPREAD, "documents.finite_vectors": ROWS,
    "users.pk": UNIQUE, "users.unique_username": UNIQUE, "users.not_null": ROWS,
    "access_tokens.not_null": ROWS, "access_tokens.pk": UNIQUE, "access_tokens.unique_token": UNIQUE, "access_tokens.fk_user": FOREIGN,
    "sessions.pk": UNIQUE, "sessions.not_null": ROWS,
}


def _counter(rows: DataFrame, rule: str, key, n=None, m=None, lo=None, hi=None) -> DataFrame:
    none = F.lit(None).cast("long")
    return rows.groupBy(key.alias("key")).agg(
        F.lit(0).cast("long").alias("n") if n is None else F.sum(n).cast("long").alias("n"),
        F.lit(0).cast("long").alias("m") if m is None else F.sum(m).cast("long").alias("m"),
        (none if lo is None else F.min(lo).cast("long")).alias("lo"), (none if hi is None else F.max(hi).cast("long")).alias("hi"),
    ).select(F.lit(rule).alias("rule"), "key", "n", "m", "lo", "hi")


def _key(*cols: str):
    return F.to_json(F.struct(*cols))


def _unique(rule: str, rows: DataFrame, *cols: str) -> DataFrame:
    given = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    return _counter(rows.where(given), rule, _key(*cols), F.lit(1))


def _foreign(rule: str, child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    ends = (child.where(F.col(fk).isNotNull()).select(F.col(fk).cast("string").alias("k"), F.lit(0).alias("p"), F.lit(1).alias("c"))
            .unionByName(parent.where(F.col(pk).isNotNull()).select(F.col(pk).cast("string").alias("k"), F.lit(1).alias("p"), F.lit(0).alias("c"))))
    return _counter(ends, rule, F.col("k"), F.col("p"), F.col("c"))


def _rows(rule: str, rows: DataFrame, cond) -> DataFrame:
    return _counter(rows, rule, F.lit(""), cond.cast("long"))


def _missing(*cols: str):
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def batch_counters(datasets: DataFrame, documents: DataFrame, users: DataFrame, tokens: DataFrame, sessions: DataFrame) -> DataFrame:
    """The counters of a batch of new rows."""
    dim = F.size("vector")
    parts = [
        _unique("datasets.pk", datasets, "id"), _unique("datasets.unique_name_user", datasets, "name", "user_id"),
        _rows("datasets.not_null", datasets, _missing("id", "user_id", "name")),
        _unique("documents.pk", documents, "id"), _foreign("documents.fk_dataset", documents, "dataset_id", datasets, "id"),
        _rows("documents.not_null", documents, _missing("id", "dataset_id", "title", "body", "vector")),
        _counter(documents, "documents.one_dimension", _key("dataset_id"), lo=dim, hi=dim),
        _rows("documents.finite_vectors", documents, F.coalesce(has_bad_element("vector"), F.lit(False))),
        _unique("users.pk", users, "id"), _unique("users.unique_username", users, "username"),
        _rows("users.not_null", users, _missing("id", "username", "active")),
        _rows("access_tokens.not_null", tokens, _missing("id", "user_id", "token", "expiration")),
        _unique("access_tokens.pk", tokens, "id"), _unique("access_tokens.unique_token", tokens, "token"),
        _foreign("access_tokens.fk_user", tokens, "user_id", users, "id"),
        _unique("sessions.pk", sessions, "id"), _rows("sessions.not_null", sessions, _missing("id", "user_id", "messages", "model")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _violations(n, m, lo, hi):
    kinds = {k: [r for r, v in RULES.items() if v == k] for k in (UNIQUE, FOREIGN, ROWS, SPREAD)}
    rule = F.col("rule")
    return (F.when(rule.isin(kinds[UNIQUE]), (n > 1).cast("long")).when(rule.isin(kinds[FOREIGN]), F.when(n == 0, m).otherwise(F.lit(0)))
            .when(rule.isin(kinds[ROWS]), n).otherwise(F.coalesce((lo != hi).cast("long"), F.lit(0))))


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(counters, totals) before any row has come."""
    return spark.createDataFrame([], COUNTERS), spark.createDataFrame([(r, 0) for r in RULES], TOTALS)


def update(counters: DataFrame, totals: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(touched, totals): the counters that ``new`` (``batch_counters``) touches, as they are now, and the totals now, stored.

    The touched rows replace those of the same rule and key in ``counters``.
    """
    old = counters.select("rule", "key", *[F.col(c).alias(f"old_{c}") for c in ("n", "m", "lo", "hi")])
    both = new.join(old, ["rule", "key"], "left")
    now = {c: F.col(c) + F.coalesce(f"old_{c}", F.lit(0)) for c in ("n", "m")}
    now |= {"lo": F.least("lo", "old_lo"), "hi": F.greatest("hi", "old_hi")}
    before = F.coalesce(_violations(*[F.col(f"old_{c}") for c in ("n", "m", "lo", "hi")]), F.lit(0))
    both = both.select("rule", "key", *[v.alias(c) for c, v in now.items()], before.alias("before"))
    both = staged(both.withColumn("after", _violations(*[F.col(c) for c in ("n", "m", "lo", "hi")])), "counters")
    moved = both.groupBy("rule").agg(F.sum(F.col("after") - F.col("before")).alias("moved"))
    now_total = totals.join(moved, "rule", "left").select("rule", (F.col("violations") + F.coalesce("moved", F.lit(0))).cast("long").alias("violations"))
    return both.drop("before", "after"), staged(now_total, "violations")


def merged(counters: DataFrame, touched: DataFrame) -> DataFrame:
    """All counters after an update."""
    return staged(counters.join(touched.select("rule", "key"), ["rule", "key"], "left_anti").unionByName(touched), "counters")
