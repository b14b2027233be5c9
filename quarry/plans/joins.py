"""Joins against a side with at most one row per key, safe under hot keys.

Nothing is measured while the plan is built. Spark broadcasts the right side
when its size, known from storage or measured at run time by adaptive
execution, is below the session's threshold. Otherwise both sides meet in a
sort-merge join, whose skewed left partitions adaptive execution splits: a
key carrying a third of the left rows is spread over many tasks, since each
of them can read the one right row again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``how`` is inner, left, left_semi or left_anti."""
    return left.join(right, on, how)
