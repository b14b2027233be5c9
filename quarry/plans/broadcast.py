"""Broadcast the query side of a retrieval only when its size is proven.

``measure`` is one distributed aggregate over that side (nothing is gathered);
it counts the bytes of every column as JSON text, which is no less than what a
broadcast of the rows holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_ROWS = 200_000
DEFAULT_MAX_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD_BYTES = 64


def measure(df: DataFrame, max_col: str | None = None) -> tuple[int, int, int]:
    """(rows, bytes, maximum of ``max_col`` or 0) of the whole of ``df``."""
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long")), F.lit(0)).alias("bytes"),
                 F.coalesce(F.max(max_col) if max_col else F.lit(0), F.lit(0)).cast("long").alias("most")).first()
    return int(row["n"]), int(row["bytes"]) + ROW_OVERHEAD_BYTES * int(row["n"]), int(row["most"])
