"""Vector and word-count column expressions (JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.defaults import WORD_SPLIT_PATTERN


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def l2_distance(v, q) -> Column:
    """Euclidean distance of two float arrays, folded left to right in DOUBLE.

    The fold order is fixed (0 + d0^2 + d1^2 + ...), so the bits equal any
    other engine that folds the same way; ties and ordering then agree.
    Arrays of different length give NULL (``zip_with`` pads with NULL):
    callers drop such pairs, rank NULL last and keep finite distances only.
    """
    v, q = _col(v), _col(q)
    sq = F.zip_with(v, q, lambda a, b: (a.cast("double") - b.cast("double"))
                    * (a.cast("double") - b.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0).cast("double"), lambda s, x: s + x))


def word_count(body) -> Column:
    """Number of pieces of ``body`` split on runs of whitespace.

    Leading / trailing whitespace each add an empty piece and '' counts as
    one, so the result is always >= 1 (the word-budget pre-limit needs it).
    """
    return F.size(F.split(_col(body), WORD_SPLIT_PATTERN, -1)).cast("long")


def has_bad_element(v) -> Column:
    """Any element NULL, NaN or infinite (a vector column accepts none of them)."""
    return F.exists(_col(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def is_finite(c) -> Column:
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))

