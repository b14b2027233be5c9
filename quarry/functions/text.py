"""String column expressions: Go-shaped JSON, citations, headers, URL params."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import defaults as D

JSON_KEEP_NULLS = {"ignoreNullFields": "false"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def go_escape(json_text) -> Column:
    """Escape the characters Go's encoder escapes and Spark's does not."""
    c = _col(json_text)
    for raw, esc in D.GO_JSON_ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def document_json(id_col="id", dataset_col="dataset_id", title_col="title", url_col="url",
                  body_col="body") -> Column:
    """The service's document encoding: url omitted when '', vector null."""
    url = F.coalesce(_col(url_col), F.lit(""))
    base = [_col(id_col).alias("id"), _col(dataset_col).alias("dataset_id"),
            _col(title_col).alias("title")]
    tail = [_col(body_col).alias("body"), F.lit(None).cast("array<float>").alias("vector")]
    with_url = F.to_json(F.struct(*base, url.alias("url"), *tail), JSON_KEEP_NULLS)
    without_url = F.to_json(F.struct(*base, *tail), JSON_KEEP_NULLS)
    return go_escape(F.when(url == "", without_url).otherwise(with_url))


def markdown_link(title, url) -> Column:
    return F.concat(F.lit("["), _col(title), F.lit("]("), F.coalesce(_col(url), F.lit("")), F.lit(")"))


def unescape_newlines(c) -> Column:
    """Literal backslash-n -> newline."""
    return F.replace(_col(c), F.lit("\\n"), F.lit("\n"))


def strip_bearer(header) -> Column:
    """Token after one 'Bearer ' prefix; NULL when missing or another scheme."""
    h = _col(header)
    return F.when(h.startswith(D.BEARER_PREFIX),
                  F.substr(h, F.lit(len(D.BEARER_PREFIX) + 1)))


def atoi_or(text, fallback: int) -> Column:
    """Whole-string signed decimal integer (strict, no spaces), else fallback."""
    t = _col(text)
    parsed = F.when(t.rlike(r"\A[+-]?[0-9]+\z"), t.try_cast("bigint"))
    return F.coalesce(parsed, F.lit(fallback).cast("bigint"))


def url_param(url, key: str) -> Column:
    """First value of a query parameter, form-decoded ('+' is a space).

    The query string is cut at '&' without asking for a valid URI, so raw
    characters such as '|' and '{' pass. Pairs with invalid escapes or a ';'
    are dropped; '' when no valid pair has the key.
    """
    query = F.regexp_extract(_col(url), r"\A[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&", -1), lambda p: ~p.contains(";"))
    key_of = lambda p: F.try_url_decode(F.regexp_extract(p, r"\A([^=]*)", 1))
    value_of = lambda p: F.try_url_decode(F.regexp_extract(p, r"(?s)\A[^=]*=(.*)\z", 1))
    values = F.transform(F.filter(pairs, lambda p: key_of(p) == F.lit(key)), value_of)
    return F.coalesce(F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1)), F.lit(""))
