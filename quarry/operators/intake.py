"""File intake: accept PDFs up to 10 MiB, extract text per file.

Files are read with the ``binaryFile`` source; the name and size gate is a
filter on ``path`` / ``length`` (both reach the scan's PushedFilters), and
the rejection report selects only path and length, so file contents are
never read for rejected files. Text extraction is a pluggable per-file
function run in ``mapInPandas``, with an error column per file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import defaults as D

ERR_TOO_BIG = "file is larger than 10 MiB"
ERR_NOT_PDF = "not a PDF file"
ERR_NO_SIZE = "file size is unknown"
ERR_NO_CONTENT = "file has no content"


def is_pdf(name: Column) -> Column:
    """Name ends with one of the accepted suffixes (exactly as written)."""
    cond = None
    for suf in D.PDF_SUFFIXES:
        c = name.endswith(suf)
        cond = c if cond is None else (cond | c)
    return cond


def gate_reason(name: Column, length: Column) -> Column:
    """NULL when accepted; size is checked before the name, as the service did.

    An unknown size or name is a rejection of its own kind.
    """
    return (F.when(length.isNull(), F.lit(ERR_NO_SIZE))
            .when(length > D.UPLOAD_MAX_BYTES, F.lit(ERR_TOO_BIG))
            .when(~F.coalesce(is_pdf(name), F.lit(False)), F.lit(ERR_NOT_PDF)))


def intake_gate(files: DataFrame, name_col: str = "name", length_col: str = "length") -> DataFrame:
    r = gate_reason(F.col(name_col), F.col(length_col))
    return files.select("*", r.isNull().alias("accepted"), r.alias("reason"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Accepted uploads only: pushed-down name and size filters."""
    df = spark.read.format("binaryFile").load(path)
    return df.where(is_pdf(F.col("path")) & (F.col("length") <= D.UPLOAD_MAX_BYTES))


def rejected_uploads(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.format("binaryFile").load(path).select("path", "length")
    r = gate_reason(F.col("path"), F.col("length"))
    return df.select("path", "length", r.alias("reason")).where(F.col("reason").isNotNull())


def extract_text(files: DataFrame, extractor: Callable[[bytes], str],
                 path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, text, error) per file; ``extractor`` maps file bytes to text."""
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, errs = [], []
            for blob in pdf[content_col]:
                try:
                    texts.append(None if blob is None else extractor(bytes(blob)))
                    errs.append(None if blob is not None else ERR_NO_CONTENT)
                except Exception as exc:  # noqa: BLE001
                    texts.append(None)
                    errs.append(f"{type(exc).__name__}: {exc}"[:500])
            yield pd.DataFrame({path_col: pdf[path_col], "text": texts, "error": errs})

    return files.select(path_col, content_col).mapInPandas(
        run, f"{path_col} string, text string, error string")


# Markup removal: scripts and styles with their content, then any tag, then
# whitespace runs collapsed to one space.
SCRIPT_RE = r"(?is)<script[^>]*>.*?</script>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style>"
TAG_RE = r"(?s)<[^>]*>"
SPACE_RE = r"[ \t\r\n]+"


def html_text(html: Column) -> Column:
    t = F.regexp_replace(html, SCRIPT_RE, " ")
    t = F.regexp_replace(t, STYLE_RE, " ")
    t = F.regexp_replace(t, TAG_RE, " ")
    t = F.regexp_replace(t, SPACE_RE, " ")
    return F.trim(t)


def html_extractor(blob: bytes) -> str:
    """Bytes of an HTML file -> text, as :func:`html_text`; bytes that are no UTF-8 are replaced."""
    t = blob.decode("utf-8", "replace")
    for pattern in (SCRIPT_RE, STYLE_RE, TAG_RE, SPACE_RE):
        t = re.sub(pattern, " ", t)
    return t.strip(" ")
