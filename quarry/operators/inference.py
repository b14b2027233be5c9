"""Model calls as batch jobs: request payloads, response parsing, and an
injected-client runner.

Payloads and parsing are pure column expressions. The runner is the one
place Python touches rows: ``mapInPandas`` with one client per partition
and rows sent in batches; every row gets a result or an error, never an
exception that kills the task. Tests inject a deterministic stub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.vectors import has_bad_element

CORRUPT = "_corrupt_record"
EMBEDDING_RESPONSE_SCHEMA = f"data array<struct<embedding: array<float>>>, {CORRUPT} string"
CHAT_RESPONSE_SCHEMA = f"choices array<struct<message: struct<role: string, content: string>>>, {CORRUPT} string"
PERMISSIVE = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
ERR_NO_RESPONSE = "no response from model server"
ERR_BAD_RESPONSE = "response does not decode"


def _model(model) -> Column:
    if isinstance(model, Column):
        return F.coalesce(F.nullif(model, F.lit("")), F.lit(D.DEFAULT_MODEL))
    return F.lit(model or D.DEFAULT_MODEL)


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def embedding_request(text: Column, model=None) -> Column:
    """{"model","input"}; the service always used its default model here."""
    return F.to_json(F.struct(_model(model).alias("model"), text.alias("input")))


def chat_request(prompt: Column, system_prompt: str, model=None) -> Column:
    """{"model","messages":[system,user],"max_tokens":-1,"temperature":0}."""
    return F.to_json(F.struct(
        _model(model).alias("model"),
        F.array(_message("system", F.lit(system_prompt)), _message("user", prompt)).alias("messages"),
        F.lit(D.CHAT_MAX_TOKENS).alias("max_tokens"),
        F.lit(D.CHAT_TEMPERATURE).alias("temperature")))


def search_words_request(query: Column, model=None) -> Column:
    """Query rewriting request: one user message, fixed seed."""
    content = F.concat(F.lit(D.SEARCH_WORDS_INSTRUCTION), query)
    return F.to_json(F.struct(
        _model(model).alias("model"),
        F.array(_message("user", content)).alias("messages"),
        F.lit(D.CHAT_MAX_TOKENS).alias("max_tokens"),
        F.lit(D.CHAT_TEMPERATURE).alias("temperature"),
        F.lit(D.SEARCH_WORDS_SEED).alias("seed")))


def parse_embedding_response(body: Column) -> tuple[Column, Column]:
    """(vector, error): first data item's embedding.

    Malformed JSON is a decode error; valid JSON with no data item is
    "no response" (a missing list decodes as empty, as in Go). A vector with a
    NULL, NaN or infinite element is an error, never a result.
    """
    parsed = F.from_json(body, EMBEDDING_RESPONSE_SCHEMA, PERMISSIVE)
    first = F.try_element_at(parsed["data"], F.lit(1))
    error = (F.when(parsed.isNull() | parsed[CORRUPT].isNotNull(), F.lit(ERR_BAD_RESPONSE))
             .when(first.isNull(), F.lit(ERR_NO_RESPONSE))
             .when(has_bad_element(first["embedding"]), F.lit(D.ERR_BAD_VECTOR)))
    return F.when(error.isNull(), first["embedding"]), error


def parse_chat_response(body: Column) -> tuple[Column, Column]:
    """(content, error): first choice's message content (errors as above)."""
    parsed = F.from_json(body, CHAT_RESPONSE_SCHEMA, PERMISSIVE)
    first = F.try_element_at(parsed["choices"], F.lit(1))
    error = (F.when(parsed.isNull() | parsed[CORRUPT].isNotNull(), F.lit(ERR_BAD_RESPONSE))
             .when(first.isNull(), F.lit(ERR_NO_RESPONSE)))
    return F.when(error.isNull(), first["message"]["content"]), error


def run_model(df: DataFrame, request_col: str, client_factory: Callable[[], Callable[[list[str]], list]],
              key_col: str, batch_size: int = 32) -> DataFrame:
    """Call a model for every row: (key, response, error).

    ``client_factory`` is pickled to the executors and called once per
    partition; the client takes a list of request payloads and returns one
    response body (str) per payload, or raises. A failing batch is retried
    row by row so one bad row only fails itself.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for pdf in batches:
            keys = pdf[key_col].tolist()
            reqs = pdf[request_col].tolist()
            out_resp: list = []
            out_err: list = []
            for start in range(0, len(reqs), batch_size):
                chunk = reqs[start:start + batch_size]
                try:
                    got = list(client(chunk))
                    if len(got) != len(chunk):
                        raise ValueError("client returned a different number of responses")
                    out_resp += got
                    out_err += [None] * len(chunk)
                except Exception:  # noqa: BLE001 - retried per row below
                    for r in chunk:
                        try:
                            out_resp.append(list(client([r]))[0])
                            out_err.append(None)
                        except Exception as exc:  # noqa: BLE001
                            out_resp.append(None)
                            out_err.append(f"{type(exc).__name__}: {exc}"[:500])
            yield pd.DataFrame({key_col: keys, "response": out_resp, "error": out_err})

    key_type = dict(df.dtypes)[key_col]
    schema = f"{key_col} {key_type}, response string, error string"
    return df.select(key_col, request_col).mapInPandas(run, schema)
