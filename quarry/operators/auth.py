"""Access tokens and request authorisation.

The service fetched the token list once and cached it for ever. Here each run
joins the requests with the tokens live at an explicit ``as_of``, so results
repeat and expiry is honoured; or (``authorize_at``) with the tokens live at
each request's own time. Token values are never logged.
"""

from __future__ import annotations

import datetime as _dt
import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.text import strip_bearer
from quarry.plans.joins import lookup_join
from quarry.plans.scan import running

ERR_NO_HEADER = "authorization header is missing"
ERR_BAD_SCHEME = "invalid authorization header format"
ERR_BAD_TOKEN = "invalid token"


def as_of_literal(as_of) -> Column:
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def live_tokens(tokens: DataFrame, as_of) -> DataFrame:
    """Tokens whose expiration is strictly after ``as_of``."""
    return tokens.where(F.col("expiration") > as_of_literal(as_of))


def live_per_user(tokens: DataFrame, as_of) -> DataFrame:
    return (live_tokens(tokens, as_of).groupBy("user_id")
            .agg(F.count(F.lit(1)).alias("n")))


def issue_tokens(users: DataFrame, as_of, secret: str | None = None) -> DataFrame:
    """One new token per user, expiring one year after ``as_of``.

    token = sha2(secret || user_id || as_of): unpredictable without the
    per-run secret (drawn here when not given), and identical when a lost
    task is recomputed, unlike a random generator evaluated per attempt. The
    secret is data, a one-row table, so no plan or event log shows it.
    """
    one = users.sparkSession.createDataFrame([(secret or secrets.token_hex(32),)], "_secret string")
    stamp = as_of_literal(as_of)
    token = F.sha2(F.concat_ws("|", F.col("_secret"), F.col("id").cast("string"), stamp.cast("string")), 256)
    return users.crossJoin(F.broadcast(one)).select(F.col("id").alias("user_id"), token.alias("token"),
                        (stamp + F.expr(D.TOKEN_LIFETIME)).alias("expiration"))


def _parsed(requests: DataFrame, header_col: str, *cols: str) -> DataFrame:
    h = F.col(header_col)
    reason = (F.when(h.isNull() | (h == ""), F.lit(ERR_NO_HEADER))
              .when(~h.startswith(D.BEARER_PREFIX), F.lit(ERR_BAD_SCHEME)))
    return requests.select("request_id", strip_bearer(h).alias("token"), reason.alias("reason"), *cols)


def _match_tokens(parsed: DataFrame, tokens: DataFrame, how: str) -> DataFrame:
    """Join requests to tokens on the token value (one row per token)."""
    return lookup_join(parsed, tokens.select("token", "user_id"), ["token"], how)


def authorize(requests: DataFrame, tokens: DataFrame, as_of, header_col: str = "auth_header") -> DataFrame:
    """Requests with a live bearer token -> (request_id, user_id)."""
    p = _parsed(requests, header_col).where(F.col("reason").isNull())
    return _match_tokens(p, live_tokens(tokens, as_of), "inner").select("request_id", "user_id")


def unauthorized(requests: DataFrame, tokens: DataFrame, as_of, header_col: str = "auth_header") -> DataFrame:
    """Every other request -> (request_id, reason)."""
    p = _parsed(requests, header_col)
    malformed = p.where(F.col("reason").isNotNull()).select("request_id", "reason")
    unknown = (_match_tokens(p.where(F.col("reason").isNull()), live_tokens(tokens, as_of), "left_anti")
               .select("request_id", F.lit(ERR_BAD_TOKEN).alias("reason")))
    return malformed.unionByName(unknown)


def authorize_at(requests: DataFrame, lifetimes: DataFrame, time_col: str = "ts", header_col: str = "auth_header") -> DataFrame:
    """Every request judged at its own time -> (request_id, user_id, reason).

    ``lifetimes``: token, user_id, issued, expiration: a token may be issued and
    renewed often, with lifetimes that overlap. A request is good if one of them
    holds its time: issued <= time < expiration. Requests and lifetimes of a token
    meet as one ordered stream of events; the latest expiration so far decides
    (of equal ones, that of the largest user). The running maximum is a distributed
    scan, so neither a hot token's requests nor its renewals meet in one task, and
    no pair of a request and a lifetime is made.
    """
    at = F.col(time_col).cast("timestamp_ntz")
    h = _parsed(requests.select("request_id", header_col, at.alias("_at")), header_col, "_at")
    good = h.where("reason is null")
    none = F.lit(None).cast("struct<expiration:timestamp_ntz,user_id:long>")
    issues = lifetimes.where("token is not null and issued is not null and expiration is not null").select(
        "token", F.col("issued").cast("timestamp_ntz").alias("_at"), F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"),
        F.struct(F.col("expiration").cast("timestamp_ntz").alias("expiration"), F.col("user_id").cast("long").alias("user_id")).alias("_life"),
        F.lit(False).alias("_asks"))
    asks = good.where("_at is not null").select("token", "_at", "request_id", none.alias("_life"), F.lit(True).alias("_asks"))
    seen = running(issues.unionByName(asks), ["token"], [F.col("_at")], most={"_latest": "_life"}).where("_asks")
    live = F.coalesce(F.col("_latest.expiration") > F.col("_at"), F.lit(False))
    judged = seen.select("request_id", F.when(live, F.col("_latest.user_id")).alias("user_id"), F.when(~live, F.lit(ERR_BAD_TOKEN)).alias("reason"))
    timeless = good.where("_at is null").select("request_id", F.lit(None).cast("long").alias("user_id"), F.lit(ERR_BAD_TOKEN).alias("reason"))
    refused = h.where("reason is not null").select("request_id", F.lit(None).cast("long").alias("user_id"), "reason")
    return judged.unionByName(timeless).unionByName(refused)
