"""Bearer headers, token expiry, URL parameters."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import rows
from quarry.functions.text import atoi_or, strip_bearer
from quarry.operators import auth, validate


def test_bearer_variants(spark):
    df = spark.createDataFrame([(1, None), (2, "Token x"), (3, "bearer x"), (4, "Bearer x"), (5, "Bearer Bearer x")],
                               "request_id long, auth_header string")
    got = dict(df.select("request_id", strip_bearer("auth_header")).collect())
    assert got == {1: None, 2: None, 3: None, 4: "x", 5: "Bearer x"}


def test_authorize_and_expiry(spark):
    tokens = spark.createDataFrame(
        [(1, 10, "x", dt.datetime(2002, 2, 13)), (2, 20, "y", dt.datetime(2002, 2, 14))],
        "id long, user_id long, token string, expiration timestamp_ntz")
    reqs = spark.createDataFrame([(1, "Bearer x"), (2, "Bearer y"), (3, None), (4, "Token y"), (5, "Bearer z")],
                                 "request_id long, auth_header string")
    as_of = "2002-02-13 00:00:00"
    assert rows(auth.authorize(reqs, tokens, as_of)) == [(2, 20)]  # expiry == as_of is not live
    bad = dict(auth.unauthorized(reqs, tokens, as_of).collect())
    assert bad == {1: auth.ERR_BAD_TOKEN, 3: auth.ERR_NO_HEADER, 4: auth.ERR_BAD_SCHEME, 5: auth.ERR_BAD_TOKEN}


def test_limit_text(spark):
    df = spark.createDataFrame([("7",), ("+7",), (" 7",), ("7x",), (None,), ("99999999999999999999",)], "t string")
    assert [r[0] for r in df.select(atoi_or("t", 5)).collect()] == [7, 7, 5, 5, 5, 5]


def test_url_parsing(spark):
    urls = spark.createDataFrame([("/query?query=a+b%26c&limit=3&dataset=d",), ("/query?limit=%2B7",),
                                  ("/query?query=x&limit=+7",), ("/query?query=x&limit=0",)], "url string")
    got = [(r.query, r.k, r.dataset, r.error) for r in validate.parse_search_urls(urls).collect()]
    assert got == [("a b&c", 3, "d", None), ("", 7, "default", "empty query"),
                   ("x", 5, "default", None), ("x", 0, "default", "k must be greater than zero")]


def test_issue_tokens_expire_in_a_year(spark):
    users = spark.createDataFrame([(1, "a", True)], "id long, username string, active boolean")
    r = auth.issue_tokens(users, "2002-02-13 00:00:00").first()
    assert r.expiration == dt.datetime(2003, 2, 13) and len(r.token) == 64
    a = auth.issue_tokens(users, "2002-02-13 00:00:00", secret="k").first().token
    assert a == auth.issue_tokens(users, "2002-02-13 00:00:00", secret="k").first().token != r.token
    assert F is not None


def test_shuffled_token_join_equals_broadcast(spark):
    tokens = spark.createDataFrame([(i, i % 3, f"t{i}", dt.datetime(2030, 1, 1)) for i in range(20)],
                                   "id long, user_id long, token string, expiration timestamp_ntz")
    # a hot token: most requests carry t1
    reqs = spark.createDataFrame([(i, "Bearer t1" if i % 4 else f"Bearer t{i % 30}") for i in range(400)],
                                 "request_id long, auth_header string")
    as_of = "2002-02-13 00:00:00"
    want_ok, want_bad = rows(auth.authorize(reqs, tokens, as_of)), rows(auth.unauthorized(reqs, tokens, as_of))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    assert rows(auth.authorize(reqs, tokens, as_of)) == want_ok
    assert rows(auth.unauthorized(reqs, tokens, as_of)) == want_bad
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
