"""Requests judged at their own time against all pairs of requests and lifetimes."""

import datetime
import random

import pytest

from quarry.operators import auth

T0 = datetime.datetime(2020, 1, 1)


def day(n):
    return None if n is None else T0 + datetime.timedelta(hours=n)


@pytest.mark.parametrize("seed", [1, 2])
def test_authorize_at(spark, seed):
    rnd = random.Random(seed)
    lives = [(rnd.choice("aaabcd"), rnd.randrange(5), s := rnd.randrange(100), s + rnd.randrange(0, 40)) for _ in range(60)]
    lives += [("h", 1, 10, 90), ("h", 2, 20, 30), (None, 1, 0, 100), ("n", 1, None, 5)]  # an earlier lifetime outlives a later one
    asks = [(i, rnd.choice([None, "", "Token a", *[f"Bearer {x}" for x in "aaaaabcdefhn"]]), rnd.choice([None, *range(0, 150)] if i % 9 == 0 else range(0, 150))) for i in range(400)]
    lf = spark.createDataFrame([(t, u, day(a), day(b)) for t, u, a, b in lives], "token string, user_id long, issued timestamp_ntz, expiration timestamp_ntz")
    rq = spark.createDataFrame([(i, h, day(t)) for i, h, t in asks], "request_id long, auth_header string, ts timestamp_ntz")
    got = {r.request_id: (r.user_id, r.reason) for r in auth.authorize_at(rq.repartition(5), lf.repartition(3)).collect()}
    want = {}
    for i, h, t in asks:
        if not h:
            want[i] = (None, auth.ERR_NO_HEADER)
        elif not h.startswith("Bearer "):
            want[i] = (None, auth.ERR_BAD_SCHEME)
        else:
            ok = [(b, u) for x, u, a, b in lives if x == h[7:] and a is not None and t is not None and a <= t < b]
            every = [(b, u) for x, u, a, b in lives if x == h[7:] and a is not None and t is not None and a <= t]
            want[i] = (max(every)[1], None) if ok else (None, auth.ERR_BAD_TOKEN)
    assert got == want
    assert any(u is not None for u, _ in want.values()) and len({r for _, r in want.values()}) == 4
