"""Keyed session state: order of arrival, repeats and replays change nothing."""

import json
import random

import pytest

from conftest import rows
from quarry.operators import sessions
from quarry.streaming import session_state

COLS = ("id", "user_id", "first_version", "model", "version")


def saves(seed, n=40):
    rnd = random.Random(seed)
    out = [{"id": f"s{rnd.randrange(6) if i % 3 else 0}", "user_id": rnd.randrange(9), "messages": [f"m{i}", "x"], "model": f"v{i}", "version": i} for i in range(n)]
    return out + out[5:9]  # some come twice


def run(spark, at, batches):
    src = at / "in"
    src.mkdir(parents=True)
    for i, b in enumerate(batches):
        (src / f"{i:03d}.json").write_text("\n".join(map(json.dumps, b)))
        session_state.start(spark, str(src), str(at / "store"), str(at / "progress"), max_files_per_trigger=1).awaitTermination()
    return session_state.read(spark, str(at / "store"))


def test_order_of_arrival_changes_nothing(spark, tmp_path):
    ch = saves(1)
    mixed = random.Random(2).sample(ch, len(ch))
    extra = [{"id": "", "user_id": 1, "messages": [], "model": "m", "version": 1}, {"id": "s1", "user_id": None, "messages": None, "model": "m", "version": 99}]
    want = rows(sessions.upsert(None, spark.createDataFrame(ch, session_state.SAVE_SCHEMA)), *COLS)
    before = spark.conf.get(session_state.PROVIDER, None)
    assert rows(run(spark, tmp_path / "a", [ch[:20], ch[20:]]), *COLS) == want
    got = run(spark, tmp_path / "b", [mixed[:9], mixed[9:30] + extra, mixed[30:], mixed[:5]])
    assert rows(got, *COLS) == want
    assert spark.conf.get(session_state.PROVIDER, None) == before
    # only touched sessions are written
    assert spark.read.parquet(str(tmp_path / "b" / "store" / "touched")).groupBy("batch_id").count().count() == 4


@pytest.mark.parametrize("seed", range(20))
def test_merge_is_an_aggregate(seed):
    rnd = random.Random(seed)
    parts = [(rnd.randrange(3), v := rnd.randrange(4), [str(rnd.randrange(3))], "m", v) for _ in range(6)]
    whole = None
    for p in parts:
        whole = session_state.merge(whole, p)
    rnd.shuffle(parts)
    left, right = None, None
    for p in parts[:3]:
        left = session_state.merge(left, p)
    for p in parts[3:]:
        right = session_state.merge(right, p)
    assert session_state.merge(left, right) == whole
