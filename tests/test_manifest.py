"""Compaction: the same rows, fewer of them to read, and nothing lost by a crash."""

import random

import pytest

from conftest import rows
from quarry.operators import sessions
from quarry.streaming import jobs, manifest

SAVE = "id string, user_id long, messages array<string>, model string, version long"
COLS = ("id", "user_id", "model", "version", "first_version")


def saves(n):
    rnd = random.Random(n)
    return [(f"s{rnd.randrange(5)}", rnd.randrange(9), [f"m{i}"], f"v{i}", i) for i in rnd.sample(range(n), n)]


def test_sessions_with_and_without_compaction(spark, tmp_path):
    ch = saves(90)
    batches = [ch[i:i + 10] for i in range(0, 90, 10)]
    want = rows(sessions.upsert(None, spark.createDataFrame(ch, SAVE)), *COLS)
    for every, at in ((0, str(tmp_path / "a")), (3, str(tmp_path / "b"))):
        for i, b in enumerate(batches):
            jobs.upsert_batch(spark.createDataFrame(b, SAVE), i, at, every)
        jobs.upsert_batch(spark.createDataFrame(batches[-1], SAVE), 8, at, every)  # a replay
        assert rows(jobs.read_sessions(spark, at), *COLS) == want
    plain, folded = (manifest.live(spark, str(tmp_path / x / "sessions"), jobs.SESSION_SCHEMA) for x in "ab")
    assert folded.count() < plain.count() / 2
    assert manifest._newest(spark, str(tmp_path / "b" / "sessions"))[0] == 5


def test_crash_between_snapshot_and_manifest(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    for i in range(4):
        jobs.upsert_batch(spark.createDataFrame(saves(40)[i * 10:i * 10 + 10], SAVE), i, at)
    before = rows(jobs.read_sessions(spark, at), *COLS)

    def crash(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", crash)  # the manifest is never written
        with pytest.raises(RuntimeError):
            manifest.compact(spark, f"{at}/sessions", jobs.SESSION_SCHEMA, jobs._latest, 2)
    assert manifest._newest(spark, f"{at}/sessions") == (-1, None)
    assert rows(jobs.read_sessions(spark, at), *COLS) == before
    manifest.compact(spark, f"{at}/sessions", jobs.SESSION_SCHEMA, jobs._latest, 2)
    manifest.compact(spark, f"{at}/sessions", jobs.SESSION_SCHEMA, jobs._latest, 1)  # behind the newest: nothing to do
    assert manifest._newest(spark, f"{at}/sessions")[0] == 2
    assert rows(jobs.read_sessions(spark, at), *COLS) == before
    assert manifest.live(spark, str(tmp_path / "nothing"), jobs.SESSION_SCHEMA) is None
