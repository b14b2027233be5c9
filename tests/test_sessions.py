"""Session upsert / lookup / message arrays / ids."""

from conftest import rows
from quarry.operators import sessions

CH = "id string, user_id long, messages array<string>, model string, version long"


def test_upsert_last_write_wins(spark):
    ch = spark.createDataFrame([("s", 1, ["a"], "m1", 1), ("s", 2, ["c", "d"], "m3", 3), ("s", 3, ["b"], "m2", 2),
                                ("", 1, ["x"], "m", 1)], CH)
    got = sessions.upsert(None, ch).collect()
    assert [(r.id, r.user_id, r.messages, r.model) for r in got] == [("s", 1, ["c", "d"], "m3")]
    assert sessions.rejected_saves(ch).count() == 1


def test_upsert_idempotent(spark):
    ch = spark.createDataFrame([("s", 1, ["a"], "m1", 1), ("t", 2, ["b"], "m2", 1)], CH)
    once = sessions.upsert(None, ch)
    twice = sessions.upsert(once, ch)
    assert rows(once) == rows(twice)


def test_late_save_does_not_change_the_owner(spark):
    first = sessions.upsert(None, spark.createDataFrame([("s", 1, ["a"], "m1", 1), ("s", 9, ["c"], "m3", 3)], CH))
    late = spark.createDataFrame([("s", 7, ["b"], "m2", 2)], CH)
    (r,) = sessions.upsert(first, late).collect()
    assert (r.user_id, r.messages, r.model, r.version, r.first_version) == (1, ["c"], "m3", 3, 1)
    (r,) = sessions.upsert(first.drop("first_version"), late).collect()  # a state without it keeps its owner
    assert (r.user_id, r.version) == (1, 3)
    earliest = spark.createDataFrame([("s", 4, ["z"], "m0", 0)], CH)
    assert sessions.upsert(first, earliest).first()["user_id"] == 4


def test_lookup(spark):
    s = spark.createDataFrame([("s", 1, ["a"], "m", 1)], CH)
    req = spark.createDataFrame([(1, "s"), (2, "zz"), (3, "")], "request_id long, session_id string")
    got = {r.request_id: (r.found, r.error) for r in sessions.lookup(req, s).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, "empty session id")}


def test_lookup_by_its_owner_alone(spark):
    s = spark.createDataFrame([("s", 1, ["a"], "m", 1)], CH)
    req = spark.createDataFrame([(1, "s", 1), (2, "s", 2), (3, "zz", 1), (4, "", 1), (5, "s", None)], "request_id long, session_id string, asker long")
    got = {r.request_id: (r.found, r.messages, r.error) for r in sessions.lookup(req, s, user_col="asker").collect()}
    assert got == {1: (True, ["a"], None), 2: (False, None, None), 3: (False, None, None), 4: (False, None, "empty session id"), 5: (False, None, None)}


def test_messages_and_ids(spark):
    t = spark.createDataFrame([("s", 2, "b"), ("s", 1, "a")], "session_id string, turn long, content string")
    r = sessions.session_messages(t).first()
    assert (r.n, r.message_array) == (2, ["a", "b"])
    ids = sessions.assign_ids(t.select("session_id").distinct(), "session_id", salt="k").first()["uuid"]
    assert len(ids) == 36 and ids[14] == "4" and ids[19] in "89ab"
