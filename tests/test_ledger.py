"""Distinct payloads are called once, also over several runs and after a lost job."""

import os
import uuid

import pytest

from quarry.operators import inference, ledger


def counting(folder, broken=None):
    def factory():
        def client(payloads):
            if broken and any(p == broken for p in payloads):
                os._exit(3)  # the worker is lost, with all it has not yet written
            for p in payloads:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(p)
            if any("bad" in p for p in payloads):
                raise ValueError("refused")
            return [f"reply to {p}" for p in payloads]
        return client
    return factory


def calls(folder):
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def test_repeated_payloads_and_runs(spark, tmp_path):
    folder, at = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    data = [(i, f"p{i % 7}") for i in range(500)] + [(900, None), (901, "")]
    df = spark.createDataFrame(data, "k long, payload string").repartition(6)
    got = {r.k: (r.response, r.error) for r in ledger.run_model(df, "payload", counting(folder), "k", at).collect()}
    assert got == {k: (f"reply to {p or ''}", None) for k, p in data}
    assert calls(folder) == ["", *[f"p{i}" for i in range(7)]]
    more = spark.createDataFrame([*data, (1000, "new")], "k long, payload string")
    again = {r.k: r.response for r in ledger.run_model(more, "payload", counting(folder), "k", at).collect()}
    assert again == {k: f"reply to {p or ''}" for k, p in [*data, (1000, "new")]}
    assert len(calls(folder)) == 9  # one new payload
    plain = {r.k: (r.response, r.error) for r in inference.run_model(df.na.fill(""), "payload", counting(folder), "k").collect()}
    assert plain == got


def test_failed_calls_are_asked_again(spark, tmp_path):
    folder, at = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "bad")], "k long, payload string")
    for _ in range(2):
        got = {r.k: (r.response, r.error) for r in ledger.run_model(df, "payload", counting(folder), "k", at).collect()}
        assert got == {1: ("reply to good", None), 2: (None, "ValueError: refused"), 3: (None, "ValueError: refused")}
    assert calls(folder).count("good") <= 2 and ledger.entries(spark, at).count() == 1


def test_a_lost_job_keeps_finished_waves(spark, tmp_path):
    folder, at = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    df = spark.createDataFrame([(i, f"p{i}") for i in range(200)], "k long, payload string")
    order = [r.payload for r in ledger.numbered(df.selectExpr("sha2(payload, 256) AS digest", "payload"), [], [ledger.F.col("digest")], "n").orderBy("n").collect()]
    with pytest.raises(Exception):
        ledger.run_model(df, "payload", counting(folder, broken=order[150]), "k", at, wave=64)
    assert ledger.entries(spark, at).count() == 128  # two waves of 64
    got = {r.k: r.response for r in ledger.run_model(df, "payload", counting(folder), "k", at, wave=64).collect()}
    assert got == {i: f"reply to p{i}" for i in range(200)}
    paid = calls(folder)
    assert all(paid.count(p) == 1 for p in order[:128]) and len(paid) < 200 + 64
