"""The report kept up to date equals the full report after every batch."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from quarry.operators import constraints, integrity

SCHEMAS = {"datasets": "id long, user_id long, name string",
           "documents": "id long, dataset_id long, title string, body string, vector array<float>",
           "users": "id long, username string, active boolean",
           "tokens": "id long, user_id long, token string, expiration long",
           "sessions": "id string, user_id long, messages array<string>, model string"}


def random_rows(rnd, n):
    some = lambda *x: rnd.choice([*x, None])
    num = lambda: some(*range(8))
    vector = lambda: some([1.0], [1.0, 2.0], [float("nan")], [None, 1.0], [2.0])
    make = {"datasets": lambda: (num(), num(), some("a", "b")), "documents": lambda: (num(), num(), some("t"), some("b"), vector()),
            "users": lambda: (num(), some("u", "v", "w"), some(True, False)), "tokens": lambda: (num(), num(), some("k", "l"), some(1)),
            "sessions": lambda: (some("s", "t", "u"), num(), some(["m"], []), some("x"))}
    return {t: [f() for _ in range(rnd.randrange(n))] for t, f in make.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_full_report_after_every_batch(spark, seed):
    rnd = random.Random(seed)
    so_far = {t: [] for t in SCHEMAS}
    counters, totals = constraints.empty(spark)
    for batch in range(4):
        new = random_rows(rnd, 9)
        for t in so_far:
            so_far[t] += new[t]
        frames = {t: spark.createDataFrame(new[t], SCHEMAS[t]) for t in SCHEMAS}
        touched, totals = constraints.update(counters, totals, constraints.batch_counters(*frames.values()))
        counters = constraints.merged(counters, touched)
        want = integrity.constraint_report(*[spark.createDataFrame(so_far[t], SCHEMAS[t]) for t in SCHEMAS])
        assert rows(totals, "rule", "violations") == rows(want, "rule", "violations"), batch
    assert counters.groupBy("rule", "key").count().where("count > 1").count() == 0


def test_a_late_parent_clears_its_children(spark):
    counters, totals = constraints.empty(spark)
    empty = {t: spark.createDataFrame([], s) for t, s in SCHEMAS.items()}
    docs = spark.createDataFrame([(i, 7, "t", "b", [1.0]) for i in range(5)], SCHEMAS["documents"])
    for frames, want in (({**empty, "documents": docs}, 5), ({**empty, "datasets": spark.createDataFrame([(7, 1, "a")], SCHEMAS["datasets"])}, 0)):
        touched, totals = constraints.update(counters, totals, constraints.batch_counters(*frames.values()))
        counters = constraints.merged(counters, touched)
        assert totals.where(F.col("rule") == "documents.fk_dataset").first()["violations"] == want
