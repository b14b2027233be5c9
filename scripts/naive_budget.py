"""Word-budget retrieval: exact pre-limit plan vs the naive full-window plan.

The naive plan is the literal translation: the RANGE running sum over every
(query, document) pair of the query's dataset, no pre-limit.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from quarry.functions.vectors import word_count  # noqa: E402
from quarry.operators import retrieve, validate  # noqa: E402
from quarry.session import local_session  # noqa: E402
from quarry.sources import kb  # noqa: E402
from quarry.sources.tables import Catalog  # noqa: E402


def naive(spark, sf, ties):
    cat = Catalog(spark, sf)
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    docs = (kb.ties(cat) if ties else kb.documents(cat))
    counted = docs.select("id", word_count("body").alias("word_count"))
    resolved = retrieve.resolve_datasets(req, kb.datasets(cat))
    pairs = retrieve.score_pairs(resolved, docs, True, query_cols=("word_limit",)).join(counted, "id")
    w = Window.partitionBy("query_id").orderBy("distance")
    return pairs.withColumn("c", F.sum("word_count").over(w)).where("c <= word_limit")


def timed(fn):
    best = None
    for _ in range(2):
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        d = time.perf_counter() - t0
        best = d if best is None else min(best, d)
    return round(best, 3)


def main():
    from quarry.plans.queries import REGISTRY
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    for key, ties in (("budget_search", False), ("budget_search_ties", True)):  # warm-up
        REGISTRY[key](spark, sf).write.format("noop").mode("overwrite").save()
        naive(spark, sf, ties).write.format("noop").mode("overwrite").save()
    out = {}
    for key, ties in (("budget_search", False), ("budget_search_ties", True)):
        full = timed(lambda: naive(spark, sf, ties))
        out[key] = {"prelimit": timed(lambda: REGISTRY[key](spark, sf)), "full_window": full}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
