"""Plan shape: the properties that make retrieval scale."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators import retrieve, validate
from quarry.plans import checks
from quarry.plans.queries import REGISTRY
from quarry.sources import kb
from quarry.sources.tables import Catalog


def _ranking(spark, sf):
    """The plan of the rows that may be returned, before they are stored."""
    cat = Catalog(spark, sf)
    req = validate.accepted(validate.answer_requests(kb.queries(cat)))
    rows, most = retrieve.candidates(req, kb.datasets(cat), kb.documents(cat), F.col("word_limit") + 1, ("word_limit",))
    assert most > retrieve.GROUP_LIMIT  # the same plan serves small and large requests
    return checks.plan_text(rows)


def test_budget_plan(spark):
    plan = _ranking(spark, SF_SMALL)
    assert "WindowGroupLimit" in plan
    assert checks.partial_group_limit_before_exchange(plan)
    assert "SinglePartition" not in plan
    assert "BroadcastHashJoin" in plan


def test_vectors_are_scanned_once_for_a_set_of_requests(spark):
    """One scan of the vectors in the ranking; what follows reads stored rows."""
    plan = _ranking(spark, SF_SMALL)
    assert len(checks.read_schemas(plan, "embeddings")) == 1
    for key in ("budget_search", "topk_search"):
        assert all("embedding:" not in s for s in checks.read_schemas(checks.plan_text(REGISTRY[key](spark, SF_SMALL)), "embeddings")), key


def test_topk_ranking_reads_no_text(spark):
    cat = Catalog(spark, SF_SMALL)
    req = validate.accepted(validate.search_requests(kb.queries(cat)))
    rows, _ = retrieve.candidates(req, kb.datasets(cat), kb.documents(cat, with_body=False), F.col("k"), ("k",))
    plan = checks.plan_text(rows)
    assert "WindowGroupLimit" in plan and "SinglePartition" not in plan
    for schema in checks.read_schemas(plan, "documents"):
        assert "text" not in schema


def test_every_query_plans(spark):
    for key, fn in REGISTRY.items():
        assert fn(spark, SF_SMALL).columns, key


def test_spread_only_for_under_split_input(spark, monkeypatch):
    import tempfile

    from quarry.plans import parallel

    from quarry.plans.parallel import spread

    path = tempfile.mkdtemp(prefix="quarry-split-") + "/t"
    spark.range(0, 10000).repartition(16).write.parquet(path)
    many = spark.read.parquet(path)
    assert "RoundRobinPartitioning" not in checks.plan_text(spread(many))
    one = spark.read.parquet(path).coalesce(1)
    assert "RoundRobinPartitioning" in checks.plan_text(spread(one))
    monkeypatch.setattr(parallel, "MAX_BYTES", 10)  # a large table is never moved
    assert "RoundRobinPartitioning" not in checks.plan_text(spread(one))


def test_ranking_and_texts(spark):
    """The ranking scan reads no text, and no exchange carries the texts of all documents."""
    for sf in (SF_SMALL, "/root/testdata/sf0.1"):
        schemas = checks.read_schemas(_ranking(spark, sf), "documents")
        assert schemas and all("text" not in s for s in schemas)
        for key in ("build_prompts", "search_response_json", "chat_requests"):
            df = REGISTRY[key](spark, sf)
            assert checks.unfiltered_text_exchanges(df, "text") == [], key


def test_query_sides_are_measured_in_full(spark):
    from quarry.plans.broadcast import measure

    df = spark.range(2000).selectExpr("id", "array_repeat(repeat('x', 5000), 10) AS messages")
    n, size, most = measure(df, "id")
    assert n == 2000 and size > 100_000_000 and most == 1999


def test_answers_move_no_text_but_the_winners(spark, monkeypatch):
    """No exchange of the answer stream carries texts straight from their scan, however large the vectors are."""
    from quarry.plans import scan
    from quarry.streaming import jobs

    seen, bad = [], []

    def checked(write):
        def run(df, *args):
            seen.append(args)
            bad.extend(checks.unfiltered_text_exchanges(df, "text"))
            return write(df, *args)
        return run

    for module in (retrieve, scan):
        monkeypatch.setattr(module, "staged", checked(module.staged))
    monkeypatch.setattr(jobs, "_overwrite_partitions", checked(jobs._overwrite_partitions))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        REGISTRY["stream_answers"](spark, SF_SMALL)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(seen) > 9 and bad == []
