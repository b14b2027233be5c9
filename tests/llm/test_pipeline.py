"""The corpus pipeline, stage by stage against brute force, on whole small tables."""

import hashlib
from collections import Counter

import tokenizers

import corpus_pipeline
from corpus_fixture import docs, fixture_rows, no_docs  # noqa: F401 - fixtures
from quarry.llm import bpe, common, decontam, exact_dedup, minhash, quality
from quarry.llm.common import table
from test_operators import brute_components, brute_contamination, brute_copies

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    theirs = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    left = {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert out.columns == docs.columns, name
        got = {r.doc_id: r.text for r in out.collect()}
        rows = list(left.items())
        if name == "quality classifier":
            want = {r.doc_id for r in quality.scored(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
        elif name == "exact dedup":
            want = {d for (d, _), v in brute_copies(rows).items() if v[2]}
        elif name == "minhash near-dedup":
            want = {d for d, (_, c) in brute_components(rows).items() if d == c}
        else:
            want = {d for d, v in brute_contamination(rows, items, 10).items() if not v[4]}
        assert got == {d: left[d] for d in want}, name
        seen.append((name, len(left) - len(got)))
        left, docs = got, out
    assert sum(n > 0 for _, n in seen) >= 3, seen  # the stages have something to do here
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    want = {}
    for d, t in left.items():
        ids = theirs.encode(t, add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert got == want


def test_stages_take_empty_and_odd_tables(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, SF).count() == 0, name
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        assert out.count() > 0, name


def test_rows_without_id_and_of_one_id_are_judged_apart(spark):
    words = [f"w{i}" for i in range(90)]
    passage, clean, other = " ".join(words[:30]), " ".join(words[30:60]), " ".join(words[60:])
    near = clean + " more"
    rows = [(1, passage), (1, clean), (2, other), (None, passage), (None, near), (None, "quite another text"), (None, "quite another text"), (3, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    left = decontam.clean_documents(docs, items)
    assert left.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(r for r in rows if r[1] != passage)
    left = minhash.one_of_each(docs).collect()
    assert Counter((r.doc_id, r.text) for r in left) == Counter(
        [(1, passage), (1, clean), (2, other), (None, "quite another text"), (None, "quite another text"), (3, None)])


def test_run_writes_every_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_few_that_go_are_looked_up_in_one_pass(spark, tmp_path, monkeypatch):
    """No stage reads the texts twice to return those that stay, nor writes them to more files; the other way gives the same rows."""
    copy = " ".join(f"c{i}" for i in range(40))
    rows = [(i, f"text {i} " + " ".join(f"w{i}x{j}" for j in range(20)), "x") for i in range(40)]
    rows += [(50, copy, "y"), (51, copy, "y"), (52, copy + " ", None), (None, copy, "z"), (50, "of an id that is there", "z"), (None, None, None), (3, rows[3][1], "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    items = spark.createDataFrame([(7, rows[5][1])], "item_id long, text string")
    stages = {"exact": (exact_dedup.dedup, 2), "near": (minhash.one_of_each, 1), "clean": (lambda d: decontam.clean_documents(d, items), 1)}
    got = {}
    for name, (stage, scans) in stages.items():
        out = stage(docs)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("text#") and plan.count(f"Relation [{docs.columns[0]}#") <= scans + 1, plan  # and the narrow scan of ids
        got[name] = Counter(tuple(r) for r in out.collect())
    monkeypatch.setattr(common, "FEW", -1)
    for name, (stage, _) in stages.items():
        assert Counter(tuple(r) for r in stage(docs).collect()) == got[name], name
    assert sum(got["exact"].values()) < len(rows) and sum(got["near"].values()) < len(rows) and sum(got["clean"].values()) == len(rows) - 1
