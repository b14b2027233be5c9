"""Payload shapes, response parsing, the injected-client runner."""

import json

from pyspark.sql import functions as F

from quarry.operators import inference


def test_payloads(spark):
    df = spark.createDataFrame([("hi",)], "q string")
    chat = json.loads(df.select(inference.chat_request(F.col("q"), "sys")).first()[0])
    assert chat == {"model": "text-davinci-003", "messages": [{"role": "system", "content": "sys"},
                                                             {"role": "user", "content": "hi"}],
                    "max_tokens": -1, "temperature": 0}
    sw = json.loads(df.select(inference.search_words_request(F.col("q"))).first()[0])
    assert sw["seed"] == 1234 and sw["messages"][0]["content"].endswith("\n\nhi")
    emb = json.loads(df.select(inference.embedding_request(F.col("q"), "m")).first()[0])
    assert emb == {"model": "m", "input": "hi"}


def test_parsers(spark):
    df = spark.createDataFrame([('{"data":[{"embedding":[1.5,2]}]}',), ('{"data":[]}',), ("nope",), ("{}",)], "b string")
    v, e = inference.parse_embedding_response(F.col("b"))
    got = [(r[0], r[1]) for r in df.select(v, e).collect()]
    assert got == [([1.5, 2.0], None), (None, inference.ERR_NO_RESPONSE), (None, inference.ERR_BAD_RESPONSE),
                   (None, inference.ERR_NO_RESPONSE)]
    c = spark.createDataFrame([('{"choices":[{"message":{"role":"a","content":"x"}}]}',)], "b string")
    content, err = inference.parse_chat_response(F.col("b"))
    assert c.select(content, err).first() == ("x", None)


def test_run_model_isolates_failures(spark):
    def _stub_factory():  # nested: shipped to the workers by value
        def client(batch):
            if any(p == "boom" for p in batch):
                raise RuntimeError("bad request")
            return [p.upper() for p in batch]
        return client

    df = spark.createDataFrame([(i, "boom" if i == 3 else f"r{i}") for i in range(10)], "id long, req string")
    out = {r.id: (r.response, r.error) for r in inference.run_model(df, "req", _stub_factory, "id", 4).collect()}
    assert out[1] == ("R1", None)
    assert out[3][0] is None and "bad request" in out[3][1]
    assert sum(1 for v in out.values() if v[1] is None) == 9


def test_answer_questions_end_to_end(spark):
    from conftest import SF_SMALL
    from quarry.operators.answer import answer_questions
    from quarry.sources import kb
    from quarry.sources.tables import Catalog

    def factory():  # stub model: cites the first document of its prompt
        import json as _json
        import re as _re

        def client(batch):
            out = []
            for payload in batch:
                prompt = _json.loads(payload)["messages"][1]["content"]
                m = _re.search(r'"id":(\d+)', prompt)
                text = f"see [citation]{m.group(1)}[/citation]" if m else "I'm sorry."
                out.append(_json.dumps({"choices": [{"message": {"role": "assistant", "content": text}}]}))
            return out
        return client

    cat = Catalog(spark, SF_SMALL)
    answers = answer_questions(kb.queries(cat), kb.datasets(cat), kb.documents(cat), factory, "sys").cache()
    got = [json.loads(r.json)["response"] for r in answers.where("error is null").collect()]
    assert got and any(a.startswith("see [Document ") for a in got)
    assert all("[citation]" not in a for a in got)
    assert answers.where(F.col("error") == "word limit must be greater than zero").count() > 0
    assert answers.count() == kb.queries(cat).count()


def test_every_question_is_asked_once_and_nothing_is_mixed(spark, tmp_path):
    """A client that counts its calls and answers differently each time."""
    from conftest import SF_SMALL
    from quarry.operators.answer import answer_questions
    from quarry.sources import kb
    from quarry.sources.tables import Catalog

    folder = str(tmp_path)

    def factory():
        import json as _json
        import re as _re
        import uuid as _uuid

        def client(batch):
            out = []
            for payload in batch:
                call = _uuid.uuid4().hex
                open(f"{folder}/{call}", "w").close()
                ids = _re.findall(r'"id":([0-9]+)', _json.loads(payload)["messages"][1]["content"])
                text = call + "".join(f" [citation]{i}[/citation] {call}" for i in ids)
                out.append(_json.dumps({"choices": [{"message": {"role": "assistant", "content": text}}]}))
            return out
        return client

    cat = Catalog(spark, SF_SMALL)
    rows_ = answer_questions(kb.queries(cat), kb.datasets(cat), kb.documents(cat), factory, "sys").collect()
    replies = [json.loads(r.json)["response"] for r in rows_ if r.error is None]
    calls = {p.name for p in tmp_path.iterdir()}
    assert len(calls) == len(replies) and {r[:32] for r in replies} == calls
    for r in replies:
        assert r.count(r[:32]) == r.count("](") + 1 and "[citation]" not in r


def test_embed_with_model(spark):
    from quarry.operators import embed

    def factory():
        import json as _json

        def client(batch):
            return [_json.dumps({"data": [{"embedding": [float(len(_json.loads(p)["input"]))]}]}) for p in batch]
        return client

    df = spark.createDataFrame([(1, "ab"), (2, "abc")], "id long, t string")
    got = {r.id: r.vector for r in embed.with_model(df, "id", "t", factory).collect()}
    assert got == {1: [2.0], 2: [3.0]}


def test_hashed_bag_of_words(spark):
    from quarry.operators import embed

    df = spark.createDataFrame([(1, "a b a"), (2, "A B a"), (3, "other words here")], "id long, t string")
    got = {r.id: r.vector for r in embed.hashed_bag_of_words(df, "id", "t", 16).collect()}
    assert got[1] == got[2]  # case-insensitive, order-free
    assert abs(sum(x * x for x in got[3]) - 1.0) < 1e-5 and len(got[3]) == 16
