"""Document JSON, prompts, citations (FIXTURES.md section 4)."""

from pyspark.sql import functions as F

from quarry.functions.text import document_json
from quarry.operators import context


def test_document_json_shapes_and_escapes(spark):
    df = spark.createDataFrame([(1, 2, "<a&b>", "", "x"), (3, 4, "t", "http://u", "y ")],
                               "id long, dataset_id long, title string, url string, body string")
    got = dict(df.select("id", document_json()).collect())
    assert got[1] == '{"id":1,"dataset_id":2,"title":"\\u003ca\\u0026b\\u003e","body":"x","vector":null}'
    assert got[3] == '{"id":3,"dataset_id":4,"title":"t","url":"http://u","body":"y\\u2028","vector":null}'


def test_prompts_with_and_without_hits(spark):
    req = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 2, 10, 1, "B", "", "second"), (1, 1, 11, 1, "A", "u", "first")],
                                 "query_id long, rank int, id long, dataset_id long, title string, url string, body string")
    got = dict(context.build_prompts(req, hits).collect())
    assert got[2] == "Search results: \nNo results \n\nhow?"
    first = got[1].index('"first"')
    second = got[1].index('"second"')
    assert first < second and got[1].startswith("Search results: \n```json\n{") and got[1].endswith("```\n\nwhy?")


def test_search_response_keeps_empty(spark):
    req = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame([(1, 1, "T", None, "b")], "query_id long, rank int, title string, url string, body string")
    got = dict(context.search_responses(req, hits).collect())
    assert got[2] == '{"responses":[]}'
    assert got[1] == '{"responses":[{"title":"T","url":"","text":"b"}]}'


def test_citations(spark):
    text = ("a [citation]1[/citation] b [citation]1[/citation] c [citation]9[/citation] "
            "d [citation]123456789012345678901[/citation] e\\nf")
    replies = spark.createDataFrame([(1, text), (2, "none")], "reply_id long, response string")
    ctx = spark.createDataFrame([(1, 1, "T$1", "http://x")], "reply_id long, id long, title string, url string")
    got = dict(context.resolve_citations(replies, ctx).collect())
    assert got[1] == ("a [T$1](http://x) b [T$1](http://x) c [citation]9[/citation] "
                      "d [citation]123456789012345678901[/citation] e\nf")
    assert got[2] == "none"
    cites = context.extract_citations(replies).where(F.col("reply_id") == 1).collect()
    assert [(r.position, r.cited_id) for r in cites] == [(1, "1"), (2, "1"), (3, "9"), (4, "123456789012345678901")]


def test_answer_json_escapes(spark):
    df = spark.createDataFrame([(1, "a<b>&\n")], "reply_id long, response string")
    assert context.answer_json(df).first()["json"] == '{"response":"a\\u003cb\\u003e\\u0026\\n"}'
