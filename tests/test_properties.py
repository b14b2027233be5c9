"""Hypothesis: the exact pre-limit equals the literal full-window plan."""

from hypothesis import HealthCheck, given, settings
from pyspark.sql import functions as F
from hypothesis import strategies as st

from conftest import rows
from test_retrieve import _budget, _full_window

doc = st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(1, 4))  # vector x, y (ties), words


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(doc, min_size=1, max_size=25), budget=st.integers(1, 12), qx=st.integers(0, 2))
def test_prelimit_equals_full_window(spark, docs, budget, qx):
    data = [(i + 1, 1, " ".join(["w"] * n), [float(x), float(y)]) for i, (x, y, n) in enumerate(docs)]
    queries = [(1, "q", [float(qx), 0.0], 7, "x", budget)]
    ds = [(1, 7, "x")]
    fast = _budget(spark, data, queries, ds)
    slow = _full_window(spark, data, queries, ds)
    assert rows(fast, "id", "cumulative_words") == rows(slow, "id", "c")


def _brute_resolve(text, ctx):
    """Straight Python version of the service's rewrite, for comparison."""
    import re

    def rep(m):
        try:
            i = int(m.group(1))
        except ValueError:
            return m.group(0)
        if i >= 2 ** 63:
            return m.group(0)
        return f"[{ctx[i][0]}]({ctx[i][1]})" if i in ctx else m.group(0)
    return re.sub(r"\[citation\](\d+)\[/citation\]", rep, text).replace("\\n", "\n")


piece = st.sampled_from(["a ", "b\\n", "[citation]1[/citation]", "[citation]2[/citation]", "[citation]9[/citation]",
                         "[citation]123456789012345678901[/citation]", "[citation]x[/citation]", "$1 ", "\n"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(piece, max_size=8).map("".join), min_size=1, max_size=5))
def test_citations_match_brute_force(spark, texts):
    from quarry.operators import context

    ctx = {1: ("T$1", "http://a"), 2: ("B\\nC", "")}
    replies = spark.createDataFrame(list(enumerate(texts)), "reply_id long, response string")
    cdf = spark.createDataFrame([(r, i, t, u) for r in range(len(texts)) for i, (t, u) in ctx.items()],
                                "reply_id long, id long, title string, url string")
    got = dict(context.resolve_citations(replies, cdf).collect())
    assert got == {i: _brute_resolve(t, ctx) for i, t in enumerate(texts)}


def _brute_url(url):
    import re
    from urllib.parse import parse_qsl, urlsplit

    first = {}
    for k, v in parse_qsl(urlsplit(url).query, keep_blank_values=True):
        first.setdefault(k, v)
    q, lim, ds = first.get("query", ""), first.get("limit", ""), first.get("dataset", "")
    k = int(lim) if re.fullmatch(r"[+-]?[0-9]+", lim) and -2**63 <= int(lim) < 2**63 else 5
    err = "empty query" if q == "" else ("k must be greater than zero" if k <= 0 else None)
    return q, k, ds or "default", err


param = st.sampled_from(["query=a+b", "query=%C3%A9t%C3%A9", "query=", "limit=7", "limit=%2B7", "limit=+7",
                         "limit=7x", "limit=0", "limit=-3", "dataset=ds1", "dataset=", "x=1", "query=second"])


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(urls=st.lists(st.lists(param, min_size=1, max_size=5).map(lambda ps: "/query?" + "&".join(ps)),
                     min_size=1, max_size=6))
def test_url_parsing_matches_brute_force(spark, urls):
    from quarry.operators import validate

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id long, url string")
    got = {r.id: (r.query, r.k, r.dataset, r.error) for r in validate.parse_search_urls(df).collect()}
    assert got == {i: _brute_url(u) for i, u in enumerate(urls)}


def _brute_doc_json(i, ds, title, url, body):
    import json

    doc = {"id": i, "dataset_id": ds, "title": title}
    if url:
        doc["url"] = url
    doc.update({"body": body, "vector": None})
    s = json.dumps(doc, ensure_ascii=False, separators=(",", ":"))
    for raw, esc in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        s = s.replace(raw, esc)
    return s


chars = st.lists(st.sampled_from(["a", "<", ">", "&", '"', "\\", "\n", "\t", "é", "\u2028", "$1", " "]),
                 max_size=10).map("".join)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(docs=st.lists(st.tuples(chars, st.sampled_from(["", "http://x/a?b=1&c=2"]), chars), min_size=1, max_size=6))
def test_document_json_matches_brute_force(spark, docs):
    from quarry.functions.text import document_json

    data = [(i, i % 3, t, u, b) for i, (t, u, b) in enumerate(docs)]
    df = spark.createDataFrame(data, "id long, dataset_id long, title string, url string, body string")
    got = dict(df.select("id", document_json()).collect())
    assert got == {i: _brute_doc_json(i, d, t, u, b) for i, d, t, u, b in data}


def _brute_topk(docs, q, k):
    import math

    def dist(v):
        acc = 0.0
        for a, b in zip(v, q):
            acc += (float(a) - float(b)) * (float(a) - float(b))
        return math.sqrt(acc)
    ranked = sorted((dist(v), i) for i, v in docs)
    return [(r + 1, i) for r, (_, i) in enumerate(ranked[:k])]


vec = st.lists(st.integers(-2, 2).map(float), min_size=3, max_size=3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vectors=st.lists(vec, min_size=1, max_size=30), q=vec, k=st.integers(1, 8))
def test_topk_matches_brute_force(spark, vectors, q, k):
    from quarry.functions.vectors import word_count
    from quarry.operators import retrieve, validate

    docs = [(i + 1, v) for i, v in enumerate(vectors)]
    d = spark.createDataFrame([(i, 1, "w", v) for i, v in docs],
                              "id long, dataset_id long, body string, vector array<float>")
    d = d.select("id", "dataset_id", "vector", word_count("body").alias("word_count"))
    req = validate.accepted(validate.search_requests(spark.createDataFrame(
        [(1, "q", q, 7, "x", None)],
        "query_id long, query string, query_vector array<float>, user_id long, dataset string, word_limit long")))
    req = req.withColumn("k", F.lit(k))
    ranked = retrieve.topk_search(req, spark.createDataFrame([(1, 7, "x")], "id long, user_id long, name string"),
                                   d)
    got = sorted((r["rank"], r["id"]) for r in ranked.collect())
    assert got == _brute_topk(docs, q, k)
