"""Retrieved rows -> prompts and responses; replies -> resolved citations.

Every per-query aggregate here collects the *winners* of one query, whose
count is bounded by k or by the word budget, or the pieces of one reply, so no
group is unbounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import defaults as D
from quarry.functions.text import JSON_KEEP_NULLS, document_json, go_escape, markdown_link, unescape_newlines


def ordered_join(rank_col: str, text_col: str):
    """Aggregate: texts concatenated in rank order (array_sort of structs)."""
    return ordered_join_sep(rank_col, text_col, "")


def ordered_join_sep(rank_col: str, text_col: str, sep: str):
    """Aggregate: texts joined with ``sep`` in rank order."""
    items = F.array_sort(F.collect_list(F.struct(F.col(rank_col).alias("r"), F.col(text_col).alias("t"))))
    return F.array_join(F.transform(items, lambda x: x["t"]), sep)


def build_prompts(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """One prompt per accepted request.

    ``requests``: query_id, query (and model, which is kept). ``hits``: query_id, rank, id, dataset_id,
    title, url, body (the budget winners). Requests without hits get the
    "No results" line.
    """
    blocks = hits.select(
        "query_id", "rank",
        F.concat(F.lit(D.PROMPT_DOC_OPEN), document_json(), F.lit(D.PROMPT_DOC_CLOSE)).alias("block"))
    per_query = blocks.groupBy("query_id").agg(ordered_join("rank", "block").alias("docs"))
    joined = requests.join(per_query, "query_id", "left")
    prompt = F.concat(F.lit(D.PROMPT_HEADER),
                      F.when(F.col("docs").isNull(), F.lit(D.PROMPT_NO_RESULTS)).otherwise(F.lit("")),
                      F.coalesce(F.col("docs"), F.lit("")),
                      F.col("query"))
    return joined.select("query_id", prompt.alias("prompt"), *(["model"] if "model" in requests.columns else []))


def search_responses(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """{"responses":[{"title","url","text"}...]} per accepted request; [] when none."""
    item = F.struct(F.col("title"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
                    F.col("body").alias("text"))
    per_query = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), item.alias("i")))).alias("items"))
    joined = requests.select("query_id").join(per_query, "query_id", "left")
    responses = F.coalesce(F.transform("items", lambda x: x["i"]),
                           F.array().cast("array<struct<title:string,url:string,text:string>>"))
    payload = go_escape(F.to_json(F.struct(responses.alias("responses")), JSON_KEEP_NULLS))
    return joined.select("query_id", payload.alias("json"))


def extract_citations(replies: DataFrame, text_col: str = "response") -> DataFrame:
    """reply_id, position (1-based), cited_id (digits as written)."""
    ids = F.regexp_extract_all(F.col(text_col), F.lit(D.CITATION_PATTERN), 1)
    return (replies.select("reply_id", F.posexplode(ids).alias("pos", "cited_id"))
            .select("reply_id", (F.col("pos") + 1).alias("position"), "cited_id"))


def resolve_citations(replies: DataFrame, context: DataFrame, scope: str = "reply_id") -> DataFrame:
    """Rewrite each citation to a markdown link of the cited context document.

    ``replies``: reply_id, response and any other columns, which are kept.
    ``context``: id, title, url and ``scope``: the rows a reply may cite are
    those with its value of ``scope`` (the reply itself, or its dataset).
    Unknown or unparsable ids stay verbatim; afterwards literal backslash-n
    becomes a newline (also inside titles, as in the service).

    The replies are read once: each is cut into (text, citation) pieces, the
    pieces look up their document by (scope, id), and are joined up again.
    """
    rest = [c for c in replies.columns if c not in ("reply_id", "response")]
    found = F.regexp_extract_all("response", F.lit(D.CITATION_PATTERN), 0)
    ids = F.regexp_extract_all("response", F.lit(D.CITATION_PATTERN), 1)
    cut = F.arrays_zip(F.split("response", D.CITATION_PATTERN, -1).alias("text"), found.alias("match"), ids.alias("cid"))
    pieces = (replies.select("reply_id", *rest, F.posexplode_outer(cut).alias("pos", "c"))
              .select("reply_id", *rest, "pos", F.col("c.text").alias("text"), F.col("c.match").alias("match"),
                      F.col("c.cid").try_cast("bigint").alias("cid")))
    # a document id names one document: repeated context rows must not repeat a piece
    cited = context.select(F.col(scope).alias("_scope"), F.col("id").alias("_id"), markdown_link("title", "url").alias("link"))
    cited = cited.dropDuplicates(["_scope", "_id"])
    linked = pieces.join(cited, (F.col(scope) == F.col("_scope")) & (F.col("cid") == F.col("_id")), "left")
    part = F.concat(F.col("text"), F.coalesce("link", "match", F.lit("")))
    whole = linked.groupBy("reply_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"),
        *[F.first(c).alias(c) for c in rest])  # pieces of one reply: their number follows its own length
    text = F.array_join(F.transform("parts", lambda x: x["part"]), "")
    return whole.select("reply_id", F.when(F.col("parts")[0]["pos"].isNotNull(), unescape_newlines(text)).alias("response"), *rest)


def response_json(text_col: str):
    """{"response": text}, escaped as the service does."""
    return go_escape(F.to_json(F.struct(F.col(text_col).alias("response"))))


def answer_json(answers: DataFrame, id_col: str = "reply_id", text_col: str = "response") -> DataFrame:
    return answers.select(id_col, response_json(text_col).alias("json"))


def documents_json(docs: DataFrame) -> DataFrame:
    return docs.select("id", document_json().alias("json"))
