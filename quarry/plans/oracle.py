"""DuckDB oracle SQL for every registered query.

The knowledge-base tables are derived from the driver's tables by the same
rules as ``sources.kb``; the oracle has only the driver's tables registered,
so the derivations are inlined as CTEs.
"""

from __future__ import annotations

from quarry.functions import defaults as D

VIEWS: dict[str, str] = {
    "kb_users": """SELECT CAST(r_regionkey AS BIGINT) + 1 AS id, r_name AS username,
        r_regionkey <> 4 AS active FROM region""",
    "kb_datasets": """SELECT n + 1 AS id, n % 5 + 1 AS user_id, concat('ds', CAST(n % 4 AS VARCHAR)) AS name
        FROM (SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS n FROM documents) s""",
    "kb_documents": """SELECT d.doc_id + 1 AS id, CAST(substr(d.source, 4) AS BIGINT) + 1 AS dataset_id,
        concat('Document ', CAST(d.doc_id AS VARCHAR)) AS title,
        CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE concat('https://kb.example/', d.lang, '/', CAST(d.doc_id AS VARCHAR)) END AS url,
        d.text AS body, e.embedding AS vector
        FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id""",
    "kb_all_documents": """SELECT doc_id + 1 AS id, CAST(substr(source, 4) AS BIGINT) + 1 AS dataset_id,
        concat('Document ', CAST(doc_id AS VARCHAR)) AS title,
        CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('https://kb.example/', lang, '/', CAST(doc_id AS VARCHAR)) END AS url,
        text AS body FROM documents""",
    "kb_ties": """SELECT id, dataset_id, title, url, body, vector FROM kb_documents
        UNION ALL SELECT id + 1000000 AS id, dataset_id, title, url, body, vector FROM kb_documents""",
    "kb_queries": """SELECT e.vec_id AS query_id, b.text AS query, e.embedding AS query_vector,
        (e.vec_id * 7 + 3) % 5 + 1 AS user_id,
        CASE WHEN e.vec_id % 13 = 0 THEN 'missing' WHEN e.vec_id % 11 = 0 THEN ''
             ELSE concat('ds', CAST((e.vec_id * 7 + 3) % 4 AS VARCHAR)) END AS dataset,
        CASE WHEN e.vec_id % 3 = 0 THEN NULL WHEN e.vec_id % 31 = 5 THEN 3000000000
             ELSE CAST(100 * (e.vec_id % 17) AS BIGINT) END AS word_limit
        FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id""",
    "kb_planted_queries": """SELECT * REPLACE (CASE query_id % 19 WHEN 4 THEN list_append(query_vector, CAST('nan' AS FLOAT))
             WHEN 5 THEN list_append(query_vector, CAST(NULL AS FLOAT)) WHEN 6 THEN list_append(query_vector, CAST('inf' AS FLOAT))
             WHEN 7 THEN query_vector[1:32] ELSE query_vector END AS query_vector) FROM kb_queries""",
    "kb_access_tokens": """SELECT c.c_custkey AS id, c.c_custkey % 5 + 1 AS user_id,
        md5(CAST(c.c_custkey AS VARCHAR)) AS token, o.last_order + INTERVAL '1' YEAR AS expiration
        FROM customer c JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) o
        ON o.o_custkey = c.c_custkey""",
    "kb_requests": """SELECT event_id AS request_id, ts,
        CASE WHEN event_id % 10 = 0 THEN NULL
             WHEN event_id % 10 = 1 THEN concat('Token ', md5(CAST(user_id AS VARCHAR)))
             ELSE concat('Bearer ', md5(CAST(user_id AS VARCHAR))) END AS auth_header FROM events""",
    "kb_token_lifetimes": """SELECT md5(CAST(o_custkey AS VARCHAR)) AS token, o_custkey % 5 + 1 AS user_id, o_orderdate AS issued,
        o_orderdate + INTERVAL '1' YEAR AS expiration FROM orders""",
    "kb_timed_requests": """SELECT request_id, auth_header,
        TIMESTAMP '1995-01-01 00:00:00' + to_seconds(80 * CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) AS BIGINT)) AS ts FROM kb_requests""",
    "kb_messages": """SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, role, text AS content FROM conversations""",
    "kb_replies": """SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS reply_id, conv_id, concat(text, ' [citation]', CAST(conv_id % 700 + 1 AS VARCHAR),
        '[/citation] and [citation]', CAST(conv_id % 7 + 1 AS VARCHAR), '[/citation]') AS response
        FROM conversations WHERE role = 'assistant'""",
    "kb_context": """SELECT r.reply_id, d.id, d.title, d.url FROM kb_replies r
        JOIN kb_documents d ON d.dataset_id = r.conv_id % 20 + 1""",
}

DEPS: dict[str, tuple[str, ...]] = {
    "kb_ties": ("kb_documents",),
    "kb_context": ("kb_replies", "kb_documents"),
    "kb_planted_queries": ("kb_queries",),
    "kb_timed_requests": ("kb_requests",),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPS.get(n, ()):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def with_views(views, steps, final: str) -> str:
    """WITH <views in dependency order>, <steps> <final>."""
    parts = [f"{n} AS ({VIEWS[n]})" for n in _order(views)]
    parts += [f"{n} AS ({s})" for n, s in steps]
    return "WITH " + ",\n".join(parts) + "\n" + final


def l2(v: str, q: str) -> str:
    """Left-to-right DOUBLE fold, bit-identical to ``functions.vectors.l2_distance``."""
    sq = "(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))"
    return (f"sqrt(list_reduce(list_transform(list_zip({v}, {q}), lambda p: {sq}), "
            f"lambda s, x: s + x, CAST(0 AS DOUBLE)))")


def word_count(body: str) -> str:
    return f"CAST(len(regexp_split_to_array({body}, '\\s+')) AS BIGINT)"


def bad_element(v: str) -> str:
    return f"COALESCE(list_bool_or(list_transform({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))), false)"


# Accepted answer requests with defaults (dataset '' -> 'default', limit NULL -> 512).
ANSWER_REQUESTS = ("answer_requests", f"""SELECT query_id, query, query_vector, user_id,
        COALESCE(NULLIF(dataset, ''), '{D.DEFAULT_DATASET}') AS dataset,
        COALESCE(word_limit, {D.DEFAULT_WORD_LIMIT}) AS word_limit
        FROM kb_queries
        WHERE COALESCE(query, '') <> '' AND COALESCE(len(query_vector), 0) > 0
          AND NOT {bad_element('query_vector')} AND COALESCE(word_limit, {D.DEFAULT_WORD_LIMIT}) > 0""")

# Every planted request with its reason, in the order of the guards.
GUARDED = [
    ("dims", "SELECT dataset_id, list(DISTINCT len(vector)) AS dims FROM kb_documents GROUP BY dataset_id"),
    ("guarded", f"""SELECT *, COALESCE(NULLIF(dataset, ''), '{D.DEFAULT_DATASET}') AS ds_name,
        COALESCE(word_limit, {D.DEFAULT_WORD_LIMIT}) AS lim,
        CASE WHEN COALESCE(query, '') = '' THEN '{D.ERR_EMPTY_QUERY}'
             WHEN COALESCE(len(query_vector), 0) <= 0 THEN '{D.ERR_EMPTY_VECTOR}'
             WHEN {bad_element('query_vector')} THEN '{D.ERR_BAD_VECTOR}'
             WHEN COALESCE(word_limit, {D.DEFAULT_WORD_LIMIT}) <= 0 THEN '{D.ERR_BAD_BUDGET}' END AS reason
        FROM kb_planted_queries"""),
    ("judged", f"""SELECT g.query_id, g.query, g.query_vector, g.user_id, g.ds_name AS dataset, g.lim AS word_limit,
        COALESCE(g.reason, CASE WHEN d.dims IS NOT NULL AND len(list_filter(d.dims, lambda x: x <> len(g.query_vector))) > 0
                                THEN '{D.ERR_DIMENSION}' END) AS error
        FROM guarded g LEFT JOIN kb_datasets ds ON g.reason IS NULL AND ds.name = g.ds_name AND ds.user_id = g.user_id
        LEFT JOIN dims d ON d.dataset_id = ds.id"""),
]


def _budget(doc_view: str) -> str:
    pairs = ("budget_pairs", f"""SELECT r.query_id, d.id, r.word_limit, {word_count('d.body')} AS word_count,
        {l2('d.vector', 'r.query_vector')} AS distance
        FROM answer_requests r JOIN kb_datasets ds ON ds.name = r.dataset AND ds.user_id = r.user_id
        JOIN {doc_view} d ON d.dataset_id = ds.id
        WHERE len(d.vector) = len(r.query_vector)""")
    ranked = ("budget_ranked", """SELECT *,
        ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn,
        SUM(word_count) OVER (PARTITION BY query_id ORDER BY distance
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM budget_pairs""")
    final = """SELECT query_id, CAST(rn AS INTEGER) AS rank, id, word_count,
        CAST(cum AS BIGINT) AS cumulative_words, round(distance, 6) AS distance
        FROM budget_ranked WHERE cum <= word_limit"""
    return with_views(["kb_queries", "kb_datasets", doc_view], [ANSWER_REQUESTS, pairs, ranked], final)


ORACLE: dict[str, str] = {
    "budget_search": _budget("kb_documents"),
    "budget_search_ties": _budget("kb_ties"),
    "budget_search_stored": f"""SELECT b.*, concat('Document ', CAST(b.id - 1 AS VARCHAR)) AS title FROM ({_budget("kb_documents")}) b""",
}

NL = "\n"
CITATION = D.CITATION_PATTERN


def go_escape(expr: str) -> str:
    """Same replacements as ``functions.text.go_escape``."""
    for raw, esc in D.GO_JSON_ESCAPES:
        expr = f"replace({expr}, chr({ord(raw)}), '{esc}')"
    return expr


def doc_json(a: str = "") -> str:
    """The service's document JSON (url omitted when '', vector null)."""
    p = f"{a}." if a else ""
    with_url = (f"to_json({{'id': {p}id, 'dataset_id': {p}dataset_id, 'title': {p}title, "
                f"'url': {p}url, 'body': {p}body, 'vector': CAST(NULL AS FLOAT[])}})::VARCHAR")
    without = (f"to_json({{'id': {p}id, 'dataset_id': {p}dataset_id, 'title': {p}title, "
               f"'body': {p}body, 'vector': CAST(NULL AS FLOAT[])}})::VARCHAR")
    return go_escape(f"CASE WHEN COALESCE({p}url, '') = '' THEN {without} ELSE {with_url} END")


SEARCH_REQUESTS = ("search_requests", f"""SELECT query_id, query, query_vector, user_id,
        COALESCE(NULLIF(dataset, ''), '{D.DEFAULT_DATASET}') AS dataset, {D.DEFAULT_TOP_K} AS k
        FROM kb_queries
        WHERE COALESCE(query, '') <> '' AND COALESCE(len(query_vector), 0) > 0 AND NOT {bad_element('query_vector')}""")

TOPK_RANKED = ("topk_ranked", f"""SELECT * FROM (
        SELECT r.query_id, d.id, d.title, d.url, d.body, {l2('d.vector', 'r.query_vector')} AS distance,
               ROW_NUMBER() OVER (PARTITION BY r.query_id ORDER BY {l2('d.vector', 'r.query_vector')}, d.id) AS rn
        FROM search_requests r JOIN kb_datasets ds ON ds.name = r.dataset AND ds.user_id = r.user_id
        JOIN kb_documents d ON d.dataset_id = ds.id
        WHERE len(d.vector) = len(r.query_vector)) t WHERE rn <= 5""")

BUDGET_WINNERS = [
    ("budget_pairs", f"""SELECT r.query_id, d.id, d.dataset_id, d.title, d.url, d.body, r.word_limit,
        {word_count('d.body')} AS word_count, {l2('d.vector', 'r.query_vector')} AS distance
        FROM answer_requests r JOIN kb_datasets ds ON ds.name = r.dataset AND ds.user_id = r.user_id
        JOIN kb_documents d ON d.dataset_id = ds.id
        WHERE len(d.vector) = len(r.query_vector)"""),
    ("budget_ranked", """SELECT *,
        ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn,
        SUM(word_count) OVER (PARTITION BY query_id ORDER BY distance
                              RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM budget_pairs"""),
    ("budget_winners", "SELECT * FROM budget_ranked WHERE cum <= word_limit"),
]

PROMPT_STEPS = [*BUDGET_WINNERS,
    ("blocks", f"""SELECT query_id, string_agg('{D.PROMPT_DOC_OPEN}' || {doc_json()} || '{D.PROMPT_DOC_CLOSE}', '' ORDER BY rn) AS docs,
        min_by(id, rn) AS first_id, min_by('[' || title || '](' || COALESCE(url, '') || ')', rn) AS first_link
        FROM budget_winners GROUP BY query_id"""),
    ("prompts", f"""SELECT r.query_id, b.first_id, b.first_link,
        '{D.PROMPT_HEADER}' || CASE WHEN b.docs IS NULL THEN '{D.PROMPT_NO_RESULTS}' ELSE '' END
        || COALESCE(b.docs, '') || r.query AS prompt
        FROM answer_requests r LEFT JOIN blocks b ON b.query_id = r.query_id""")]
PROMPTS = with_views(["kb_queries", "kb_datasets", "kb_documents"], [ANSWER_REQUESTS, *PROMPT_STEPS],
                     "SELECT query_id, prompt FROM prompts")

# The stand-in client of ``queries.citing_client``: one question in nine gets no choice.
ANSWERS = with_views(["kb_planted_queries", "kb_datasets", "kb_documents"], [*GUARDED,
    ("answer_requests", "SELECT * FROM judged WHERE error IS NULL"), *PROMPT_STEPS,
    ("replied", f"""SELECT query_id, length(prompt) % 9 = 0 AS failed, 'n=' || CAST(length(prompt) AS VARCHAR) || ' '
            || COALESCE(first_link, 'none') || ' [citation]0[/citation]{NL}.' AS response FROM prompts""")],
    f"""SELECT query_id, CASE WHEN NOT failed THEN {go_escape("to_json({'response': response})::VARCHAR")} END AS json,
        CASE WHEN failed THEN 'no response from model server' END AS error FROM replied
        UNION ALL SELECT query_id, NULL AS json, error FROM judged WHERE error IS NOT NULL""")

RESOLVE_STEPS = [
    ("cite_src", f"""SELECT reply_id, string_split_regex(response, '{CITATION}') AS pieces,
        regexp_extract_all(response, '{CITATION}', 1) AS ids,
        regexp_extract_all(response, '{CITATION}', 0) AS ms FROM kb_replies"""),
    ("cite_rows", """SELECT reply_id, unnest(range(1, len(pieces) + 1)) AS k, unnest(pieces) AS piece,
        unnest(list_append(ids, NULL)) AS cid, unnest(list_append(ms, '')) AS m FROM cite_src"""),
    ("cite_joined", """SELECT u.reply_id, u.k, u.piece || CASE WHEN u.cid IS NULL THEN ''
            WHEN c.title IS NOT NULL THEN '[' || c.title || '](' || COALESCE(c.url, '') || ')' ELSE u.m END AS part
        FROM cite_rows u LEFT JOIN kb_context c ON c.reply_id = u.reply_id AND c.id = TRY_CAST(u.cid AS BIGINT)"""),
    ("resolved", f"""SELECT reply_id, replace(string_agg(part, '' ORDER BY k), '\\n', '{NL}') AS response
        FROM cite_joined GROUP BY reply_id"""),
]

ORACLE.update({
    "vector_distance": with_views(["kb_queries", "kb_datasets", "kb_documents"], [],
        f"""SELECT query_id, count(*) AS n, round(min(distance), 6) AS nearest, round(max(distance), 6) AS farthest,
            round(avg(distance), 6) AS mean
        FROM (SELECT q.query_id, d.id, {l2('d.vector', 'q.query_vector')} AS distance
              FROM kb_queries q JOIN kb_datasets ds ON ds.name = COALESCE(NULLIF(q.dataset, ''), 'default')
                   AND ds.user_id = q.user_id
              JOIN kb_documents d ON d.dataset_id = ds.id WHERE len(d.vector) = len(q.query_vector)) t
        GROUP BY query_id"""),
    "word_count": f"SELECT doc_id, {word_count('text')} AS word_count FROM documents",
    "topk_single": with_views(["kb_queries", "kb_datasets", "kb_documents"], [SEARCH_REQUESTS,
        ("one", """SELECT r.query_vector, ds.id AS dataset_id FROM search_requests r
            JOIN kb_datasets ds ON ds.name = r.dataset AND ds.user_id = r.user_id ORDER BY r.query_id LIMIT 1""")],
        f"""SELECT d.id, d.title, d.url, round({l2('d.vector', 'o.query_vector')}, 6) AS distance
        FROM kb_documents d JOIN one o ON o.dataset_id = d.dataset_id
        WHERE len(d.vector) = len(o.query_vector)
        ORDER BY {l2('d.vector', 'o.query_vector')}, d.id LIMIT 5"""),
    "topk_search": with_views(["kb_queries", "kb_datasets", "kb_documents"], [SEARCH_REQUESTS, TOPK_RANKED],
        """SELECT query_id, CAST(rn AS INTEGER) AS rank, id, title, url, round(distance, 6) AS distance
        FROM topk_ranked"""),
    "topk_pruned": with_views(["kb_queries", "kb_datasets", "kb_documents"], [SEARCH_REQUESTS, TOPK_RANKED],
        """SELECT query_id, CAST(rn AS INTEGER) AS rank, id, round(distance, 6) AS distance FROM topk_ranked"""),
    "search_response_json": with_views(["kb_queries", "kb_datasets", "kb_documents"], [SEARCH_REQUESTS, TOPK_RANKED,
        ("items", """SELECT query_id, list({'title': title, 'url': COALESCE(url, ''), 'text': body} ORDER BY rn) AS items
            FROM topk_ranked GROUP BY query_id""")],
        "SELECT r.query_id, " + go_escape("to_json({'responses': COALESCE(i.items, [])})::VARCHAR")
        + " AS json FROM search_requests r LEFT JOIN items i ON i.query_id = r.query_id"),
    "document_json": with_views(["kb_all_documents"], [], f"SELECT id, {doc_json()} AS json FROM kb_all_documents"),
    "build_prompts": PROMPTS,
    "extract_citations": with_views(["kb_replies"], [
        ("c", f"SELECT reply_id, regexp_extract_all(response, '{CITATION}', 1) AS ids FROM kb_replies")],
        """SELECT reply_id, CAST(unnest(range(1, len(ids) + 1)) AS INTEGER) AS position, unnest(ids) AS cited_id
        FROM c"""),
    "answer_questions": ANSWERS,
    "stream_answers": ANSWERS,
    "resolve_citations": with_views(["kb_context"], RESOLVE_STEPS, "SELECT reply_id, response FROM resolved"),
    "answer_json": with_views(["kb_context"], RESOLVE_STEPS,
        "SELECT reply_id, " + go_escape("to_json({'response': response})::VARCHAR") + " AS json FROM resolved"),
})

AS_OF = "TIMESTAMP '2002-02-13 00:00:00'"


# What each url says, stated beside it: the query is the passage (and what is planted
# behind it), the limit that of its first valid pair.
URLS = ("urls", """SELECT item_id AS request_id, text, CASE item_id % 8 WHEN 4 THEN '/query?query=%zz&query=' WHEN 5 THEN '/query?a;b=1&query=' ELSE '/query?query=' END
        || CASE WHEN item_id % 9 = 0 THEN '' ELSE url_encode(text) END
        || CASE item_id % 8 WHEN 1 THEN '|{x}' WHEN 2 THEN '&query=second' WHEN 3 THEN '&limit=7%0A' ELSE '' END
        || CASE item_id % 7 WHEN 0 THEN '&limit=7' WHEN 1 THEN '&limit=%2B7' WHEN 2 THEN '&limit=+7'
                            WHEN 3 THEN '&limit=7x' WHEN 4 THEN '' WHEN 5 THEN '&limit=0' ELSE '&limit=3000000000' END
        || CASE WHEN item_id % 4 = 0 THEN '' ELSE '&dataset=ds' || CAST(item_id % 4 AS VARCHAR) END AS url
        FROM benchmark""")

AUTH_STEPS = [
    ("live", f"SELECT user_id, token FROM kb_access_tokens WHERE expiration > {AS_OF}"),
    ("parsed", """SELECT request_id,
        CASE WHEN auth_header IS NULL OR auth_header = '' THEN 'authorization header is missing'
             WHEN NOT starts_with(auth_header, 'Bearer ') THEN 'invalid authorization header format' END AS reason,
        CASE WHEN starts_with(auth_header, 'Bearer ') THEN substr(auth_header, 8) END AS token
        FROM kb_requests"""),
]

SESSION_STEPS = [
    ("changes", """SELECT session_id AS id, (CAST(session_id AS BIGINT) + turn) % 5 + 1 AS user_id,
        content AS messages, 'model-' || CAST(turn % 3 AS VARCHAR) AS model, turn AS version FROM kb_messages"""),
    ("ordered", """SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY version DESC) AS rn_last,
        ROW_NUMBER() OVER (PARTITION BY id ORDER BY version) AS rn_first FROM changes WHERE COALESCE(id, '') <> ''"""),
    ("sessions", """SELECT l.id, f.user_id, l.model, l.messages, l.version FROM ordered l
        JOIN ordered f ON f.id = l.id AND f.rn_first = 1 WHERE l.rn_last = 1"""),
]

ORACLE.update({
    "validate_queries": with_views(["kb_planted_queries", "kb_datasets", "kb_documents"], GUARDED,
        "SELECT query_id, dataset, word_limit, error FROM judged"),
    "parse_query_urls": with_views([], [URLS, ("vals", """SELECT request_id,
            CASE WHEN request_id % 9 = 0 THEN '' ELSE text END || CASE WHEN request_id % 8 = 1 THEN '|{x}' ELSE '' END AS query,
            CASE WHEN request_id % 8 = 3 THEN '7' || chr(10) ELSE url_decode(replace(regexp_extract(url, '&limit=([^&#]*)', 1), '+', ' ')) END AS lim,
            CASE WHEN request_id % 4 = 0 THEN 'default' ELSE 'ds' || CAST(request_id % 4 AS VARCHAR) END AS dataset FROM urls"""),
        ("typed", """SELECT request_id, query, dataset,
            COALESCE(CASE WHEN regexp_full_match(lim, '[+-]?[0-9]+') AND NOT contains(lim, chr(10)) THEN TRY_CAST(lim AS BIGINT) END, 5) AS k FROM vals""")],
        """SELECT request_id, query, k, dataset,
        CASE WHEN query = '' THEN 'empty query' WHEN k <= 0 THEN 'k must be greater than zero' END AS error FROM typed"""),
    "live_access_tokens": with_views(["kb_access_tokens"], [],
        f"SELECT user_id, count(*) AS n FROM kb_access_tokens WHERE expiration > {AS_OF} GROUP BY user_id"),
    "issue_tokens": with_views(["kb_users"], [],
        f"""SELECT id AS user_id, sha256(concat('not a secret|', CAST(id AS VARCHAR), '|', CAST({AS_OF} AS VARCHAR))) AS token,
        {AS_OF} + INTERVAL '1' YEAR AS expiration FROM kb_users"""),
    "assign_session_ids": """SELECT session_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-4', substr(h, 14, 3), '-',
            substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS uuid
        FROM (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, sha256('quarry' || CAST(conv_id AS VARCHAR)) AS h FROM conversations) t""",
    "authorize_requests": with_views(["kb_access_tokens", "kb_requests"], AUTH_STEPS,
        """SELECT p.request_id, l.user_id FROM parsed p JOIN live l ON l.token = p.token WHERE p.reason IS NULL"""),
    "authorize_at_request_time": with_views(["kb_timed_requests", "kb_token_lifetimes"], [
        ("parsed", AUTH_STEPS[1][1].replace("SELECT request_id,", "SELECT request_id, ts,").replace("kb_requests", "kb_timed_requests")),
        ("live", """SELECT p.request_id, max(l.user_id) AS user_id FROM parsed p JOIN kb_token_lifetimes l
            ON l.token = p.token AND l.issued <= p.ts AND l.expiration > p.ts WHERE p.reason IS NULL GROUP BY p.request_id""")],
        """SELECT p.request_id, l.user_id, CASE WHEN l.request_id IS NULL THEN COALESCE(p.reason, 'invalid token') END AS reason
        FROM parsed p LEFT JOIN live l ON l.request_id = p.request_id"""),
    "unauthorized_requests": with_views(["kb_access_tokens", "kb_requests"], AUTH_STEPS,
        """SELECT request_id, reason FROM parsed WHERE reason IS NOT NULL
        UNION ALL
        SELECT p.request_id, 'invalid token' AS reason FROM parsed p
        WHERE p.reason IS NULL AND NOT EXISTS (SELECT 1 FROM live l WHERE l.token = p.token)"""),
    "session_messages": with_views(["kb_messages"], [], f"""SELECT session_id, count(*) AS n,
        string_agg(content, '{NL}' ORDER BY turn) AS messages FROM kb_messages GROUP BY session_id"""),
    "session_upsert": with_views(["kb_messages"], SESSION_STEPS,
        "SELECT id, user_id, model, messages, version FROM sessions"),
    "session_lookup": with_views(["kb_messages"], [*SESSION_STEPS, ("req", """SELECT conv_id AS request_id, turn,
            CASE WHEN conv_id % 7 = 0 THEN 'x' || CAST(conv_id AS VARCHAR) WHEN conv_id % 11 = 0 THEN ''
                 ELSE CAST(conv_id AS VARCHAR) END AS session_id FROM conversations""")],
        """SELECT q.request_id, q.turn, q.session_id, (s.model IS NOT NULL AND COALESCE(q.session_id, '') <> '') AS found,
        s.model, s.messages, CASE WHEN COALESCE(q.session_id, '') = '' THEN 'empty session id' END AS error
        FROM req q LEFT JOIN sessions s ON s.id = q.session_id"""),
})

ITEMS = ("items_src", """SELECT doc_id AS request_id, doc_id // 4 AS batch_id, item
        FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0
                THEN to_json({'title': 'Document ' || CAST(doc_id AS VARCHAR), 'body': text,
                              'dataset': 'ds' || CAST(doc_id % 4 AS VARCHAR)})::VARCHAR
                ELSE to_json({'title': 'Document ' || CAST(doc_id AS VARCHAR),
                              'url': 'https://kb.example/' || lang || '/' || CAST(doc_id AS VARCHAR), 'body': text,
                              'dataset': 'ds' || CAST(doc_id % 4 AS VARCHAR)})::VARCHAR END AS item
              FROM documents) s""")
PAYLOADS = ("payloads", """SELECT request_id, batch_id,
        CASE WHEN request_id % 13 = 0 THEN '{bad ' || item WHEN request_id % 17 = 0 THEN '{}' ELSE item END AS payload
        FROM items_src""")


def _field(src: str, f: str) -> str:
    return f"COALESCE(json_extract_string({src}, '$.{f}'), '')"


def planted_vector(i: str, v: str) -> str:
    """As ``queries.planted_vector``."""
    with_last = lambda x: f"list_append({v}[1:63], CAST({x} AS FLOAT))"
    return (f"CASE {i} WHEN 7 THEN CAST([] AS FLOAT[]) WHEN 8 THEN {with_last(chr(39) + 'nan' + chr(39))} WHEN 9 THEN {with_last('NULL')} "
            f"WHEN 11 THEN {with_last(chr(39) + 'inf' + chr(39))} WHEN 12 THEN {v}[1:32] ELSE {v} END")


def vector_digest(v: str) -> str:
    return (f"md5(array_to_string(list_transform({v}, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), ','))")


INGEST_REQUESTS = ("req", """SELECT doc_id AS request_id, doc_id % 5 + 1 AS user_id, concat('Document ', CAST(doc_id AS VARCHAR)) AS title,
        '' AS url, text AS body,
        COALESCE(NULLIF(CASE WHEN doc_id % 6 = 0 THEN '' WHEN doc_id % 9 = 0 THEN 'new' || CAST(doc_id % 3 AS VARCHAR)
                 ELSE 'ds' || CAST(doc_id % 4 AS VARCHAR) END, ''), 'default') AS dataset FROM documents""")
INGEST_STEPS = [
    ("vec", f"SELECT vec_id AS request_id, {planted_vector('vec_id % 50', 'embedding')} AS vector FROM embeddings"),
    ("emb", """SELECT r.*, v.vector, v.request_id IS NOT NULL AS embedded FROM req r LEFT JOIN vec v
        ON v.request_id = r.request_id"""),
    ("pairs", "SELECT DISTINCT dataset AS name, user_id FROM emb WHERE embedded"),
    ("newp", """SELECT p.* FROM pairs p WHERE NOT EXISTS
        (SELECT 1 FROM kb_datasets d WHERE d.name = p.name AND d.user_id = p.user_id)"""),
    ("created", """SELECT (SELECT max(id) FROM kb_datasets) + ROW_NUMBER() OVER (ORDER BY user_id, name) AS id, name, user_id
        FROM newp"""),
    ("resolved", """SELECT d.id, p.name, p.user_id, false AS created FROM pairs p
        JOIN kb_datasets d ON d.name = p.name AND d.user_id = p.user_id
        UNION ALL SELECT id, name, user_id, true AS created FROM created"""),
    ("first_dims", f"""SELECT dataset, user_id, min_by(len(vector), request_id) AS dim FROM emb
        WHERE embedded AND len(vector) > 0 AND NOT {bad_element('vector')} GROUP BY dataset, user_id"""),
    ("statuses", f"""SELECT e.*, r.id AS dataset_id,
        CASE WHEN NOT e.embedded THEN 'could not get document embedding' WHEN len(e.vector) = 0 THEN 'vector cannot be empty'
             WHEN {bad_element('e.vector')} THEN '{D.ERR_BAD_VECTOR}' WHEN len(e.vector) <> f.dim THEN '{D.ERR_DIMENSION}'
             ELSE 'accepted' END AS status
        FROM emb e LEFT JOIN resolved r ON r.name = e.dataset AND r.user_id = e.user_id
        LEFT JOIN first_dims f ON f.dataset = e.dataset AND f.user_id = e.user_id"""),
    ("numbered", """SELECT *, CASE WHEN status = 'accepted'
            THEN count(*) FILTER (WHERE status = 'accepted') OVER (ORDER BY request_id) END AS id FROM statuses"""),
]

PLANTED = [
    ("kd", "SELECT id, dataset_id, title, url, body, vector FROM kb_documents"),
    ("pdocs", """SELECT * FROM kd
        UNION ALL SELECT id, dataset_id + 100, title, url, body, vector FROM kd WHERE id % 50 = 1
        UNION ALL SELECT id + 5000000, dataset_id, title, url, body, vector[1:32] FROM kd WHERE id % 97 = 5
        UNION ALL SELECT id + 7000000, dataset_id, title, url, body, """ + planted_vector("8 + (id + 7000000) % 2", "vector") + """ FROM kd WHERE id % 89 = 4"""),
    *SESSION_STEPS,
    ("marked", "SELECT id, user_id, messages, CASE WHEN CAST(id AS BIGINT) % 41 <> 0 THEN model END AS model FROM sessions"),
    ("psessions", "SELECT * FROM marked UNION ALL SELECT * FROM marked WHERE CAST(id AS BIGINT) % 40 = 0"),
]


def _dups(table: str, cols: str) -> str:
    nn = " AND ".join(f"{c} IS NOT NULL" for c in cols.split(", "))
    return (f"(SELECT count(*) FROM (SELECT {cols} FROM {table} WHERE {nn} GROUP BY {cols} "
            f"HAVING count(*) > 1) t)")


def _nulls(table: str, cols: str) -> str:
    cond = " OR ".join(f"{c} IS NULL" for c in cols.split(", "))
    return f"(SELECT count(*) FROM {table} WHERE {cond})"


def _dangling(child: str, fk: str, parent: str, pk: str) -> str:
    return (f"(SELECT count(*) FROM {child} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {parent} p WHERE p.{pk} = c.{fk}))")


_RULES = [
    ("datasets.pk", _dups("kb_datasets", "id")),
    ("datasets.unique_name_user", _dups("kb_datasets", "name, user_id")),
    ("datasets.not_null", _nulls("kb_datasets", "id, user_id, name")),
    ("documents.pk", _dups("pdocs", "id")),
    ("documents.fk_dataset", _dangling("pdocs", "dataset_id", "kb_datasets", "id")),
    ("documents.not_null", _nulls("pdocs", "id, dataset_id, title, body, vector")),
    ("documents.one_dimension", """(SELECT count(*) FROM (SELECT dataset_id FROM pdocs GROUP BY dataset_id
        HAVING count(DISTINCT len(vector)) > 1) t)"""),
    ("documents.finite_vectors", f"(SELECT count(*) FROM pdocs WHERE {bad_element('vector')})"),
    ("users.pk", _dups("kb_users", "id")),
    ("users.unique_username", _dups("kb_users", "username")),
    ("users.not_null", _nulls("kb_users", "id, username, active")),
    ("access_tokens.not_null", _nulls("kb_access_tokens", "id, user_id, token, expiration")),
    ("sessions.pk", _dups("psessions", "id")),
    ("sessions.not_null", _nulls("psessions", "id, user_id, messages, model")),
    ("access_tokens.pk", _dups("kb_access_tokens", "id")),
    ("access_tokens.unique_token", _dups("kb_access_tokens", "token")),
    ("access_tokens.fk_user", _dangling("kb_access_tokens", "user_id", "kb_users", "id")),
]

ORACLE.update({
    "decode_documents": with_views([], [ITEMS, PAYLOADS, ("p", """SELECT *, CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END AS ok
            FROM payloads""")],
        f"""SELECT request_id, CASE WHEN ok THEN {_field('payload', 'title')} END AS title,
        CASE WHEN ok THEN {_field('payload', 'url')} END AS url, CASE WHEN ok THEN {_field('payload', 'body')} END AS body,
        CASE WHEN ok THEN {_field('payload', 'dataset')} END AS dataset,
        CASE WHEN ok THEN 'accepted' ELSE 'invalid json' END AS status FROM p"""),
    # what each payload says, stated beside how it was made
    "decode_documents_typed": """SELECT request_id, CASE WHEN ok THEN CASE WHEN k IN (0, 2, 6) THEN 'Document ' || CAST(request_id AS VARCHAR) ELSE '' END END AS title,
        CASE WHEN ok THEN '' END AS url, CASE WHEN ok THEN CASE WHEN k IN (0, 6, 7) THEN COALESCE(text, '') ELSE '' END END AS body,
        CASE WHEN ok THEN CASE WHEN k IN (0, 2) THEN 'ds' || CAST(request_id % 4 AS VARCHAR) ELSE '' END END AS dataset,
        CASE WHEN ok THEN 'accepted' ELSE 'invalid json' END AS status
        FROM (SELECT doc_id AS request_id, text, doc_id % 9 AS k, doc_id % 9 IN (0, 2, 3, 6, 7) AS ok FROM documents) d""",
    "bulk_ingest_status": with_views(["kb_datasets"], [ITEMS,
        ("b", """SELECT batch_id, '[' || string_agg(item, ',' ORDER BY request_id)
                || CASE WHEN batch_id % 10 = 3 THEN ',}]' ELSE ']' END AS payload
            FROM items_src GROUP BY batch_id"""),
        ("items", """SELECT batch_id, CAST(unnest(range(1, CAST(json_array_length(payload) AS BIGINT) + 1)) AS INTEGER) AS position,
            unnest(CAST(json_extract(payload, '$[*]') AS VARCHAR[])) AS item FROM b WHERE json_valid(payload)"""),
        ("req", f"""SELECT batch_id * 4 + position - 1 AS request_id, batch_id % 5 + 1 AS user_id, {_field('item', 'title')} AS title,
            {_field('item', 'url')} AS url, {_field('item', 'body')} AS body,
            COALESCE(NULLIF({_field('item', 'dataset')}, ''), 'default') AS dataset FROM items"""), *INGEST_STEPS],
        """SELECT CAST(request_id // 4 AS BIGINT) AS batch_id, CAST(request_id % 4 + 1 AS INTEGER) AS position, title, url, md5(body) AS body_md5,
            dataset, dataset_id, id, status FROM numbered
        UNION ALL SELECT batch_id, 0 AS position, NULL, NULL, NULL, NULL, NULL, NULL, 'invalid json' FROM b WHERE NOT json_valid(payload)"""),
    "dataset_get_or_create": with_views(["kb_datasets"], [INGEST_REQUESTS, *INGEST_STEPS],
        "SELECT id, name, user_id, created FROM resolved"),
    "ingest_documents": with_views(["kb_datasets"], [INGEST_REQUESTS, *INGEST_STEPS],
        f"""SELECT request_id, user_id, dataset, dataset_id, status, id, title, url, md5(body) AS body_md5,
        {word_count('body')} AS word_count, CASE WHEN id IS NOT NULL THEN CAST(len(vector) AS INTEGER) END AS dim,
        CASE WHEN id IS NOT NULL THEN {vector_digest('vector')} END AS vector_md5 FROM numbered"""),
    "stream_ingest": with_views(["kb_datasets"], [INGEST_REQUESTS, *INGEST_STEPS[:3],
        ("newp", "SELECT DISTINCT dataset AS name, user_id FROM emb WHERE embedded"),
        ("resolved", "SELECT ROW_NUMBER() OVER (ORDER BY user_id, name) AS id, name, user_id FROM newp"), *INGEST_STEPS[6:]],
        f"""SELECT request_id, id, title, md5(body) AS body_md5, {word_count('body')} AS word_count, {vector_digest('vector')} AS vector_md5
        FROM numbered WHERE id IS NOT NULL"""),
    "cascade_delete": with_views(["kb_datasets", "kb_all_documents"], [],
        """SELECT dataset_id, count(*) AS n FROM kb_all_documents d
        WHERE NOT EXISTS (SELECT 1 FROM kb_datasets s WHERE s.user_id = 3 AND s.id = d.dataset_id)
        GROUP BY dataset_id"""),
    "cascade_update": with_views(["kb_datasets", "kb_all_documents"], [],
        """SELECT d.id, CASE WHEN s.user_id = 2 THEN d.dataset_id + 1000 ELSE d.dataset_id END AS dataset_id
        FROM kb_all_documents d LEFT JOIN kb_datasets s ON s.id = d.dataset_id"""),
    "constraint_report": with_views(["kb_datasets", "kb_documents", "kb_users", "kb_access_tokens", "kb_messages"], PLANTED,
        "\nUNION ALL ".join(f"SELECT '{r}' AS rule, CAST({q} AS BIGINT) AS violations" for r, q in _RULES)),
})

SYSTEM_PROMPT = "Answer the question using only the search results above."
CHAT_BODIES = ("bodies", """SELECT reply_id, CASE WHEN conv_id % 10 = 0 THEN '{"choices":[]}'
        WHEN conv_id % 10 = 1 THEN 'not json'
        ELSE to_json({'choices': [{'message': {'role': 'assistant', 'content': response}}]})::VARCHAR END AS body
        FROM kb_replies""")
EMB_BODIES = ("bodies", """SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN '{"data":[]}' WHEN vec_id % 10 = 1 THEN '{"data":'
        WHEN vec_id % 10 = 2 THEN replace(to_json({'data': [{'embedding': embedding}]})::VARCHAR, ']}]}', ',null]}]}')
        ELSE to_json({'data': [{'embedding': embedding}]})::VARCHAR END AS body FROM embeddings""")
SCRIPT_RE = r"(?is)<script[^>]*>.*?</script>"
STYLE_RE = r"(?is)<style[^>]*>.*?</style>"
TAG_RE = r"(?s)<[^>]*>"
SPACE_RE = r"[ \t\r\n]+"

ORACLE.update({
    "chat_requests": f"""SELECT query_id, to_json({{'model': '{D.DEFAULT_MODEL}', 'messages': [
            {{'role': 'system', 'content': '{SYSTEM_PROMPT}'}}, {{'role': 'user', 'content': prompt}}],
            'max_tokens': {D.CHAT_MAX_TOKENS}, 'temperature': {D.CHAT_TEMPERATURE}}})::VARCHAR AS payload FROM ({PROMPTS}) t""",
    "search_word_requests": with_views(["kb_queries"], [], f"""SELECT query_id, to_json({{'model': '{D.DEFAULT_MODEL}',
            'messages': [{{'role': 'user', 'content': '{D.SEARCH_WORDS_INSTRUCTION}' || query}}],
            'max_tokens': {D.CHAT_MAX_TOKENS}, 'temperature': {D.CHAT_TEMPERATURE}, 'seed': {D.SEARCH_WORDS_SEED}}})::VARCHAR AS payload FROM kb_queries"""),
    "embedding_requests": with_views(["kb_queries"], [],
        f"SELECT query_id, to_json({{'model': '{D.DEFAULT_MODEL}', 'input': query}})::VARCHAR AS payload FROM kb_queries"),
    "rewrite_turns_once": with_views([], [("p", f"SELECT conv_id, turn, length('{D.SEARCH_WORDS_INSTRUCTION}' || COALESCE(text, '')) AS n FROM conversations")],
        """SELECT conv_id, turn, CASE WHEN n % 9 <> 0 THEN 'n=' || CAST(n AS VARCHAR) || ' none [citation]0[/citation]' || chr(92) || 'n.' END AS search_words,
        CASE WHEN n % 9 = 0 THEN 'no response from model server' END AS error FROM p"""),
    "rewrite_queries": with_views(["kb_queries"], [("p", f"SELECT query_id, length('{D.SEARCH_WORDS_INSTRUCTION}' || query) AS n FROM kb_queries")],
        """SELECT query_id, CASE WHEN n % 9 <> 0 THEN 'n=' || CAST(n AS VARCHAR) || ' none [citation]0[/citation]' || chr(92) || 'n.' END AS search_words,
        CASE WHEN n % 9 = 0 THEN 'no response from model server' END AS error FROM p"""),
    "parse_chat_responses": with_views(["kb_replies"], [CHAT_BODIES],
        """SELECT reply_id,
        CASE WHEN json_valid(body) AND COALESCE(json_array_length(body, '$.choices'), 0) > 0
             THEN json_extract_string(body, '$.choices[0].message.content') END AS content,
        CASE WHEN NOT json_valid(body) THEN 'response does not decode'
             WHEN COALESCE(json_array_length(body, '$.choices'), 0) = 0 THEN 'no response from model server' END AS error
        FROM bodies"""),
    "parse_embedding_responses": with_views([], [EMB_BODIES, ("v", """SELECT vec_id, json_valid(body) AS ok,
            CASE WHEN json_valid(body) THEN CAST(json_extract(body, '$.data[0].embedding') AS FLOAT[]) END AS vec
            FROM bodies""")],
        f"""SELECT vec_id, CASE WHEN vec IS NOT NULL AND NOT {bad_element('vec')} THEN CAST(len(vec) AS INTEGER) END AS dim,
        CASE WHEN NOT {bad_element('vec')} THEN {vector_digest('vec')} END AS vector_md5,
        CASE WHEN NOT ok THEN 'response does not decode' WHEN vec IS NULL THEN 'no response from model server'
             WHEN {bad_element('vec')} THEN '{D.ERR_BAD_VECTOR}' END AS error
        FROM v"""),
    "embed_lookup": """SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN CAST(len(e.embedding) AS INTEGER) END AS dim,
        CASE WHEN e.vec_id IS NULL THEN 'could not get document embedding' END AS error
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    "hash_embedding": """WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS tok FROM documents),
        h AS (SELECT doc_id, md5(tok) AS h FROM t WHERE tok <> '')
        SELECT doc_id, CAST(CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS INTEGER) AS bucket,
        CAST(sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS BIGINT) AS value
        FROM h GROUP BY 1, 2
        HAVING sum(CASE WHEN CAST('0x' || substr(h, 9, 1) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) <> 0""",
    "intake_gate": """WITH f AS (SELECT page_id, regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1)
            || ['.pdf', '.PDF', '.Pdf', '.txt', ''][page_id % 5 + 1] AS full_name,
            CASE WHEN page_id % 23 <> 0 THEN full_name END AS name,
            CASE WHEN page_id % 29 <> 0 THEN CAST(strlen(html) AS BIGINT) * 2048 END AS length FROM pages),
        r AS (SELECT *, CASE WHEN length IS NULL THEN 'file size is unknown' WHEN length > 10485760 THEN 'file is larger than 10 MiB'
            WHEN NOT COALESCE(ends_with(name, '.pdf') OR ends_with(name, '.PDF'), false) THEN 'not a PDF file' END AS reason FROM f)
        SELECT page_id, name, length, reason IS NULL AS accepted, reason FROM r""",
    "page_text": f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '{SCRIPT_RE}', ' ', 'g'), '{STYLE_RE}', ' ', 'g'), '{TAG_RE}', ' ', 'g'), '{SPACE_RE}', ' ', 'g')) AS text
        FROM pages""",
})

ORACLE["stream_session_upsert"] = ORACLE["session_upsert"]
ORACLE["stream_standing_budget"] = ORACLE["budget_search"]
ORACLE["page_text_extracted"] = f"""SELECT page_id, text, CASE WHEN text IS NULL THEN 'file has no content' END AS error FROM ({ORACLE["page_text"]}) t"""
ORACLE["constraint_report_incremental"] = ORACLE["constraint_report"]
ORACLE["stream_session_state"] = ORACLE["session_upsert"]
ORACLE["decode_query_requests"] = f"""WITH r AS (
    SELECT conv_id, turn, conv_id * 3 + turn AS i, text FROM conversations),
v AS (
    SELECT *, i % 13 = 0 AS bad, CASE WHEN i % 11 = 0 THEN '' ELSE text END AS q,
        CASE WHEN i % 7 = 0 OR i % 6 = 1 THEN {D.DEFAULT_WORD_LIMIT} WHEN i % 6 = 0 THEN 0 WHEN i % 6 = 2 THEN 3000000000 ELSE i % 700 END AS lim FROM r)
SELECT conv_id, turn, CASE WHEN NOT bad THEN q END AS query, CASE WHEN NOT bad THEN CAST(conv_id AS VARCHAR) END AS session_id,
    CASE WHEN NOT bad THEN CAST(lim AS BIGINT) END AS word_limit,
    CASE WHEN NOT bad THEN CASE WHEN i % 5 = 0 THEN '{D.DEFAULT_MODEL}' ELSE 'model-' || CAST(i % 3 AS VARCHAR) END END AS model,
    CASE WHEN NOT bad THEN CASE WHEN i % 4 = 0 THEN '{D.DEFAULT_DATASET}' ELSE 'ds' || CAST(i % 4 AS VARCHAR) END END AS dataset,
    CASE WHEN bad THEN '{D.ERR_BAD_REQUEST}' WHEN q = '' THEN '{D.ERR_EMPTY_QUERY}' WHEN lim <= 0 THEN '{D.ERR_BAD_BUDGET}' END AS error
FROM v"""
