"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from quarry.llm.url_filter import RULES, SOFT, SOFT_LIMIT, STRICT

# Deletes the ASCII white space of exact_dedup.WHITE.
OP6 = """
WITH d AS (
    SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm,
           length(coalesce(text, '')) AS points
    FROM documents),
g AS (
    SELECT doc_id, sha256(norm) AS text_sha256,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
           count(*) OVER (PARTITION BY norm) AS group_size
    FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def _rules() -> str:
    rows = ", ".join(f"('{host}', '{path}', '{says}')" for host, path, says in RULES)
    return f"(VALUES {rows}) AS r(rule_host, rule_path, says)"


def _hits(terms) -> str:
    """Distinct terms standing as whole words in the lower-cased url or its percent-decoded form (punycode is beyond SQL)."""
    tests = ", ".join(f"CASE WHEN regexp_matches(lower(concat(url, ' ', try(url_decode(url)))), '(^|[^\\pL\\pN]){t}($|[^\\pL\\pN])') THEN '{t}' END" for t in sorted(terms))
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


OP3 = f"""
WITH p AS (
    SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {_hits(STRICT)} AS strict_hits, {_hits(set(SOFT) - set(STRICT))} AS soft_hits
    FROM p),
m AS (
    SELECT page_id, url, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
           max_by(says, length(rule_host || rule_path)) AS says
    FROM q JOIN {_rules()} ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id, url)
SELECT q.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(says, CASE WHEN len(strict_hits) > 0 OR len(soft_hits) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM q LEFT JOIN m ON q.page_id = m.page_id AND q.url IS NOT DISTINCT FROM m.url
"""

# Base32 of the 160 bits of a SHA-1: eight digits for each ten hexadecimal ones.
OP4 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
    SELECT page_id, payload, strlen(payload) AS payload_bytes, sha1(payload) AS h,
           max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                              CAST((CAST('0x' || substr(h, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)
                       FOR i IN range(32)], 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""

# Words, windows of ten, and every place where a window's words stand in a document.
OP5 = """
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
q AS (
    SELECT DISTINCT item_id, len(least_w) AS n, array_to_string(least_w, ' ') AS phrase
    FROM (SELECT item_id, w[s + 1:s + 10] AS least_w
          FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM bw WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM q),
spot AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM dw),
grams AS (SELECT doc_id, p, n, array_to_string(w[p + 1:p + n], ' ') AS phrase FROM spot, sizes WHERE p + n <= len(w)),
hit AS (SELECT DISTINCT doc_id, p, g.n, item_id FROM grams g JOIN q ON g.n = q.n AND g.phrase = q.phrase),
covered AS (SELECT doc_id, count(DISTINCT c) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS c FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE = {"op3_url_filter": OP3, "op4_warc": OP4, "op5_benchmark_decontamination": OP5, "op6_exact_dedup": OP6}

# CRC-32 of a decimal number: the table of 256 remainders, then byte by byte.
# Rebuilt conversations as lists of turns; a node is a distinct beginning.
OP12 = """
WITH bits AS (
    SELECT list(list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
                            lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
    FROM range(256) AS r(i)),
t AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                              md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (
    SELECT c, list({'r': r, 'x': x} ORDER BY pos) AS turns, CAST(c AS VARCHAR) AS name FROM t GROUP BY c),
h AS (
    SELECT c, turns, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(s) AS BIGINT) FOR s IN string_split(name, '')]),
                                     lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS INTEGER) + 1])), 4294967295) % 6 AS h
    FROM own, bits),
rebuilt AS (
    SELECT h.c, list_concat(coalesce(s.turns[1:h], []), h.turns[h + 1:]) AS path
    FROM h LEFT JOIN own s ON s.c = h.c - h.c % 100),
rows AS (SELECT c, d, path[1:d] AS key, d = len(path) AS at_end FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT key, d, min(c) AS m, count(*) AS n, coalesce(length(key[len(key)].x), 0) AS points,
           coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE at_end), '') AS ends
    FROM rows GROUP BY key, d),
member AS (SELECT rows.c, rows.d, m FROM rows JOIN nodes ON rows.d = nodes.d AND rows.key = nodes.key),
linked AS (SELECT nodes.*, p.m AS parent FROM nodes LEFT JOIN member p ON p.c = nodes.m AND p.d = nodes.d - 1),
children AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children k ON k.parent = l.m AND k.d = l.d),
sums AS (
    SELECT a.m, a.d, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, CAST(sum((f.n - 1) * f.points) AS BIGINT) AS saved_tokens
    FROM full_nodes f JOIN member a ON a.c = f.m AND a.d <= f.d GROUP BY a.m, a.d)
SELECT f.m AS conv_id, f.d AS depth, f.parent AS parent_conv_id, f.n AS n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
FROM full_nodes f JOIN sums ON sums.m = f.m AND sums.d = f.d
"""

ORACLE["op12_prefix_trie"] = OP12

# Every document's score for every item; integers but for the weight.
OP11 = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
    SELECT row_number() OVER () AS q, item_id,
           list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w
    FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
whole AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
    FROM tf, whole GROUP BY term, n_docs),
scores AS (
    SELECT q, item_id, r, doc_id,
           CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM (SELECT q, item_id, unnest(w) AS term FROM i) JOIN weight USING (term) JOIN tf USING (term), whole
    GROUP BY q, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


def _near(words: int, percent: int, kept: str) -> str:
    """Links by the shingles that two different sets share, and the smallest id reachable over them."""
    text = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                   ELSE list_sort(list_distinct([array_to_string(w[i:i + {words - 1}], ' ') FOR i IN range(1, len(w) - {words - 2})])) END AS s
    FROM d),
class AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 AND doc_id IS NOT NULL GROUP BY s),
item AS (SELECT rep, n, unnest(s) AS e FROM class),
link AS (
    SELECT a.rep AS x, b.rep AS y FROM item a JOIN item b ON a.e = b.e AND a.rep <> b.rep
       AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach AS (SELECT rep AS x, rep AS y FROM class UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
low AS (SELECT x AS rep, min(y) AS component FROM reach GROUP BY x)
SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component, doc_id) AS component_id{kept}
FROM sets LEFT JOIN class ON sets.s = class.s LEFT JOIN low ON low.rep = class.rep
"""


ORACLE |= {"op2_minhash_near_dedup": _near(5, 75, ", doc_id = component_id AS kept"), "op11_ranked_search": OP11,
           "op13_jaccard_join": _near(3, 90, "")}
