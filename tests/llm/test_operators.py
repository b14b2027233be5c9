"""Every operator against a brute-force version on one small corpus."""

import base64
import hashlib
import math
import pathlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus_fixture import docs, fixture_rows, no_docs  # noqa: F401 - fixtures
from quarry.llm import decontam, exact_dedup, license_scan, minhash, quality, sharding, suffix_dedup, url_filter, warc

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


# 1: license scan

def test_longest_increasing():
    assert license_scan.longest_increasing([]) == []
    values = [5, 1, 4, 2, 3, 9, 0]
    assert [values[i] for i in license_scan.longest_increasing(values)] == [1, 2, 3, 9]


def test_align_recurses_between_anchors():
    assert license_scan.align([1, 7, 7, 2, 7, 3], [1, 7, 2, 7, 3]) == [(0, 0), (1, 1), (3, 2), (4, 3), (5, 4)]
    assert license_scan.align([9, 1, 2], [1, 2, 9]) in ([(1, 0), (2, 1)], [(0, 2)])
    assert license_scan.align([], [1]) == []


def test_license_scan(spark, no_docs):
    t = license_scan.TEMPLATES
    cases = [(1, f"x y\n{t['MIT']} z"), (2, t["Apache-2.0-header"].replace("software", "code")), (3, None), (4, ""),
             (5, "the license of the software is free " * 50), (6, f"{t['GPL-3.0']} a b c {t['GPL-3.0']}"), (None, t["MIT"]),
             (7, t["MIT-text"].upper()), (1, f"x y\n{t['MIT']} z"), (8, "word " * 30000 + t["CC-BY-NC-4.0"])]
    df = spark.createDataFrame([(i, x, "c", "l") for i, x in cases], "doc_id long, text string, license string, matches string")
    got = by_id(license_scan.licenses(df))
    assert license_scan.licenses(df).count() == len(cases)
    assert got[1].license == "MIT" and got[1].coverage == 1.0 and (got[1].first_word, got[1].n_matches) == (2, 1)
    assert got[2].license == "Apache-2.0-header" and got[2].coverage == pytest.approx(1 - 2 / 83, abs=0.02)
    assert [got[i].license for i in (3, 4, 5)] == [None] * 3 and got[5].coverage == 0.0
    assert got[6].n_matches == 2 and got[6].first_word == 0
    assert got[7].license == "MIT-text" and got[8].license == "CC-BY-NC-4.0" and got[8].first_word == 30000
    assert license_scan.licenses(no_docs).count() == 0


def found_in(text, **kw):
    """(license, coverage, first word, last word) of all matches in a text."""
    scanner = license_scan.Scanner(kw.get("templates", license_scan.TEMPLATES), 0.8, kw.get("keys", license_scan.KEYS))
    return sorted(next(scanner.scan([text])), key=lambda m: m[2])


@pytest.mark.parametrize("text, name", [
    ("Released under the BSD License.", "BSD"), ("Released under the BSD 3-Clause License.", "BSD-3-Clause"),
    ("Released under the Foo License.", None), ("Released under the MIT Foo License.", None), ("Licensed under the MIT License.", "MIT"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("Licensed under CC BY-NC 3.0", None), ("Licensed under the Apache License, Version 1.1.", None),
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 1", None),
    ("This work is licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"),
    ("This work is licensed under the GNU Affero General Public License, version 3", "AGPL-3.0"),
    (license_scan.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"), "GPL-2.0-header"),
    (license_scan.TEMPLATES["GPL-3.0-header"].replace("General", "Foo General"), None)])
def test_license_near_misses(text, name):
    assert [m[0] for m in found_in(f"Some words. {text} More words.")] == [name] * (name is not None)


def test_license_templates_find_themselves():
    assert set(license_scan.KEYS) == set(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        last = len(license_scan.hashed(text)) + 1
        assert (name, 1.0, 2, last) in found_in(f"a b {text} c d"), name


@pytest.mark.parametrize("name, license", [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"),
                                           ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")])
def test_whole_license_texts(spark, name, license):
    """Texts from elsewhere, with some lines lost."""
    path = pathlib.Path("/usr/share/common-licenses", name)
    if not path.exists():
        pytest.skip("no license texts on this machine")
    lines = path.read_text().splitlines()
    text = "\n".join(["Copyright somebody", *lines[:len(lines) * 19 // 20], "and their own words"])
    (r,) = license_scan.licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert r.license == f"{license}-text" and 0.85 < r.coverage <= 1


def test_rival_license_texts(spark):
    t = license_scan.TEMPLATES
    for name in ("MIT-text", "MIT-0-text", "MIT-grant", "BSD-2-Clause-text", "BSD-3-Clause-text", "BSD-4-Clause-text", "ISC-text"):
        best = max(found_in(f"x {t[name]} y"), key=lambda m: m[1] * len(license_scan.hashed(t[m[0]])))
        assert best[:2] == (name, 1.0)


LONG_TEMPLATES = [n for n, t in license_scan.TEMPLATES.items() if len(license_scan.hashed(t)) > license_scan.LONG]


@pytest.mark.parametrize("name", LONG_TEMPLATES)
def test_long_license_without_its_key_phrase_or_title(name):
    """A word put into the first key phrase, or the first words left out."""
    text, phrase = license_scan.TEMPLATES[name], license_scan.KEYS[name][0]
    words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)
    n = license_scan.hashed(phrase)
    at = int(license_scan.places_of(n, np.array(license_scan.hashed(text), np.uint64))[0])
    altered = " ".join(words[:at + 1] + ["quite"] + words[at + 1:])
    best = lambda t: max(found_in(t), key=lambda m: m[1] * len(license_scan.hashed(license_scan.TEMPLATES[m[0]])), default=None)
    for t, last in ((f"one two {altered} three four", len(words) + 2), (f"{' '.join(words[min(14, len(words) // 40):])} and more", len(words) - min(14, len(words) // 40) - 1)):
        m = best(t)
        assert m and m[0] == name and m[1] > 0.96 and m[3] == last, (m, last)


def test_long_text_like_a_license_is_none():
    """A sister license: the key phrase differs and a twentieth of the words."""
    words = re.findall(r"\w+", license_scan.TEMPLATES["GPL-3.0-text"])
    sister = ["other" if i % 20 == 7 else w for i, w in enumerate(words)]
    at = int(license_scan.places_of(license_scan.hashed(license_scan.KEYS["GPL-3.0-text"][0]), np.array(license_scan.hashed(" ".join(words)), np.uint64))[0])
    assert not [m for m in found_in(" ".join(sister[:at + 2] + ["Affero"] + sister[at + 2:])) if m[0] == "GPL-3.0-text"]
    quoted = " ".join(words[300:900])  # a part is no license either
    assert not [m for m in found_in(f"as it says {quoted} and so on") if m[0] == "GPL-3.0-text"]


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_alignment_against_longest_common_subsequence(seed):
    rnd = np.random.default_rng(seed)
    template = license_scan.hashed(license_scan.TEMPLATES[["MIT-text", "BSD-3-Clause-text", "ISC-text"][seed % 3]])
    text = []
    for w in template:
        p = rnd.random()
        text += [w, 1] if p < 0.05 else [] if p < 0.1 else [2] if p < 0.13 else [w]
    pairs = license_scan.align(text, template)
    most = longest_common(text, template)
    assert all(text[i] == template[j] for i, j in pairs) and 0.97 * most <= len(pairs) <= most


@pytest.mark.parametrize("keys", [license_scan.KEYS, {}], ids=["keys", "words alone"])
def test_altered_notices_in_a_row(keys):
    notice = license_scan.TEMPLATES["GPL-3.0"]
    altered, longer = notice.replace("work", "file"), notice.replace("is licensed", "is hereby licensed")
    one = {"templates": {"GPL-3.0": notice}, "keys": {k: v for k, v in keys.items() if k == "GPL-3.0"}}
    got = [m[1:] for m in found_in(" ".join([altered, notice, longer, altered, altered, notice]), **one)]
    assert got == [(11 / 12, 0, 11), (1.0, 12, 23), (1.0, 24, 36), (11 / 12, 37, 48), (11 / 12, 49, 60), (1.0, 61, 72)]


# 2: near duplicates

def brute_components(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII_LOWER))
            sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_groups(docs, no_docs, fixture_rows):
    out = minhash.near_groups(docs)
    got, want = by_id(out), brute_components(fixture_rows)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert out.count() == len(fixture_rows)
    assert minhash.near_groups(no_docs).count() == 0


def test_one_of_each_keeps_columns(docs, fixture_rows):
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    want = {d for d, (_, c) in brute_components(fixture_rows).items() if d == c}
    assert {r.doc_id for r in out.collect()} - {None} == want


def test_chain_of_links_within_a_bucket(spark):
    """A chain a-b-c with a and c far apart is one component, whoever leads the buckets."""
    words = [f"w{i}" for i in range(300)]
    chain = [" ".join(words[k * 12:k * 12 + 150]) for k in range(8)]
    df = spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_groups(df).collect()} == {0}


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(4)
    for n in (1, 2, 17, 5000):
        items = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        assert (minhash.similarity_sketch(items, 432) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    a = np.unique(rng.integers(0, 1 << 63, 1000, np.uint64))
    s = minhash.similarity_sketch(a, 432)
    t = minhash.similarity_sketch(np.unique(np.concatenate([a[:600], rng.integers(0, 1 << 63, 400, np.uint64)])), 432)
    assert abs((s == t).mean() - 600 / 1400) < 0.1


def test_components_long_path(spark):
    n = 40
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.doc: r.component for r in minhash.components(links).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


# 3: URLs

def test_url_filter(spark):
    cases = {1: ("http://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
             2: ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
             3: ("https://shop.com", "shop.com", "", None, "allow"), 4: (None, "", "", None, "allow"),
             5: ("no scheme/casino", "", "", None, "block"), 6: ("http://x.net/es/a", "x.net", "/es/a", "net/es/", "block"),
             7: ("http://x.org/free-dating", "x.org", "/free-dating", None, "block"), 8: ("http://x.org/free/free", "x.org", "/free/free", None, "allow"),
             9: ("http://x.org/casinos/excasino", "x.org", "/casinos/excasino", None, "allow"), 10: ("http://x.org?a=://b/c", "x.org", "", None, "allow"),
             11: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"), 12: ("", "", "", None, "allow"),
             13: ("http://x.org/éfree-betting", "x.org", "/éfree-betting", None, "allow"), 14: ("http://x.org/" + "a/" * 20000 + "xxx", "x.org", "/" + "a/" * 20000 + "xxx", None, "block")}
    odd = {15: ("http://x.org/%70orn", "block"), 16: ("http://x.org/fr%65e%2Ddating", "block"), 17: ("http://x.org/%zz/%", "allow"), 18: ("http://xn--porn-9pa.org/", "block"),
           19: ("http://xn--caf-dma.org/a", "allow"), 20: ("http://xn--99999999999.org/", "allow"), 21: ("http://x.org/100%25free/%C3%A9free", "allow")}
    assert list(url_filter.forms("http://xn--caf-dma.org/%41"))[1:] == ["http://xn--caf-dma.org/A", "café"]
    got = url_filter.judge(spark.createDataFrame([(i, u) for i, (u, _) in odd.items()], "page_id long, url string")).collect()
    assert {r.page_id: r.verdict for r in got} == {i: v for i, (_, v) in odd.items()}
    df = spark.createDataFrame([(i, c[0], None, "clash") for i, c in cases.items()] + [(None, "http://a.com/", None, "x")],
                               "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()}
    assert got.pop(None) == ("a.com", "/", "com/", "allow")
    assert got == {i: c[1:] for i, c in cases.items()}
    assert url_filter.judge(df.limit(0)).count() == 0


# 4: WARC

@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a/ b%\r\nX", "same"), (2, None, "same"), (3, "http://c", "é\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n"), (4, "u", None), (5, "u", ""),
            (6, "u", "long " * 50000), (3, "http://c", "é\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n"), (None, "n", "same"), (None, "n", "only without id")]
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, payload string")


def test_warc_round_trip(pages):
    best = {}
    for r in pages.collect():
        best[r.html or ""] = max(best.get(r.html or "", -1), -1 if r.page_id is None else r.page_id)
    want = Counter()
    for r in pages.collect():
        data = (r.html or "").encode()
        response = best[r.html or ""] in (r.page_id, -1)
        want[r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit",
             None if response else best[r.html or ""]] += 1
    assert Counter(tuple(r) for r in warc.round_trip(pages).collect()) == want
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_source(spark, pages, tmp_path):
    warc.write_archives(pages, f"file://{tmp_path}/w", min_bytes=5, records_per_file=2)
    back = warc.read_archives(spark, f"file://{tmp_path}/w", groupBytes=1)
    rows = back.collect()
    assert sorted(r.url for r in rows if r.url) == sorted(r.url for r in pages.collect() if r.url)
    assert {(bytes(r.payload).decode()) for r in rows} == {r.html or "" for r in pages.collect()}
    assert all(r.record_type == "response" for r in rows if r.payload_bytes < 5)
    assert [r.page_id for r in back.where("record_type = 'response' and page_id = 6").collect()] == [6]
    assert back.where("page_id in (4, 5)").count() == 2
    assert all(r.payload is None for r in warc.read_archives(spark, f"file://{tmp_path}/w", payload="false").collect())


def test_warc_rejected_payloads_are_not_read(tmp_path):
    record = lambda kind, body: f"WARC/1.1\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    (tmp_path / "a.warc").write_text(record("request", "GET") + record("response", "body"), newline="")
    from pyspark.sql.datasource import EqualTo, GreaterThan

    reader = warc.WarcReader({"path": str(tmp_path)})
    assert [type(f) for f in reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("page_id",), 1)])] == [GreaterThan]
    (group,) = reader.partitions()
    assert [r[-1] for r in reader.read(group)] == [b"body"]


# 5: benchmark decontamination

def brute_contamination(rows, items, width):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall((t or "").translate(ASCII_LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - width + 1)) if w else ():
            windows[tuple(w[s:s + width])].add(i)
    out = {}
    for d, t in rows:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p:p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p:p + n])]
        ids = sorted(map(str, found - {None}))
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


@pytest.fixture(scope="module")
def benchmark_items(fixture_rows):
    texts = [t for _, t in fixture_rows]
    passage = " ".join(texts[76].split()[40:100])
    return [(1, passage), (2, texts[5] or ""), (10, "again again again"), (3, None), (4, "..."), (5, "one"), (2, "TWO, words!"), (1, passage),
            (6, "zz " * 12), (7, " ".join(texts[60].split()[:9])), (None, "ab" * 400)]


def test_contamination(spark, docs, no_docs, fixture_rows, benchmark_items):
    items = spark.createDataFrame([(i, t, "x") for i, t in benchmark_items], "item_id long, text string, term string")
    out = decontam.contamination(docs, items)
    each = brute_contamination([(i, t) for i, (_, t) in enumerate(fixture_rows)], benchmark_items, 10)
    want = Counter((d, *each[i]) for i, (d, _) in enumerate(fixture_rows))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()) == want
    assert any(v[-1] for v in want)
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for i, (d, _) in enumerate(fixture_rows) if not each[i][4])
    assert decontam.contamination(no_docs, items).count() == 0
    assert decontam.contamination(docs, items.limit(0)).where("contaminated").count() == 0


def test_contamination_of_rows_that_share_an_id(spark):
    """No text holds the window: its halves stand in two rows of one id, or without id."""
    w = [f"w{i}" for i in range(10)]
    halves = [" ".join(w[:5]), " ".join(w[5:])]
    rows = [(1, halves[0]), (1, halves[1]), (None, halves[0]), (None, halves[1]), (2, " ".join(w)), (2, "clean"), (None, " ".join(w).upper())]
    items = spark.createDataFrame([(7, " ".join(w))], "item_id long, text string")
    out = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in out)
    assert got == Counter([(1, 5, 0, False), (1, 5, 0, False), (None, 5, 0, False), (None, 5, 0, False), (2, 10, 10, True), (2, 1, 0, False), (None, 10, 10, True)])


def test_proximity(spark):
    df = spark.createDataFrame([(1, "a x x b c"), (2, "a x x x x x x b c"), (3, "c b a"), (4, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "a b c")], "item_id long, text string")
    index, test = decontam.postings(df), decontam.places(items)
    assert {r.doc_id for r in decontam.proximity_matches(index, test, 4).collect()} == {1, 3}
    assert {r.doc_id for r in decontam.proximity_matches(index, test, 8).collect()} == {1, 2, 3}


# 6: exact duplicates

def brute_copies(rows):
    groups = defaultdict(list)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    for d, t in rows:
        groups[norm(t)].append((-len(t or ""), d))
    out = {}
    for d, t in rows:
        g = groups[norm(t)]
        keep = min(x for x in g if x[1] is not None)[1] if any(x[1] is not None for x in g) else None
        out[d, t] = (keep, len(g), d == keep, hashlib.sha256(norm(t).encode()).hexdigest())
    return out


@pytest.mark.parametrize("hash_fn", [exact_dedup.content_hash, lambda c: F.substring(F.unhex(F.md5(c)), 1, 1)], ids=["md5", "colliding"])
def test_exact_groups(docs, no_docs, fixture_rows, hash_fn):
    want = brute_copies(fixture_rows)
    out = exact_dedup.exact_groups(docs, hash_fn).collect()
    assert len(out) == len(fixture_rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == Counter((d, *want[d, t]) for d, t in fixture_rows)
    assert exact_dedup.exact_groups(no_docs).count() == 0


def test_exact_dedup_keeps_columns(docs, fixture_rows):
    out = exact_dedup.dedup(docs)
    want = {d for (d, _), v in brute_copies(fixture_rows).items() if v[2]}
    rows = out.collect()
    assert out.columns == docs.columns and {r.doc_id for r in rows} == want and len(rows) == len({(r.doc_id, r.text) for r in rows})


@pytest.mark.parametrize("partitions", [1, 4])
def test_exact_dedup_of_rows_of_one_id(spark, partitions):
    """The survivor is the longest text of the kept id, however the rows are dealt."""
    rows = [(5, "ab", "z"), (5, "a b", "y"), (6, "ab", "x"), (5, "a b", "q"), (7, None, "n"), (7, "", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(partitions)
    out = exact_dedup.dedup(docs).collect()
    assert sorted((r.doc_id, r.text or "", r.lang) for r in out) in ([(5, "a b", "y"), (7, "", "n")], [(5, "a b", "y"), (7, "", "m")])
    assert [tuple(r) for r in out if r.doc_id == 5] == [(5, "a b", "y")]


# 7: repeated byte strings

def brute_repeats(rows, window):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - window + 1):
            s = data[i:i + window]
            if s in seen and seen[s] != (d, i):
                gone[i:i + window] = True
            seen.setdefault(s, (d, i))
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[d] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 300}], ids=["whole", "split"])
def test_suffix_dedup(docs, no_docs, fixture_rows, sizes):
    rows = [r for r in fixture_rows if r[0] is not None or r[1] == "no id here"]
    df = docs.where("doc_id is not null or text = 'no id here'")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(df, **sizes).collect()}
    want = brute_repeats(rows, 100)
    assert got == want and sum(v[1] for v in want.values())
    if not sizes:
        assert suffix_dedup.report(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 300}], ids=["whole", "split"])
def test_suffix_dedup_texts_of_one_id(spark, docs, fixture_rows, sizes):
    """All fixture rows, and other texts under ids that are taken: each text is a document of its own."""
    more = [(61, fixture_rows[76][1]), (61, fixture_rows[60][1][:300] + "x" * 150), (None, fixture_rows[76][1]), (5, "y" + fixture_rows[5][1] * 3)]
    rows = [*fixture_rows, *more]
    md5 = lambda r: hashlib.md5((r[1] or "").encode()).digest()
    first = {}
    for r in sorted(rows, key=md5):
        first.setdefault(r[0], md5(r))
    order = lambda r: (r[0] is not None, r[0] is not None and md5(r) != first[r[0]], r[0] or 0, md5(r))
    seen, want = set(), {}
    for d, t in sorted({(d, t or "") for d, t in rows}, key=order):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(data[i:i + 100])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[d, t] = (d, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter(tuple(r) for r in suffix_dedup.report(df, **sizes).collect())
    assert got == Counter(want[d, t or ""] for d, t in rows)


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(60):
        d = rng.integers(97, 99, rng.integers(1, 200)).astype(np.uint8)
        d = np.concatenate([d, d[:30]]) if rng.random() < 0.5 else d
        b = d.tobytes()
        sa = suffix_dedup.suffix_array(d)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for k, n in enumerate(suffix_dedup.common_prefixes(d, sa, 20)[1:], 1):
            x, y = b[sa[k - 1]:], b[sa[k]:]
            assert n == next((j for j in range(min(len(x), len(y), 20)) if x[j] != y[j]), min(len(x), len(y), 20))


def test_merged_earliest():
    rng = np.random.default_rng(3)
    lists, order = [], rng.permutation(300)
    for k in range(5):
        digest = np.unique(np.array([b"%04d" % x for x in rng.integers(0, 80, 60)], "S4"))
        lists.append((digest, order[60 * k:60 * k + len(digest)]))
    first = {}
    for d, o in lists:
        for x, y in zip(d, o):
            first[x] = min(first.get(x, y), y)
    for (d, o), flags in zip(lists, suffix_dedup.merged_earliest(lists)):
        assert [bool(f) for f in flags] == [first[x] != y for x, y in zip(d, o)]


# 8: quality

def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.scored(docs, labels)
    r = (out.join(labels, "doc_id").where("held_out").groupBy("quality")
         .agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc")).collect())
    assert {x.quality: x.acc for x in r}[1] > 0.99 and {x.quality: x.acc for x in r}[0] > 0.85
    held = {x.doc_id: x.held_out for x in out.collect()}
    assert all(v == (zlib.crc32(str(d).encode()) % 3 == 1) for d, v in held.items())


def test_quality_tells_words_of_equal_shapes(spark):
    rng = np.random.default_rng(6)
    words = ["".join(w) for w in rng.choice(list("abcdefghij"), (400, 5))]
    rows = [(i, " ".join(rng.choice(words[:200] if i % 2 else words[200:], 40, replace=False))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(600)], "doc_id long, quality int")
    held = quality.scored(docs, labels).where("held_out").collect()
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95


def test_quality_edge_cases(spark, docs, no_docs, fixture_rows):
    labels = spark.createDataFrame([(i, i % 2, None, 1) for i in range(40)] + [(0, None, 1, 1), (None, 1, 0, 1), (5, 0, 0, 0)],
                                   "doc_id long, quality int, toxic int, text int")
    out = quality.scored(docs, labels).collect()
    assert len(out) == len(fixture_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    none = quality.scored(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.scored(no_docs, labels).count() == 0
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8) + (50 if i % 2 else 0)) for i in range(200)]
    y = np.array([1.0 if i % 2 else -1.0 for i in range(200)])
    w, bias = quality.dual_coordinate_descent(rows, y, np.ones(100), cost=1.0, epochs=50)
    margins = np.array([w[r].sum() + bias for r in rows]) * y
    assert (margins > 0.9).all()


def test_dual_coordinate_descent_against_projected_gradient():
    """The dual of the hinge loss solved independently, on the whole Gram matrix."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 60, 10)) for _ in range(80)]
    y = np.where(rng.random(80) < 0.5, 1.0, -1.0)
    scale, cost = rng.normal(size=60), 0.1
    x = np.zeros((80, 61))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    x[:, 60] = 1.0  # the bias
    signed = x * y[:, None]
    gram = signed @ signed.T
    alpha = np.zeros(80)
    for _ in range(40_000):
        alpha = np.clip(alpha - (gram @ alpha - 1) / np.linalg.norm(gram, 2), 0, cost)
    w, bias = quality.dual_coordinate_descent(rows, y, scale, cost=cost, epochs=3000)
    assert np.allclose(signed.T @ alpha, np.append(w, bias), atol=1e-3)


def plain_model(rows, labels, max_rows=10**9):
    """Counts, ratios and fit of the training rows in plain Python; ``rows``: (hash, id, text)."""
    train = [(h, i, next(quality.features_of([t]))) for h, i, t in rows if i in labels and zlib.crc32(str(i).encode()) % 3 != 1]
    counts = {1: Counter(), 0: Counter()}
    for _, i, f in train:
        counts[labels[i]].update(f.tolist())
    n = {k: quality.BUCKETS + c.total() for k, c in counts.items()}
    ratio = np.zeros(quality.BUCKETS)
    for b in set(counts[0]) | set(counts[1]):
        ratio[b] = math.log((1 + counts[1][b]) / n[1]) - math.log((1 + counts[0][b]) / n[0])
    sample = sorted(train)[:max_rows] if max_rows < len(train) else sorted(train, key=lambda x: x[0])
    w, bias = quality.dual_coordinate_descent([f for _, _, f in sample], np.array([1.0 if labels[i] else -1.0 for _, i, _ in sample]), ratio)
    mean = np.abs(w).sum() / np.count_nonzero(w)
    return ((0.25 * mean + 0.75 * w) * ratio), bias


@pytest.mark.parametrize("max_rows", [10**9, 50])
def test_quality_scores_against_a_plain_fit(spark, max_rows):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r.h, r.doc_id, r.text) for r in docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(quality.HASHES)).alias("h")).collect()]
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    weights, bias = plain_model(rows, marks, max_rows)
    model = quality.fit(docs.repartition(7), labels, max_rows=max_rows)
    assert np.allclose(model.weights, weights, atol=1e-5) and model.bias == pytest.approx(bias, rel=1e-6)


def test_quality_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} and some more") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    rows = quality.gathered(docs, labels, "quality", 40).where("chunk < 0")
    n = sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300))
    assert rows.count() == n  # too few to leave any out before the cut
    whole, few = quality.fit(docs, labels), quality.fit(docs, labels, max_rows=10, max_values=60)
    assert np.count_nonzero(whole.weights) >= np.count_nonzero(few.weights) > 0


# 10: sharding

def test_sharding(docs, no_docs, fixture_rows):
    out = sharding.sharded(docs)
    rows = out.collect()
    assert len(rows) == len(fixture_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key"
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    text = dict(fixture_rows)
    for r in rows:
        if r.doc_id is not None:
            data = (text[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert sharding.sharded(no_docs).count() == 0


def test_weights_confine_movement(spark):
    before = {"a": {"x": {0: 1.0, 1: 2.0}, "y": {2: 1.0}}, "b": {"z": {3: 1.0, 4: 1.0}}}
    after = {"a": {"x": {0: 1.0, 1: 2.0}, "y": {2: 1.0}}, "b": {"z": {3: 2.0, 4: 1.0}}}
    out = spark.range(20000).select(sharding.descend(F.col("id"), before).alias("s"), sharding.descend(F.col("id"), after).alias("t"))
    counts, moves = Counter(), Counter()
    for r in out.collect():
        counts[r.s] += 1
        moves[r.s, r.t] += r.s != r.t
    assert all(abs(counts[k] - 20000 * w / 6) < 5 * math.sqrt(20000 * w / 6) for k, w in {0: 1, 1: 2, 2: 1, 3: 1, 4: 1}.items())
    # only region b weighs more: what moves goes there, and inside b only into shard 3
    assert all(t in (3, 4) for (s, t), n in moves.items() if n)
    assert not moves[3, 4] and not any(moves[s, t] for s in (0, 1, 2) for t in (0, 1, 2) if s != t)


def plain_descent(key, tree, path=""):
    """The tree descended in plain Python, with the public xxHash."""
    import xxhash

    if not isinstance(tree, dict):
        return None
    start = 42 if key is None else xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), seed=42).intdigest()
    best = None
    for name, child in tree.items():
        if (w := sharding.weight(child)) > 0:
            bits = xxhash.xxh64(f"{path}/{name}".encode(), seed=start).intdigest() >> 11
            d = -math.log((bits + 0.5) / (1 << 53)) / w
            if best is None or d < best[0]:
                best = (d, name, child)
    return plain_descent(key, best[2], f"{path}/{best[1]}") if isinstance(best[2], dict) else best[1]


@pytest.mark.parametrize("tree", [sharding.grown_topology(16), sharding.grown_topology(19, 16), {"a": {"x": {0: 1.5, 1: 0}, "y": {2: 3}}, "b": {"z": {3: 0}}}],
                         ids=["sixteen", "grown", "weighted"])
def test_descent_against_plain_python(spark, tree):
    ids = [*range(-50, 3000), 10**15, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r.doc_id: r.s for r in df.select("doc_id", sharding.descend(F.col("doc_id"), tree).alias("s")).collect()}
    assert got == {i: plain_descent(i, tree) for i in ids}
