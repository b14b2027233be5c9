"""URL filter: host and path rules, then a weighted vocabulary.

Rules (host, path, verdict) come first: a rule fits its host and all its
subdomains when the URL's path starts with the rule's path; the longest rule
wins. Everything else is judged by the vocabulary: an Aho-Corasick automaton
finds every term in the lower-cased URL in one pass, and in the URL with its
escapes and its punycode labels decoded. A hit counts only when the characters
around it are not letters or digits (of any script). One strict
term, or ``soft_limit`` distinct soft terms, block the URL.

The automaton is built once per task from the (small, given) vocabulary; the
table is only scanned, with no shuffle, and only (page_id, url) are read.

Defined results: a null URL or one without ``://`` has empty host and path, and
fits no rule; a null URL has no hits and is allowed. Repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW),
         ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))
# Default vocabulary: one strict term rejects a URL, SOFT_LIMIT distinct soft terms do.
STRICT = tuple("""
    bestiality camgirl camgirls casino carding cumshot deepfakes escort escorts fullz gangbang hentai hookup incest malware
    milf phishing porn porno pornhub pornstar ransomware stealer upskirt warez webcamsex xnxx xvideos xxx
""".split())
SOFT = tuple("""
    adult adults amateur babes bet bets betting bingo bitcoin blackjack bonus bride brides cams cheap cialis cigarettes clickbait
    coupon crack cracked credit crypto dating debt diet discount download erotic escrow essay fetish forex free freebies
    gambling girls giveaway hack hacked hacks hot jackpot keygen kinky lesbian levitra lingerie loan loans lottery lotto mature
    meds miracle mortgage naked nude nudes nulled offshore payday pharmacy pills pirated poker prescription profit proxy replica
    roulette seo serial sex sexy singles slots spam strip supplement swinger teen topless torrent torrents viagra vpn
    weightloss winner winners
""".split())
SOFT_LIMIT = 2


def automaton(strict: Iterable[str], soft: Iterable[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):  # a term in both lists is strict
        for t in terms:
            a.add_word(t.lower(), (t.lower(), kind))
    a.make_automaton()
    return a


def forms(url: str) -> Iterator[str]:
    """A URL as it is, with its percent escapes decoded, and with its host's punycode labels decoded."""
    yield url
    if "%" in url:
        yield unquote(url)
    for label in re.findall(r"(?i)xn--([0-9a-z-]+)", url):
        try:
            yield label.encode().decode("punycode")
        except UnicodeError:
            continue


def vocabulary_hits(a, url: str) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand as whole words in a form of ``url``."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for u in map(str.lower, forms(url)):
        for end, (term, kind) in a.iter(u):
            start = end + 1 - len(term)
            if (start == 0 or not u[start - 1].isalnum()) and (end + 1 == len(u) or not u[end + 1].isalnum()):
                found[kind].add(term)
    return found["strict"], found["soft"]


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substr(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.coalesce(F.translate(host, upper, lower), F.lit("")),
                              "path": F.coalesce(path, F.lit(""))})


def rule_columns(rules):
    """(rule, verdict) expressions: the longest fitting rule, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is tested first
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict_hits array<string>, soft_hits array<string>")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(strict, soft)
        for batch in urls:
            found = [vocabulary_hits(a, u) if u and (strict or soft) else (set(), set()) for u in batch]
            yield pd.DataFrame({"strict_hits": [sorted(s) for s, _ in found], "soft_hits": [sorted(s) for _, s in found]})

    hit = pages.select("page_id", "url", hits("url").alias("hits")).select("page_id", "url", "hits.*")
    rule, verdict = rule_columns(rules)
    own = F.when((F.size("strict_hits") > 0) | (F.size("soft_hits") >= soft_limit), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return with_host_and_path(hit).select("page_id", "host", "path", rule.alias("rule"),
                                          F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_hits")
