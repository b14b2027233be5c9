"""The registered queries: each operator over its whole tables."""

from __future__ import annotations

from quarry.llm import bpe, decontam, exact_dedup, jaccard_join, license_scan, minhash, prefix_trie, quality, ranked_search, sharding, suffix_dedup, url_filter, warc
from quarry.llm.common import table


def op1_license_scan(spark, sf_dir):
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op3_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("strict_hits", "soft_hits")


def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op8_nb_svm_quality(spark, sf_dir):
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe_forced_cuts(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


def op10_hash_tree_sharding(spark, sf_dir):
    return sharding.sharded(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark, sf_dir):
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (op1_license_scan, op2_minhash_near_dedup, op3_url_filter, op4_warc, op5_benchmark_decontamination, op6_exact_dedup,
                                  op7_suffix_array_dedup, op8_nb_svm_quality, op9_bpe_forced_cuts, op10_hash_tree_sharding, op11_ranked_search, op12_prefix_trie, op13_jaccard_join)}
