"""Registered queries of the package, over whole tables."""

from __future__ import annotations

from foldmark.llm import decontaminate, edit_embedding, extract, llr, merkle, mixing, preference, quality, secret_scan, simhash, suffix_tree, urls, whitening
from foldmark.llm.common import table
from foldmark.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_url_reputation", urls.ORACLE)
def op1(spark, sf):
    pages = table(spark, sf, "pages")
    return urls.judged(pages, urls.outcomes_of(pages, table(spark, sf, "labels")))


@query("op3_simhash_gray")
def op3(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op5_source_mix", mixing.ORACLE)
def op5(spark, sf):
    return mixing.mixed(table(spark, sf, "documents"))


@query("op7_preference_format", preference.ORACLE)
def op7(spark, sf):
    return preference.formatted(*preference.swapped_replies(table(spark, sf, "conversations")))


@query("op8_llr_rules")
def op8(spark, sf):
    return llr.judged(table(spark, sf, "documents"), llr.trusted_sample(table(spark, sf, "labels")))


@query("op9_qgram_decontamination")
def op9(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op10_secret_scan")
def op10(spark, sf):
    return secret_scan.report(table(spark, sf, "documents"))


@query("op2_quality_fm")
def op2(spark, sf):
    return quality.scored(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op4_suffix_tree_lm")
def op4(spark, sf):
    return suffix_tree.scored(table(spark, sf, "documents"))


@query("op6_dom_extraction")
def op6(spark, sf):
    return extract.extracted(table(spark, sf, "pages"))


@query("op12_merkle_manifest", merkle.ORACLE)
def op12(spark, sf):
    return merkle.part_tampered(table(spark, sf, "documents"))


@query("op13_pivoted_whitening")
def op13(spark, sf):
    return whitening.whitened(table(spark, sf, "embeddings"))


@query("op11_edit_embedding")
def op11(spark, sf):
    return edit_embedding.edited(table(spark, sf, "documents"))
