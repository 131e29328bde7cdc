"""The registered queries of this folder: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import op1_hmm, op2_urls, op3_shards, op4_html, op5_rules, op6_language, op7_simhash, op8_quality, op9_bpe, op10_decontaminate, op11_collocations, op12_packing, op13_spelling
from lexloom.llm.common import table


def op1_hmm_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_hmm.score(table(spark, sf_dir, "documents"))


def op2_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_urls.judge(table(spark, sf_dir, "pages"))


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_shards.by_bytes(table(spark, sf_dir, "documents"))


def op4_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_html.main_text(table(spark, sf_dir, "pages"))


def op5_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_language.identify(table(spark, sf_dir, "documents"))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_bpe_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_bpe.digests(table(spark, sf_dir, "documents"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_collocations.mine(table(spark, sf_dir, "documents"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_packing.digests(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = (op1_hmm_language_model, op2_url_verdicts, op3_minimax_shards, op4_template_text, op5_decision_list, op6_language_codes, op7_simhash_near_duplicates, op8_quality_network, op9_bpe_digests, op10_benchmark_leaks, op11_phrase_collocations, op12_best_fit_packing, op13_spelling_variants)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_verdicts": op2_urls.oracle(), "op11_phrase_collocations": op11_collocations.oracle(), "op13_spelling_variants": op13_spelling.oracle()}
