"""Documents through five stages: each filters or encodes all that the one before kept.

Stages decide by a row's own columns or by its text, never by its id: rows with
null or repeated ids are documents of their own. Null and empty texts fail the
base rules, so they leave at the first stage; given to a later one, they have no
language, are copies of each other, hold no benchmark item and have no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import near_copies, op5_rules, op6_language, op9_bpe, op10_decontaminate
from lexloom.llm.common import materialize, release, release_read, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned decision list go."""
    return op5_rules.kept(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an ambiguous one, go."""
    small_batches(spark)
    model = op6_language.fit(docs.where("lang is not null and doc_id is not null"))
    found = op6_language.predict(docs.select(F.struct(*docs.columns).alias("doc"), "text"), model)
    return found.where("lang_pred <> 'und' and not ambiguous").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the row of least id stays, those without id last."""
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text holds a benchmark item go."""
    return op10_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return op9_bpe.digests(docs)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe_encoding", bpe_encoding)]

#: The stages learn rules and models, so SQL can't express their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        before, docs = docs, materialize(made, f"pipeline-{name}")
        release_read(made)
        release(before)
    return docs
