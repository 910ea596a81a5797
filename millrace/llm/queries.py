"""One query per operator, over the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import brown, contamination, divergence, host_rules, licenses, mixing, privacy, quality, simhash, sql, substrings, urllists, vantage, variants
from millrace.llm.common import table
from millrace.llm.registry import query


@query()
def op1_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.report(table(spark, sf_dir, "documents"))


@query()
def op2_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


@query(sql.HOST_RULES)
def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(table(spark, sf_dir, "documents"))


@query(sql.SUBSTRINGS)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digest(table(spark, sf_dir, "documents"))


@query()
def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "n_windows", "n_slots")


@query(urllists.SQL)
def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = urllists.judged(urllists.with_fetch_day(pages), urllists.derived_events(pages))
    return found.withColumn("fetched", found["fetched"].cast("string"))


@query()
def op9_class_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.perplexities(table(spark, sf_dir, "documents"))


@query()
def op10_target_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.grouped(table(spark, sf_dir, "documents"))


@query(vantage.SQL)
def op12_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.searched(table(spark, sf_dir, "embeddings"))


@query(divergence.SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))
