"""The registered queries of this package: thin wrappers with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (conversations, dedup_stream, fuzzy_lines, language, lattice, mixing, ngram_join, packing, quality, search, secrets,
               toxicity, warc)
from .common import documents


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "shard", "copies")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_stream.exact_dedup(spark, f"{sf_dir}/documents.parquet")


def op5_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lattice_scores(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.secret_spans(documents(spark, sf_dir)))


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_report(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_language_id, op3_mix_sources, op4_exact_dedup, op5_lattice_scores, op6_line_dedup,
                                   op7_quality_rules, op8_best_fit_packing, op9_toxicity, op10_secret_scans, op11_warc_bundles,
                                   op12_lexical_search, op13_conversation_repair)}
