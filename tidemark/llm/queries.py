"""Registered queries of the training-text operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    decontamination,
    filter_audit,
    jaccard_join,
    licenses,
    near_dups,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    secrets,
    token_counts,
    token_shards,
    url_filters,
)
from tidemark.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def put(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return put


MODEL = public_tokenizers.path("piece_bpe_32k.model")


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(token_counts.count_tokens(table(spark, folder, "documents"), MODEL))


@query("op2_decontamination")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.match_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_quality_rules")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents"))


@query("op5_near_duplicates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_url_filter", url_filters.filter_urls_sql())
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, folder, "pages"))


@query("op8_token_shards")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_shards.write_shards(table(spark, folder, "documents"), MODEL).drop("folder")


@query("op9_license_scan", licenses.scan_licenses_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    told = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first"].cast("string"), s["last"].cast("string")))
    return found.withColumn("spans", F.array_join(told, ","))


@query("op10_token_counts")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), MODEL)


@query("op11_filter_audit", filter_audit.audit_filters_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op12_prefix_trie", prefix_trie.conversation_trie_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query("op13_jaccard_join", jaccard_join.jaccard_components_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, folder, "documents")).drop("node")
