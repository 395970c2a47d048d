"""The queries of this folder, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, filter_audit, html_text, langid, lengths, licenses, neardup, ogg, prefix_trie, token_files, toxicity, vector_join
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), bpe.tokenizer_text())


def op3_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(ogg.media_column(table(spark, sf_dir, "documents")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(spark, table(spark, sf_dir, "documents"), bpe.tokenizer_text("word_bpe_49k.json"))[0]


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.token_length_histogram(table(spark, sf_dir, "documents"), bpe.tokenizer_text())


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_join.vector_links(spark, table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark, table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe_tree": op2_bpe_tree,
    "op3_ogg_media": op3_ogg_media,
    "op4_token_files": op4_token_files,
    "op5_decontamination": op5_decontamination,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_toxicity": op7_toxicity,
    "op8_language_id": op8_language_id,
    "op9_token_lengths": op9_token_lengths,
    "op10_html_text": op10_html_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_links": op12_vector_links,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op1_license_scan": licenses.scan_sql(), "op11_filter_audit": filter_audit.audit_sql(), "op12_vector_links": vector_join.links_sql(), "op13_prefix_trie": prefix_trie.trie_sql()}
