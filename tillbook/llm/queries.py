"""Registered queries of the subpackage: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm import (clustering, contamination, html_diff, lexical, licenses, line_templates, mixing, quality, sharding, simhash,
                          token_files, url_alias, vantage)
from tillbook.llm.common import word_count

#: Shards of the sharding query.
SHARDS = 40
#: Vocabulary file of the token query.
TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_quality_rules(spark, sf_dir):
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"), SHARDS)


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_html_extraction(spark, sf_dir):
    return html_diff.main_text(_table(spark, sf_dir, "pages"))


def op5_license_scans(spark, sf_dir):
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark, sf_dir):
    return contamination.containments(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_line_templates(spark, sf_dir):
    return line_templates.drop_recurring(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_source_mixing(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", word_count(F.col("text")).alias("words"))
    return mixing.mix_plan(narrow, F.col("words")).select("doc_id", "size", "source_size", "target", "taken")


def op10_url_filters(spark, sf_dir):
    return url_alias.judge(_table(spark, sf_dir, "pages"))


def op11_lexical_search(spark, sf_dir):
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_centroid_clusters(spark, sf_dir):
    return clustering.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_nearest_neighbours(spark, sf_dir):
    return vantage.nearest(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_sharding": op2_sharding,
    "op3_token_files": op3_token_files,
    "op4_html_extraction": op4_html_extraction,
    "op5_license_scans": op5_license_scans,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_line_templates": op8_line_templates,
    "op9_source_mixing": op9_source_mixing,
    "op10_url_filters": op10_url_filters,
    "op11_lexical_search": op11_lexical_search,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_nearest_neighbours": op13_nearest_neighbours,
}
