"""The training-data queries on the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, language, licenses, near_dedup, pii, piece_bpe, shards, token_counts, turn_trie, urls, whitening
from .common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.limits(token_counts.length_histogram(table(spark, sf_dir, "documents"), TOKENIZER))


def op2_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [counted(k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand as files ``source/lang/doc_id``; those that are licence texts for the most part speak for their directory."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return licenses.scan_licenses(docs)


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op8_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op11_rank_one_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_tour_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = piece_bpe.round_trip(table(spark, sf_dir, "documents"), PIECES)
    numbers = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return back.select("doc_id", "n_tokens", F.sha2(numbers, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_histogram, op2_odd_sketch_dedup, op3_semi_markov_pii, op4_license_scan, op5_prefix_bpe, op6_language_crf, op7_url_rules, op8_containment, op9_exact_dedup, op10_vector_packing, op11_rank_one_whitening, op12_tour_trie, op13_piece_agenda)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.SQL, "op2_odd_sketch_dedup": near_dedup.SQL, "op7_url_rules": urls.SQL, "op8_containment": decontaminate.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_tour_trie": turn_trie.SQL}
