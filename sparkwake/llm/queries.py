"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, mixing, near_dedup, piece_codec, repeat_spans, secret_scan, token_counts, topk_search, toxicity, url_filter
from .common import table

# The rules of op2, (verdict, host, path).
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

TOKEN_LIMIT = 2048


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.quantised(F.col("embedding")).alias("v"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.drop("text_key").withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    n_tokens = token_counts.total(F.col("prefixes"))
    return counted.select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > TOKEN_LIMIT).alias("over_limit"),
        token_counts.words_within(F.col("prefixes"), TOKEN_LIMIT).alias("words_within"), "prefixes",
    )


def op6_repeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = repeat_spans.without_spans(docs, repeat_spans.repeated_spans(docs, passage=repeat_spans.PASSAGE))
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"), (F.size("passages") > 0).alias("has_passage"),
    )


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = piece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"), secret_scan.joined("found").alias("spans"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_topk_search": op1_topk_search,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_near_dedup": op4_near_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_repeat_spans": op6_repeat_spans,
        "op7_piece_codec": op7_piece_codec,
        "op8_secret_scan": op8_secret_scan,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_mix_sources": op10_mix_sources,
    }
