"""A training corpus from raw documents: five stages, each on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwake.llm import exact_dedup, mixing, near_dedup, piece_codec, toxicity
from sparkwake.llm.common import drop_since, materialise, table, tables_written

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents scored at or above the threshold go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("__read", F.col("text")), model, text_col="__read", carry=DOCUMENT, score_col="__score")
    return scored.where(F.col("__score") < toxicity.THRESHOLD).select(*DOCUMENT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of equal texts the largest id stays."""
    return exact_dedup.keep_survivors(docs).select(*DOCUMENT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, on shingles of five words at 0.8: the smallest id of each component stays; rows without an id stay.

    Rows that share an id are told apart by their texts.
    """
    found = near_dedup.near_duplicates(docs, width=5, percent=80)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return docs.join(gone, same, "left_anti").select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: each document as often as its source's quota takes it."""
    return mixing.draw_copies(docs).select(*DOCUMENT)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: piece ids of each text, and the SHA-256 of what they decode to."""
    coded = piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), carry=("doc_id", "lang", "source"), decoded=True)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Trained scores and piece codes are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = table(spark, sf_dir, "documents"), tables_written()
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        drop_since(mark)
    return docs
