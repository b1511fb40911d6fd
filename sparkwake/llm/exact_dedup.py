"""Exact dedup by content sort: range partition, external sort, neighbouring full comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, materialise


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int | None = None) -> DataFrame:
    """Decide for every row whether it stays; equal texts (after lower-casing A-Z) keep the largest id.

    Sampled splitters range-partition the rows on (first bytes, hash, salt) of the normalised text, so
    equal texts meet in the sort order while a group that holds a third of the table still spans many
    partitions; splitters stay short however long the texts are. Each partition is sorted externally by the whole
    normalised text and then by id, and each row is compared in full with its neighbour: the last row of
    a run is the run's survivor and knows the run's length. Runs of one text (at most ``salts``) are then
    joined by their SHA-256. Unless given, ``salts`` is twice the number of shuffle partitions, which follows the cluster and the table.

    Nulls count as empty texts; all empty texts form one group. Rows that repeat an id with the same text
    count in group_size and only one of them is kept. A null id sorts first, so it stays only if all ids of the
    group are null, and then kept is true for one row. Other columns are ignored; an empty table gives no rows.

    Returns doc_id, keep_id, group_size, kept, text_sha256 — one row per input row.
    """
    salts = salts or max(256, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm")
    ).select(
        "doc_id",
        "norm",
        F.substring("norm", 1, 24).alias("head"),
        F.xxhash64("norm").alias("hash"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"),
    )
    run = Window.partitionBy("head", "hash", "norm", "salt").orderBy("doc_id")
    ranged = rows.repartitionByRange("head", "hash", "salt")
    runs = materialise(
        ranged.select(
            "doc_id",
            "salt",
            F.sha2("norm", 256).alias("sha"),
            F.row_number().over(run).alias("nth"),
            F.lead(F.lit(True)).over(run).isNull().alias("tail"),
        )
    )
    text = Window.partitionBy("sha")
    tails = runs.where("tail").select(
        "sha",
        "salt",
        F.max("doc_id").over(text).alias("keep_id"),
        F.sum("nth").over(text).alias("group_size"),
        (F.row_number().over(text.orderBy(F.col("doc_id").desc_nulls_last(), "salt")) == 1).alias("last"),
    )
    return runs.join(tails, ["sha", "salt"]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("tail") & F.col("last")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that content_sort keeps, with all their columns.

    Rows that repeat an id and a text are one row afterwards; only those few pass through a
    dropDuplicates of their own.
    """
    decided = materialise(content_sort(docs, id_col, text_col))
    key, text = "__id", "__sha"
    keyed = docs.withColumns({
        key: F.col(id_col),
        text: F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256),
    })
    same = (decided["doc_id"].eqNullSafe(keyed[key])) & (decided["text_sha256"] == keyed[text])
    kept = decided.where("kept")
    repeats = decided.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "text_sha256").distinct()
    if repeats.isEmpty():
        return keyed.join(kept, same, "left_semi").drop(key, text)
    stays = keyed.join(kept, same, "left_semi")
    again = (repeats["doc_id"].eqNullSafe(stays[key])) & (repeats["text_sha256"] == stays[text])
    once = stays.join(repeats, again, "left_semi").dropDuplicates([key, text])
    return stays.join(repeats, again, "left_anti").unionByName(once).drop(key, text)
