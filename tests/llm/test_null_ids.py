"""Rows without an id hold their share of what an operator makes."""

from __future__ import annotations

import collections
import random

from pyspark.sql import functions as F

import corpus_pipeline
from sparkwake.llm import mixing, repeat_spans


def test_mixing_stage_keeps_rows_without_an_id(spark):
    docs = spark.range(1500).select(
        F.when(F.col("id") % 5 > 1, F.col("id")).alias("doc_id"), F.concat(F.repeat(F.lit("w "), (F.col("id") % 37 + 20).cast("int")), F.lit("t"), "id").alias("text"),
        F.lit("en").alias("lang"), F.when(F.col("id") < 900, "a").when(F.col("id") < 1300, "b").when(F.col("id") < 1450, "c").alias("source"), F.lit(0).alias("n_chars"),
    )
    rows = corpus_pipeline.mix_sources(spark, docs, "").collect()
    words, without = collections.Counter(), collections.Counter()
    for r in rows:
        words[r["source"]] += len(r["text"].split())
        without[r["source"]] += len(r["text"].split()) * (r["doc_id"] is None)
    by_size = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}
    targets = {r["source_size"]: r["target"] for r in mixing.mix(docs).collect()}
    for source, size in by_size.items():
        assert abs(words[source] - targets[size]) < 0.12 * targets[size], source
        assert 0.25 < without[source] / words[source] < 0.55, source
    assert {r["text"] for r in rows} <= {r["text"] for r in docs.collect()}


def test_copies_of_an_id_are_told_apart_by_source(spark):
    rows = [(i, f"{'w ' * 63}{s}{i}", s) for i in range(200) for s in ("a", "b")] + [(1000 + i, f"{'w ' * 63}a{i}", "a") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    drawn = collections.Counter((r["doc_id"], r["source"]) for r in mixing.draw_copies(docs).collect())
    taken = {(r["doc_id"], r["source_size"]): r["taken"] / r["size"] for r in mixing.mix(docs).collect()}
    sizes = {"a": 64 * 1000, "b": 64 * 200}
    assert all(abs(drawn[i, s] - taken[i, sizes[s]]) < 1 for i, _, s in rows)


def test_repeated_spans_of_rows_without_an_id(spark):
    letters = lambda seed, n: "".join(chr(97 + b % 26) for b in random.Random(seed).randbytes(n))
    passage, copy = letters(1, 450), letters(2, 700)
    texts = [
        (1, letters(3, 300) + passage + letters(4, 200), 450), (None, letters(5, 100) + passage + letters(6, 500), 450),
        (None, copy, 700), (None, copy, 700), (2, letters(7, 900), 0), (None, letters(8, 900), 0), (None, None, 0),
        (None, letters(9, 500) * 2, 1000),
        # copies without an id share a passage with a text that stands alone
        (3, letters(10, 50) + letters(11, 600)[:420], 420), (None, letters(11, 600), 600), (None, letters(11, 600), 600),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    made = repeat_spans.without_spans(docs, repeat_spans.repeated_spans(docs)).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in made), key=key) == sorted(((i, len(t or ""), n) for i, t, n in texts), key=key)
