"""The corpus pipeline against a plain version of each stage on the rows that reached it."""

from __future__ import annotations

import collections

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sparkwake.llm import mixing, toxicity
from sparkwake.llm.common import materialise

from ..oracle import SF
from .test_bruteforce import components, shingles


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialise(stage(spark, kept[-1], SF)))
    for df in kept[:-1]:
        assert df.columns == list(corpus_pipeline.DOCUMENT)
    rows = [{r["doc_id"]: r for r in df.collect()} for df in kept]

    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    sums: dict = {}
    words = {i: toxicity.words_of(r["text"] or "") for i, r in rows[0].items()}
    toxicity.learn_sums({w for d in words.values() for w in d}, sums, model.share)
    assert set(rows[1]) == {i for i, d in words.items() if toxicity.probability(d, sums, model) < toxicity.THRESHOLD}

    groups = collections.defaultdict(list)
    for i, r in rows[1].items():
        groups[(r["text"] or "").encode().lower()].append(i)
    assert set(rows[2]) == {max(g) for g in groups.values()}

    comp = components({i: shingles(r["text"], 5) for i, r in rows[2].items()}, 80)
    assert set(rows[3]) == {i for i, c in comp.items() if i == c}

    taken = {r["doc_id"]: r for r in mixing.mix(kept[3]).collect()}
    copies = collections.Counter(r["doc_id"] for r in kept[4].collect())
    for i, r in taken.items():
        assert abs(copies[i] - (r["taken"] / r["size"] if r["size"] else 0)) < 1

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = kept[5].collect()
    assert len(coded) == sum(copies.values())
    assert all(r["ids"] == library.encode(rows[4][r["doc_id"]]["text"] or "") for r in coded)


EDGES = [
    (1, "clean words that stand here for the first time in this table and go on a while", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n ", "en", "b", 3),
    (5, "The same text, twice with one id.", "en", "a", 1), (5, "The same text, twice with one id.", "en", "a", 1), (5, "another text under that id which nobody else has got in here", "en", "b", 1),
    (None, "no id", "en", "a", 1), (None, "no id", "en", "a", 1), (6, "word " * 90_000, "en", "c", 1), (7, "CLEAN words that stand here for the first time in this table and go on a while", "de", "a", 1),
]


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, and no rows at all; labels with further columns."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, 0, i % 2, "x") for i in range(8)], "doc_id long, quality long, toxic long, text string").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (EDGES, []):
        docs = spark.createDataFrame(rows, columns).withColumns({c: F.lit("x") for c in ("key", "size", "kept", "shard", "score", "component_id")})
        kept = [docs]
        for name, stage in corpus_pipeline.STAGES:
            before = kept[-1] if name != "exact dedup" else docs.select(*corpus_pipeline.DOCUMENT)  # the model of eight labels may reject anything
            kept.append(materialise(stage(spark, before, str(tmp_path))))
        ids = [sorted((r["doc_id"] for r in df.collect()), key=str) for df in kept]
        if rows:
            assert ids[2] == sorted([3, 4, 5, 5, 6, 7, None], key=str) and ids[3] == ids[2]
            assert all(i in ids[3] for i in ids[4])
        else:
            assert ids == [[]] * 6
