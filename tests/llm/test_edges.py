"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sparkwake.llm import exact_dedup, mixing, near_dedup, piece_codec, repeat_spans, secret_scan, token_counts, topk_search, toxicity, url_filter

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = "the quick brown fox jumps over the lazy dog " * 4000
TEXTS = [
    (0, "Hello World again and again", "a"), (1, "hello world again and again", "a"), (2, None, None), (3, "", "b"), (4, " \n\t ", "b"), (5, LONG, "a"),
    (5, LONG, "a"), (6, "one", "c"), (7, "ONE", None), (8, "naïve Ärger çà €", "b"), (None, "no id at all here", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(TEXTS, "doc_id long, text string, source string")
    clashing = "lang n_chars key n rep comp score kept size taken spans hash salt norm label".split()
    return plain.withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_exact_dedup(docs, none):
    got = exact_dedup.content_sort(docs).collect()
    assert len(got) == len(TEXTS)
    kept = sorted((r["doc_id"] for r in got if r["kept"]), key=str)
    assert kept == sorted([1, 3, 4, 5, 7, 8, None], key=str)
    assert {r["doc_id"]: r["group_size"] for r in got} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 1, 5: 2, 6: 2, 7: 2, 8: 1, None: 1}
    eight = next(r for r in got if r["doc_id"] == 8)
    assert eight["text_sha256"] == hashlib.sha256("naïve Ärger çà €".replace("Ä", "Ä").encode()).hexdigest()
    assert exact_dedup.content_sort(none).count() == 0
    survivors = exact_dedup.keep_survivors(docs)
    assert survivors.columns == docs.columns and survivors.count() == 7


def test_hot_group_spans_salts(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 200, "Same Text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.content_sort(df, salts=8).collect()
    assert {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] < 200} == {(199, 200)}
    assert sum(r["kept"] for r in got) == 101


def test_mixing(docs, none):
    got = mixing.mix(docs, block=2).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in TEXTS]
    assert sorted(r["size"] for r in got) == sorted(sizes) and total == sum(sizes)
    assert mixing.mix(none).count() == 0


def test_mixing_meets_targets_and_reruns_agree(spark):
    df = spark.range(600).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37 + 3).cast("int")).alias("text"),
        F.when(F.col("id") < 400, "a").when(F.col("id") < 550, "b").when(F.col("id") < 595, "c").alias("source"),
    )
    rows = mixing.mix(df, block=4, shard_words=500).collect()
    by = {}
    for r in rows:
        by.setdefault(r["source_size"], [r["target"], 0])[1] += r["taken"]
    for size, (target, taken) in by.items():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= 0.05 * target + 8
    assert abs(sum(t for t, _ in by.values()) - sum(r["size"] for r in rows)) < 1e-6
    again = mixing.mix(df.repartition(7), block=4, shard_words=500).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert mixing.draw_copies(df).columns == df.columns


def test_sainte_lague_ranks_quotients(spark):
    votes = spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0)], "p string, v double")
    got = {r["p"]: r["seats"] for r in mixing.sainte_lague(votes, [], "p", F.col("v"), F.lit(7)).collect()}
    quotients = sorted(((v / (2 * k + 1), p) for p, v in (("a", 53), ("b", 24), ("c", 23)) for k in range(7)), key=lambda x: (-x[0], x[1]))[:7]
    assert {p: got.get(p, 0) for p in "abc"} == {p: sum(q == p for _, q in quotients) for p in "abc"}


def test_near_duplicates(docs, none):
    got = near_dedup.near_duplicates(docs, width=2).collect()
    comp = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
    assert len(got) == len(TEXTS)
    assert comp[0] == comp[1] == (4, 0) and comp[2] == (0, 2) and comp[4] == (0, 4) and comp[6] == (1, 6) and comp[7] == (1, 6)
    assert comp[5] == (9, 5) and comp[None] == (None, None)
    assert near_dedup.near_duplicates(none).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    counted = token_counts.count_tokens(docs, WORDS)
    counted = counted.withColumns({"n_tokens": token_counts.total(F.col("prefixes")), "within": token_counts.words_within(F.col("prefixes"), 2)})
    got = {r["doc_id"]: r for r in counted.collect()}
    for i, text, _ in TEXTS:
        assert got[i]["n_tokens"] == len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[i]["n_bytes"] == len((text or "").encode())
    words = TEXTS[0][1].split()
    assert got[0]["prefixes"] == [len(library.encode(" ".join(words[: k + 1]), add_special_tokens=False).ids) for k in range(len(words))]
    assert got[0]["within"] == 2 and got[2]["within"] == 0 and got[6]["within"] == 1
    assert token_counts.count_tokens(none, WORDS).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    coded = piece_codec.encode(docs, PIECES, chunk=5000, decoded=True).collect()
    assert len(coded) == len(TEXTS)
    wanted = {i: (t or "") for i, t, _ in TEXTS}
    for r in coded:
        assert r["ids"] == library.encode(wanted[r["doc_id"]]) and r["decoded"] == wanted[r["doc_id"]]
    assert piece_codec.encode(none, PIECES).count() == 0


def test_repeated_spans(docs, none):
    spans = repeat_spans.repeated_spans(docs)
    got = sorted(repeat_spans.without_spans(docs, spans).drop("kept").collect(), key=lambda r: str(r["doc_id"]))
    assert len(got) == len(TEXTS)
    assert all(r["n_removed"] == (r["n_bytes"] if r["doc_id"] == 5 else 0) for r in got)
    assert all(r["n_spans"] == (r["doc_id"] == 5) for r in got)
    assert repeat_spans.repeated_spans(none).count() == 0


def test_secret_scan(docs, none):
    assert secret_scan.scan(docs).where("size(found) > 0").count() == 0
    assert secret_scan.scan(docs).count() == len(TEXTS) and secret_scan.scan(none).count() == 0


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scored) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert toxicity.fit(docs, labels.where("false")).bias < 0


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-1.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    v = df.select("vec_id", topk_search.quantised(F.col("embedding")).alias("v"))
    got = topk_search.top_k(v, v.where("vec_id % 100 = 0"), k=3).orderBy("query_id", "rank").collect()
    one = 1024 * 1024 + 512 * 512
    assert [tuple(r) for r in got] == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 100, 0), (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0)]
    assert topk_search.top_k(v.where("false"), v.where("false")).count() == 0


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1", "https://a.example.com/en/2?q#x", "https://b.net/es/", "https://b.net/ex", "nothing", None, "", "://", "https://com", "https://x.com?/a", "https://b.net/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    got = {r["page_id"]: r for r in url_filter.judge(df, rules).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, None, None, "net/es/"]
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("www.example.com", "/en/1", "allow")
    assert (got[1]["path"], got[8]["path"], got[9]["host"]) == ("/en/2", "", "x.com")
    assert all((got[i]["host"], got[i]["path"]) == ("", "") for i in (4, 5, 6, 7))
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(df.where("false"), rules).count() == 0


def test_pieces_of_giant_texts_keep_all_words():
    from sparkwake.llm.common import pieces

    for text in ("", " ", "a", "ab cd  ef\n" * 50, "x" * 100, " lead and trail "):
        assert "".join(pieces(text, 7)) == text
        assert [w for p in pieces(text, 7) for w in p.split()] == text.split()
        assert [w for p in pieces(text.encode(), 7) for w in p.split()] == text.encode().split()
