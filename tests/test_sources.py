"""Strict feeds, books, ledgers and price panels."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkwake.sources import feeds, synthetic

MARKET = {"record_id": "m1", "instrument_id": "a", "event_time": 1, "available_time": 2, "source_revision": 0, "ingest_sequence": 0, "fields": {"x": 1.5}}


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_role_reads_back_what_was_written(spark, tmp_path):
    df = feeds.read_role(spark, lines(tmp_path / "market.jsonl", [MARKET]), "market")
    feeds.write_role(df, str(tmp_path / "out"), "market")
    assert feeds.read_role(spark, str(tmp_path / "out"), "market").collect() == df.collect()


@pytest.mark.parametrize("change", [{"extra": 1}, {"source_revision": "x"}, {"fields": None, "gone": True}])
def test_other_keys_or_types_fail(spark, tmp_path, change):
    row = MARKET | change
    if row.pop("gone", None):
        row.pop("fields")
    with pytest.raises(Exception, match="keys differ|another type"):
        feeds.read_role(spark, lines(tmp_path / "m.jsonl", [row]), "market").collect()


def test_feed_needs_exact_files_and_unique_revisions(spark, tmp_path):
    lines(tmp_path / "market.jsonl", [MARKET, MARKET])
    with pytest.raises(ValueError, match="repeated revision"):
        feeds.read_feed(spark, str(tmp_path), ("market",))
    (tmp_path / "notes.txt").write_text("")
    with pytest.raises(ValueError, match="not exactly"):
        feeds.read_feed(spark, str(tmp_path), ("market",))


def test_book_round_trip_and_tampering(spark, tmp_path):
    book = {"a": spark.range(5).withColumn("x", F.col("id") * 1.5), "b": spark.range(3)}
    feeds.dump_book(book, str(tmp_path / "book"))
    assert feeds.load_book(spark, str(tmp_path / "book"))["a"].count() == 5
    spark.range(1).withColumn("x", F.lit(1.0)).write.mode("append").parquet(str(tmp_path / "book/a"))
    with pytest.raises(ValueError, match="changed"):
        feeds.load_book(spark, str(tmp_path / "book"))


def test_ledger_takes_each_key_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert feeds.append_new(spark, path, spark.range(3), ["id"]) == 3
    assert feeds.append_new(spark, path, spark.range(5), ["id"]) == 2
    assert spark.read.parquet(path).count() == 5


def test_price_panel(spark, tmp_path):
    for name, days in (("A", [0, 86400]), ("B", [86400])):
        body = {"chart": {"result": [{"timestamp": days, "indicators": {"adjclose": [{"adjclose": [float(d + 1) for d in days]}]}}]}}
        (tmp_path / f"{name}.json").write_text(json.dumps(body))
    rows = feeds.common_panel(feeds.read_prices(spark, str(tmp_path)), ["A", "B"]).collect()
    assert [(str(r["d"]), r["A"], r["B"]) for r in rows] == [("1970-01-02", 86401.0, 86401.0)]


def test_synthetic_tables_do_not_depend_on_the_split(spark):
    a = synthetic.regimes(spark, 3, 32, 2, (10, 20), seed=17)
    assert sorted(map(str, a.collect())) == sorted(map(str, synthetic.regimes(spark, 3, 32, 2, (10, 20), seed=17).repartition(2).collect()))
    assert a.where("change_point").count() == 6 and a.select("regime_id").distinct().count() == 3
    c = synthetic.covariance_shift(spark, 4, 20000, 10000).groupBy((F.col("t") < 10000).alias("calm")).agg(F.corr("x", "y").alias("c")).collect()
    assert {r["calm"]: pytest.approx(r["c"], abs=0.02) for r in c} == {True: 0.2, False: 0.9}
