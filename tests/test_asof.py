"""The traps of bitemporal snapshots."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwake.operators import asof


def test_revisions_become_visible_when_available(spark):
    book = spark.createDataFrame([("m1", 2, 0, 1.0), ("m1", 5, 1, 9.0)], "record_id string, available_time long, source_revision long, value double")
    value = lambda at: [r["value"] for r in asof.snapshot(book, F.lit(at), ["record_id"]).collect()]
    assert value(4) == [1.0] and value(6) == [9.0] and value(1) == []
    many = {(r["decision_time"], r["value"]) for r in asof.snapshots(book, [1, 4, 5, 6], ["record_id"]).collect()}
    assert many == {(4, 1.0), (5, 9.0), (6, 9.0)}


def test_late_lower_revision_is_never_latest(spark):
    book = spark.createDataFrame([("m", 2, 1, 1.0), ("m", 5, 0, 9.0)], "record_id string, available_time long, source_revision long, value double")
    assert [r["value"] for r in asof.snapshot(book, F.lit(9), ["record_id"]).collect()] == [1.0]
    assert asof.validity(book, ["record_id"]).count() == 1


def test_correction_ends_membership_before_containment(spark):
    rows = [("a", 0, None, 0, 0), ("a", 0, 20, 5, 1)]
    m = spark.createDataFrame(rows, "instrument_id string, start long, end long, available_time long, source_revision long")
    assert asof.members_at(m.where("available_time < 5"), F.lit(30)).count() == 1
    assert asof.members_at(m, F.lit(30)).count() == 0
    assert asof.members_at(m, F.lit(19)).count() == 1


def test_equal_revisions_with_other_content_fail(spark):
    book = spark.createDataFrame([("m", 1, 0, 1.0), ("m", 2, 0, 2.0)], "record_id string, available_time long, source_revision long, value double")
    with pytest.raises(ValueError, match="equal revisions"):
        asof.snapshot(book, F.lit(9), ["record_id"])
    assert asof.snapshot(book, F.lit(1), ["record_id"]).count() == 1


def test_panel_rejects_missing_fields(spark):
    df = spark.sql("select 'a' as instrument_id, map('x', 1.0D) as fields union all select 'b', map('y', 1.0D)")
    with pytest.raises(Exception, match="missing or not finite"):
        asof.panel(df, ["x"]).collect()


def test_settlement_waits_for_a_decision(spark):
    p = spark.createDataFrame([("t1", 1), ("t2", 2)], "target_id string, predicted_at long")
    y = spark.createDataFrame([("t1", 3, 2.0)], "target_id string, available_time long, value double")
    got = {r["target_id"]: r["settled_at"] for r in asof.settle(p, y, [1, 2, 4]).collect()}
    assert got == {"t1": 4, "t2": None}
    assert asof.leaks(p, y).count() == 0


def test_places_among_many_times(spark):
    times = [3, 3, 7, 9, 12, 20, 21, 22, 30]
    df = spark.range(-1, 35)
    got = {r["id"]: (r["a"], r["b"]) for r in df.select("id", asof.place_in(times, F.col("id")).alias("a"), asof.place_in(times, F.col("id"), after=True).alias("b")).collect()}
    assert got == {x: (sum(t < x for t in times), sum(t <= x for t in times)) for x in range(-1, 35)}
    assert df.select(asof.place_in([5], F.col("id")).alias("a")).agg(F.max("a")).first()[0] == 1


def test_bound_fields_must_be_there(spark):
    df = spark.sql("select 1 as k, map('x', 1.0D, 'y', 2.0D) as fields")
    assert asof.bind(df, ["k"], ["y", "x"]).first()["features"] == [2.0, 1.0]
    with pytest.raises(Exception, match="missing or not finite"):
        asof.bind(df, ["k"], ["z"]).collect()


def test_books_grow_but_what_was_consumed_stays(spark):
    book = spark.createDataFrame([("m", 2, 0, 1.0)], "record_id string, available_time long, source_revision long, value double")
    late = spark.createDataFrame([("m", 9, 1, 2.0)], book.schema)
    grown = asof.append_events(book, late, ["record_id"])
    asof.unchanged_prefix(book, grown, 5)
    with pytest.raises(ValueError, match="already"):
        asof.append_events(book, book, ["record_id"])
    with pytest.raises(ValueError, match="added"):
        asof.unchanged_prefix(book, asof.append_events(book, late.withColumn("available_time", F.lit(3).cast("long")), ["record_id"]), 5)
    with pytest.raises(ValueError, match="gone or changed"):
        asof.unchanged_prefix(book, book.withColumn("value", F.lit(7.0)), 5)


def test_one_place_of_the_canonical_order_holds_one_event(spark):
    events = spark.createDataFrame([(1, "market", 0, "a"), (1, "universe", 0, "a"), (1, "label", 0, "a")], "available_time long, kind string, ingest_sequence long, record_id string")
    assert [r["kind"] for r in asof.canonical_order(events).collect()] == ["universe", "market", "label"]
    with pytest.raises(ValueError, match="one place"):
        asof.canonical_order(events.unionByName(events))


def test_unknown_label_times_fail(spark):
    index = spark.createDataFrame([("a", 1, 0)], "k string, at long, position long")
    with pytest.raises(Exception, match="not in the index"):
        asof.feature_places(spark.createDataFrame([("a", 2)], "k string, at long"), index, ["k"]).collect()
