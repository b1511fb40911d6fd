"""Bitemporal snapshots: what was known at a decision time, with the latest revision of each fact."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import checked, empty_or_fail, filled, finite

PRECEDENCE = {"universe": 10, "market": 20, "label": 30}


def visible(events: DataFrame, decision, available: str = "available_time") -> DataFrame:
    """Events that were available at the decision time, inclusive."""
    return events.where(F.col(available) <= decision)


def latest(events: DataFrame, keys: list[str], revision: str = "source_revision") -> DataFrame:
    """The row with the highest revision of each key: one hash aggregation with map-side combine."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), revision).alias("r")).select(*keys, "r.*")


def ambiguous(events: DataFrame, keys: list[str], revision: str = "source_revision") -> DataFrame:
    """Keys whose highest revision stands for differing rows: a snapshot of them must fail."""
    rest = [c for c in events.columns if c not in [*keys, revision]]
    digest = F.sha2(F.to_json(F.struct(*sorted(rest))), 256)
    each = events.groupBy(*keys, revision).agg(F.min(digest).alias("low"), F.max(digest).alias("high"))
    top = each.groupBy(*keys).agg(F.max_by(F.struct("low", "high"), revision).alias("d"))
    return top.where("d.low <> d.high").select(*keys)


def snapshot(events: DataFrame, decision, keys: list[str], revision: str = "source_revision", strict: bool = True) -> DataFrame:
    """The latest visible revision of each key at one decision time; ambiguity is an error if strict."""
    seen = visible(events, decision)
    if strict:
        empty_or_fail(ambiguous(seen, keys, revision), "equal revisions with differing content")
    return latest(seen, keys, revision)


def labels_at(labels: DataFrame, decision, strict: bool = True) -> DataFrame:
    """Labels resolve twice: by label, then by target."""
    by_label = snapshot(labels, decision, ["label_id"], strict=strict)
    if strict:
        empty_or_fail(ambiguous(by_label, ["target_id"]), "two labels of one target with equal revisions")
    return latest(by_label, ["target_id"])


def contains(at, start: str = "start", end: str = "end") -> Column:
    """Half-open membership; an open end never ends."""
    return (F.col(start) <= at) & (F.col(end).isNull() | (F.lit(at) < F.col(end)))


def members_at(memberships: DataFrame, decision, strict: bool = True) -> DataFrame:
    """Active memberships: the latest revision of each interval first, containment second, overlap last."""
    active = snapshot(memberships, decision, ["instrument_id", "start"], strict=strict).where(contains(decision))
    if strict:
        empty_or_fail(active.groupBy("instrument_id").count().where("count > 1"), "overlapping memberships")
    return active


def validity(events: DataFrame, keys: list[str], available: str = "available_time", revision: str = "source_revision") -> DataFrame:
    """Each revision with the half-open time in which it is the latest visible one: valid_from, valid_to (null: still).

    A revision that arrives after a higher one is never the latest. One window per key replaces a scan of the whole
    book per decision.
    """
    by_time = Window.partitionBy(*keys).orderBy(available, revision)
    before = F.max(revision).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    rising = events.withColumn("before", before).where(F.col("before").isNull() | (F.col(revision) > F.col("before"))).drop("before")
    valid = rising.withColumns({"valid_from": F.col(available), "valid_to": F.lead(available).over(by_time)})
    return valid.where(F.col("valid_to").isNull() | (F.col("valid_from") < F.col("valid_to")))


def place_in(times: list, x: Column, after: bool = False) -> Column:
    """How many of the sorted times lie before x, or with ``after`` at or before it: the place of the first that doesn't.

    Looks at the last time of each of about sqrt(n) blocks and then at one block, all in the JVM, so many decisions cost little a row.
    """
    block = max(1, math.isqrt(len(times)))
    passed = (lambda d: d <= x) if after else (lambda d: d < x)
    every = F.array(*[F.lit(t) for t in times])
    lasts = F.array(*[F.lit(times[min(k + block, len(times)) - 1]) for k in range(0, len(times), block)])
    whole = F.size(F.filter(lasts, passed)) * block
    return F.least(F.lit(len(times)), whole + F.size(F.filter(F.slice(every, whole + 1, F.lit(block)), passed)))


def snapshots(events: DataFrame, decisions: list, keys: list[str], available: str = "available_time", revision: str = "source_revision") -> DataFrame:
    """Snapshots at many decision times at once: each validity interval emits the decisions that it holds, without a join.

    The output has a row per decision and visible key, which is what is asked for; nothing else is enumerated.
    """
    ordered = sorted(decisions)
    valid = validity(events, keys, available, revision)
    first = place_in(ordered, F.col("valid_from"))
    end = F.when(F.col("valid_to").isNull(), F.lit(len(ordered))).otherwise(place_in(ordered, F.col("valid_to")))
    held = F.slice(F.array(*[F.lit(d) for d in ordered]), first + 1, F.greatest(F.lit(0), end - first))
    return valid.select(F.explode(held).alias("decision_time"), *[c for c in valid.columns if c not in ("valid_from", "valid_to")])


def panel(observations: DataFrame, fields: list[str], instrument: str = "instrument_id") -> DataFrame:
    """One dense row per instrument with a column per field; a missing or non-finite field is an error."""
    picked = observations.select(instrument, *[F.element_at("fields", F.lit(f)).alias(f) for f in fields])
    return checked(picked, {f"field {f} is missing or not finite": finite(F.col(f)) for f in fields}).orderBy(instrument)


def bind(rows: DataFrame, keys: list[str], fields: list[str], into: str = "features") -> DataFrame:
    """Named entries of the ``fields`` map as one vector, in the order given; a missing or non-finite one is an error."""
    picked = rows.select(*keys, F.array(*[F.element_at("fields", F.lit(f)) for f in fields]).alias(into))
    return checked(picked, {"a bound field is missing or not finite": F.forall(into, finite)})


def is_member(wanted: DataFrame, memberships: DataFrame, at: str = "at", instrument: str = "instrument_id") -> DataFrame:
    """Those (instrument, time) that lie in an active membership: a semi-join by instrument, with the interval as its remainder."""
    spans = memberships.select(F.col(instrument).alias("__i"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    inside = (F.col("__s") <= F.col(at)) & (F.col("__e").isNull() | (F.col(at) < F.col("__e")))
    return wanted.join(spans, (F.col(instrument) == F.col("__i")) & inside, "left_semi")


def universes(expected: DataFrame, active: DataFrame, key: str, member: str) -> DataFrame:
    """Per key whether the active members are exactly the expected ones; both are reduced to sets before they meet."""
    names = lambda df, c: df.groupBy(key).agg(F.array_sort(F.collect_set(member)).alias(c))
    both = names(expected, "want").join(names(active, "have"), key, "full")
    return both.select(key, F.coalesce(F.col("have") == F.col("want"), F.lit(False)).alias("equal"))


def _precedence() -> Column:
    rank = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])[F.col("kind")]
    return F.coalesce(rank, F.raise_error(F.lit("unknown kind of event")).cast("int"))


_CANONICAL = ["available_time", "precedence", "ingest_sequence", "record_id"]


def canonical_order(events: DataFrame) -> DataFrame:
    """Sorted by availability, kind (universe, market, label), ingest sequence, id; two events in one place are an error."""
    ranked = events.withColumn("precedence", _precedence())
    empty_or_fail(duplicates(ranked, _CANONICAL), "two events in one place of the canonical order")
    return ranked.orderBy(*_CANONICAL)


def canonical_place(events: DataFrame, keys: list[str]) -> DataFrame:
    """The place of each event in the canonical order of its key, from 1."""
    order = Window.partitionBy(*keys).orderBy(*_CANONICAL)
    return events.withColumn("precedence", _precedence()).withColumn("place", F.row_number().over(order).cast("long")).drop("precedence")


def feature_places(labels: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """The index position of each label's time, which must be one of the index exactly; an unknown time is an error."""
    found = labels.join(index.select(*keys, "at", "position"), [*keys, "at"], "left")
    return checked(found, {"a label's time is not in the index": F.col("position").isNotNull()})


def append_events(book: DataFrame, fresh: DataFrame, keys: list[str], revision: str = "source_revision") -> DataFrame:
    """The book with further events; an id and revision that it has already, or that come twice, are an error."""
    empty_or_fail(duplicates(fresh, [*keys, revision]), "repeated revision")
    empty_or_fail(fresh.join(book, [*keys, revision], "left_semi"), "revision is in the book already")
    return book.unionByName(fresh)


def unchanged_prefix(before: DataFrame, after: DataFrame, upto, available: str = "available_time") -> None:
    """Fail if what was visible up to a time has changed since: late events may only become visible later."""
    old, new = visible(before, upto, available), visible(after, upto, available).select(*before.columns)
    empty_or_fail(old.exceptAll(new), "a consumed event is gone or changed")
    empty_or_fail(new.exceptAll(old), "an event was added to what had been consumed")


def duplicates(events: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return events.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def settle(predictions: DataFrame, labels: DataFrame, decisions: list) -> DataFrame:
    """When each prediction's label was settled: the first decision after the prediction that sees the label.

    predictions: target_id, predicted_at; labels: target_id, available_time, value. Unsettled ones keep nulls. A label
    already visible at the prediction is a leak (see leaks).
    """
    ordered = sorted(decisions)
    joined = predictions.join(labels, "target_id", "left")
    place = F.greatest(place_in(ordered, F.col("available_time")), place_in(ordered, F.col("predicted_at"), after=True))
    first = F.try_element_at(F.array(*[F.lit(d) for d in ordered]), place + 1)
    return joined.withColumn("settled_at", F.when(F.col("available_time").isNotNull(), first))


def leaks(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Predictions whose label could be seen when they were made."""
    return predictions.join(labels, "target_id").where("available_time <= predicted_at").select(predictions["target_id"])


def observation_rules() -> dict[str, Column]:
    return {
        "record_id is blank": filled(F.col("record_id")),
        "available before the event": F.col("available_time") >= F.col("event_time"),
        "negative revision": F.col("source_revision") >= 0,
        "empty fields": F.size("fields") > 0,
        "field not finite": F.forall(F.map_values("fields"), finite),
    }


def label_rules() -> dict[str, Column]:
    return {
        "times out of order": (F.col("event_time") <= F.col("available_time")) & (F.col("available_time") <= F.col("received_time")),
        "unknown status": F.col("status").isin("observed", "missing", "censored", "invalid"),
        "value and status disagree": (F.col("status") == "observed") == F.col("value").isNotNull(),
    }


def as_of(observations: DataFrame, labels: DataFrame, memberships: DataFrame, decision, strict: bool = True) -> dict[str, DataFrame]:
    """The whole book at one decision time: observations by record, labels by target, active memberships."""
    return {
        "observations": snapshot(observations, decision, ["record_id"], strict=strict),
        "labels": labels_at(labels, decision, strict=strict),
        "memberships": members_at(memberships, decision, strict=strict),
    }


def lookup(snap: DataFrame, key: str, value: str):
    """The one row of a snapshot with a key; an error if it isn't there."""
    rows = snap.where(F.col(key) == value).head(2)
    if len(rows) != 1:
        raise LookupError(f"{value} is not available")
    return rows[0]


def availability_position(labels: DataFrame, index: DataFrame, keys: list[str], delay: int = 0) -> DataFrame:
    """The first index position at or after each label's availability, and at least its own position plus ``delay``; null past the end.

    labels: keys, position, available_at; index: keys, position, at. Both are sorted together, so no label meets every position.
    """
    both = labels.select(*keys, F.col("available_at").alias("at"), F.struct("position", "available_at").alias("label"), F.lit(None).cast("long").alias("place")).unionByName(
        index.select(*keys, "at", F.lit(None).cast("struct<position:bigint,available_at:bigint>").alias("label"), F.col("position").alias("place"))
    )
    ahead = Window.partitionBy(*keys).orderBy("at").rangeBetween(0, Window.unboundedFollowing)
    found = both.withColumn("first", F.min("place").over(ahead)).where("label is not null")
    known = F.greatest(F.col("first"), F.col("label.position") + delay)
    return found.select(*keys, "label.position", "label.available_at", F.when(F.col("first").isNotNull(), known).alias("known_at"))
