"""Point-in-time queries on the star-schema tables, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import asof
from ..sources import feeds
from . import govern
from .inputs import BOOK, book, table

CUT = dt.datetime(2024, 1, 15)
DECISIONS = [dt.datetime(2024, 1, d) for d in (3, 8, 12, 20, 27)]
_CUT = "timestamp '2024-01-15'"
_DECISIONS = "(values " + ", ".join(f"(timestamp '{d:%Y-%m-%d}')" for d in DECISIONS) + ") as decisions(decision_time)"
Q: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


@query("asof_latest_revision", f"""with {BOOK}
select record_id, event_type, source_revision, value from (
  select *, row_number() over (partition by record_id order by source_revision desc) as r from book where available_time <= {_CUT}) where r = 1""")  # fmt: skip
def latest_revision(spark, sf):
    return asof.snapshot(book(spark, sf), F.lit(CUT), ["record_id"], strict=False).select("record_id", "event_type", "source_revision", "value")


@query("asof_many_decisions", f"""with {BOOK}
select decision_time, record_id, source_revision, value from (
  select *, row_number() over (partition by decision_time, record_id order by source_revision desc) as r
  from {_DECISIONS} join book on available_time <= decision_time) where r = 1""")  # fmt: skip
def many_decisions(spark, sf):
    return asof.snapshots(book(spark, sf), DECISIONS, ["record_id"]).select("decision_time", "record_id", "source_revision", "value")


@query("asof_validity_intervals", f"""with {BOOK},
r as (select *, max(source_revision) over (partition by record_id order by available_time, source_revision rows between unbounded preceding and 1 preceding) as before from book),
v as (select record_id, source_revision, available_time as valid_from, lead(available_time) over (partition by record_id order by available_time, source_revision) as valid_to
      from r where before is null or source_revision > before)
select * from v where valid_to is null or valid_from < valid_to""")  # fmt: skip
def validity_intervals(spark, sf):
    return asof.validity(book(spark, sf), ["record_id"]).select("record_id", "source_revision", "valid_from", "valid_to")


@query("asof_ambiguous_revisions", """with b as (select user_id as k, event_id % 40 as rev, value from events),
top as (select k, max(rev) as rev from b group by k)
select k from b join top using (k, rev) group by k having count(distinct value) > 1""")  # fmt: skip
def ambiguous_revisions(spark, sf):
    made = table(spark, sf, "events").select(F.col("user_id").alias("k"), (F.col("event_id") % 40).alias("rev"), "value")
    return asof.ambiguous(made, ["k"], "rev")


@query("universe_membership_active", """with m as (
  select o_custkey as instrument_id, min(o_orderdate) as s, case when max(o_orderkey) % 3 = 0 then null else max(o_orderdate) end as e from orders group by 1)
select instrument_id from m where s <= timestamp '1997-06-01' and (e is null or timestamp '1997-06-01' < e)""")  # fmt: skip
def membership_active(spark, sf):
    m = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("instrument_id")).agg(
        F.min("o_orderdate").alias("start"), F.when(F.max("o_orderkey") % 3 != 0, F.max("o_orderdate")).alias("end")
    )
    return m.where(asof.contains(F.lit(dt.datetime(1997, 6, 1)))).select("instrument_id")


@query("universe_membership_corrected", """with m as (
  select o_custkey as instrument_id, (min(o_orderkey) over (partition by o_custkey)) as start, o_orderkey as rev, o_orderdate as available,
         o_orderkey + 4000 as stop from orders),
l as (select *, row_number() over (partition by instrument_id, start order by rev desc) as r from m where available <= timestamp '1997-06-01')
select instrument_id, start, stop from l where r = 1 and start <= 6000 and 6000 < stop""")  # fmt: skip
def membership_corrected(spark, sf):
    per = Window.partitionBy("o_custkey")
    m = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("instrument_id"), F.min("o_orderkey").over(per).alias("start"), (F.col("o_orderkey") + 4000).alias("end"),
        F.col("o_orderkey").alias("source_revision"), F.col("o_orderdate").alias("available_time"),
    )
    seen = asof.snapshot(m, F.lit(dt.datetime(1997, 6, 1)), ["instrument_id", "start"], strict=False)
    return seen.where(asof.contains(6000)).select("instrument_id", "start", F.col("end").alias("stop"))


@query("pit_panel_coverage", f"""with {BOOK},
l as (select *, row_number() over (partition by record_id, event_type order by source_revision desc) as r from book where available_time <= {_CUT}),
w as (select record_id, max(value) filter (event_type = 'click') as click, max(value) filter (event_type = 'view') as view,
      max(value) filter (event_type = 'error') as error, count(*)::bigint as fields from l where r = 1 group by 1)
select record_id, click, view, error, fields from w where click is not null and view is not null and error is not null""")  # fmt: skip
def panel_coverage(spark, sf):
    seen = asof.snapshot(book(spark, sf), F.lit(CUT), ["record_id", "event_type"], strict=False)
    fields = seen.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("fields"))
    whole = fields.where("map_contains_key(fields, 'click') and map_contains_key(fields, 'view') and map_contains_key(fields, 'error')")
    counted = whole.select("record_id", F.size("fields").cast("long").alias("fields"))
    return asof.panel(whole, ["click", "view", "error"], "record_id").join(counted, "record_id")


@query("canonical_event_order", f"""with {BOOK},
k as (select *, case when event_type = 'signup' then 10 when event_type = 'purchase' then 30 else 20 end as precedence from book)
select record_id, ingest_sequence, row_number() over (partition by record_id order by available_time, precedence, ingest_sequence)::bigint as place from k""")  # fmt: skip
def canonical_event_order(spark, sf):
    kind = F.when(F.col("event_type") == "signup", "universe").when(F.col("event_type") == "purchase", "label").otherwise("market")
    return asof.canonical_place(book(spark, sf).withColumn("kind", kind), ["record_id"]).select("record_id", "ingest_sequence", "place")


@query("duplicate_revision_check", """select user_id, event_id % 40 as rev, count(*)::bigint as n from events group by 1, 2 having count(*) > 1""")
def duplicate_revisions(spark, sf):
    return asof.duplicates(table(spark, sf, "events").select("user_id", (F.col("event_id") % 40).alias("rev")), ["user_id", "rev"])


_LABELS = f"""{BOOK},
p as (select ingest_sequence as target_id, record_id, event_time as predicted_at from book),
n as (select ingest_sequence as target_id, lead(available_time) over o as available_time, lead(value) over o as value from book
      window o as (partition by record_id order by event_time, ingest_sequence))"""


def _labelled(spark, sf):
    b = book(spark, sf)
    order = Window.partitionBy("record_id").orderBy("event_time", "ingest_sequence")
    predictions = b.select(F.col("ingest_sequence").alias("target_id"), "record_id", F.col("event_time").alias("predicted_at"))
    labels = b.select(F.col("ingest_sequence").alias("target_id"), F.lead("available_time").over(order).alias("available_time"), F.lead("value").over(order).alias("value"))
    return predictions, labels.where("value is not null")


@query("label_settlement", f"""with {_LABELS}
select target_id, value, min(decision_time) as settled_at from p left join n using (target_id)
left join {_DECISIONS} on decision_time >= available_time and decision_time > predicted_at group by 1, 2""")  # fmt: skip
def label_settlement(spark, sf):
    predictions, labels = _labelled(spark, sf)
    return asof.settle(predictions, labels, DECISIONS).select("target_id", "value", "settled_at")


@query("pending_terminal", f"""with {_LABELS}
select record_id, count(*)::bigint as pending from p left join n using (target_id)
where available_time is null or not exists (select 1 from {_DECISIONS} where decision_time >= available_time and decision_time > predicted_at) group by 1""")  # fmt: skip
def pending_terminal(spark, sf):
    predictions, labels = _labelled(spark, sf)
    return asof.settle(predictions, labels, DECISIONS).where("settled_at is null").groupBy("record_id").agg(F.count("*").alias("pending"))


@query("leakage_check", f"""with {_LABELS} select target_id from p join n using (target_id) where available_time - to_hours((target_id % 50)::int) <= predicted_at""")
def leakage_check(spark, sf):
    """Labels moved up to two days ahead, so that some can be seen too early."""
    predictions, labels = _labelled(spark, sf)
    return asof.leaks(predictions, labels.withColumn("available_time", F.expr("available_time - make_interval(0, 0, 0, 0, cast(target_id % 50 as int))")))


@query("universe_equality_check", """with a as (select user_id, list_sort(list(distinct event_type)) as have from events where value > 60 group by 1),
b as (select user_id, list_sort(list(distinct event_type)) as want from events group by 1)
select user_id, coalesce(have = want, false) as equal from b left join a using (user_id)""")  # fmt: skip
def universe_equality(spark, sf):
    e = table(spark, sf, "events")
    return asof.universes(e, e.where("value > 60"), "user_id", "event_type")


@query("common_dates", """select o_orderdate::date as d from orders group by 1 having count(distinct o_orderpriority) = 5""")
def common_dates(spark, sf):
    dated = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("ticker"), F.to_date("o_orderdate").alias("d"))
    return feeds.common_dates(dated, 5)


@query("ledger_unsettled", """select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linestatus = 'F')""")
def ledger_unsettled(spark, sf):
    done = table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return feeds.not_in_ledger(table(spark, sf, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("feature_binding", """select event_id, [value / 100, (json_extract(props, '$.k'))::double] as features from events where value is not null and json_extract(props, '$.k') is not null""")
def feature_binding(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") / 100).alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k")).where("v is not null and k is not null")
    fields = F.map_from_arrays(F.array(F.lit("k"), F.lit("v")), F.array("k", "v"))
    return asof.bind(e.select("event_id", fields.alias("fields")), ["event_id"], ["v", "k"])


@query("phase_split", """select case when event_id < 4000 then 'train' when event_id < 8000 then 'test' else 'holdout' end as phase,
count(*)::bigint as n, min(event_id) as first_id, max(event_id) as last_id from events where event_id < 4000 or event_id between 4200 and 7999 or event_id >= 8200 group by 1""")  # fmt: skip
def phase_split(spark, sf):
    study = govern.Study({"train": (0, 4000), "test": (4200, 8000), "holdout": (8200, 1 << 40)}, embargo=200)
    study.open_holdout(study.identity, "counted by a query")
    e, each = table(spark, sf, "events"), None
    for name in study.phases:
        rows = study.phase(e, name, "event_id").select(F.lit(name).alias("phase"), "event_id")
        each = rows if each is None else each.unionByName(rows)
    return each.groupBy("phase").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


_MEMBERS = "m as (select o_custkey as instrument_id, min(o_orderdate) as start, case when max(o_orderkey) % 3 = 0 then null else max(o_orderdate) end as stop from orders group by 1)"


def _memberships(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("instrument_id")).agg(
        F.min("o_orderdate").alias("start"), F.when(F.max("o_orderkey") % 3 != 0, F.max("o_orderdate")).alias("end")
    )


@query("membership_semijoin", f"""with {_MEMBERS} select o_orderkey from orders where exists (select 1 from m where instrument_id = o_custkey
 and start <= o_orderdate + to_days(30) and (stop is null or o_orderdate + to_days(30) < stop))""")  # fmt: skip
def membership_semijoin(spark, sf):
    wanted = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("instrument_id"), F.expr("o_orderdate + interval 30 days").alias("at"))
    return asof.is_member(wanted, _memberships(spark, sf)).select("o_orderkey")


@query("book_as_of", f"""with {BOOK},
o as (select record_id, event_type, row_number() over (partition by record_id order by source_revision desc) as r from book where available_time <= {_CUT}),
l as (select 'l' || record_id || '-' || (source_revision % 2) as label_id, record_id as target_id, source_revision, ingest_sequence from book where available_time <= {_CUT}),
l1 as (select *, row_number() over (partition by label_id order by source_revision desc) as r from l), l2 as (select *, row_number() over (partition by target_id order by source_revision desc) as q from l1 where r = 1),
m as (select record_id as instrument_id, source_revision % 3 as start, case when source_revision % 2 = 0 then 2 end as stop, source_revision, row_number() over (partition by record_id, source_revision % 3 order by source_revision desc) as r from book where available_time <= {_CUT})
select 'observations' as part, count(*)::bigint as n, sum(record_id)::bigint as total from o where r = 1
union all select 'labels', count(*), sum(target_id * 10 + source_revision % 10)::bigint from l2 where q = 1
union all select 'memberships', count(*), sum(instrument_id)::bigint from m where r = 1 and start <= 1 and (stop is null or 1 < stop)""")  # fmt: skip
def book_as_of(spark, sf):
    """A whole book at one decision time: observations by record, labels by label and then target, memberships by interval and then containment."""
    b = book(spark, sf)
    cut = F.lit(CUT)
    labels = b.select(F.expr("concat('l', record_id, '-', source_revision % 2)").alias("label_id"), F.col("record_id").alias("target_id"), "source_revision", "available_time")
    spans = b.select(F.col("record_id").alias("instrument_id"), (F.col("source_revision") % 3).alias("start"), F.when(F.col("source_revision") % 2 == 0, 2).alias("end"), "source_revision", "available_time")
    parts = {
        "observations": asof.snapshot(b, cut, ["record_id"]).select(F.col("record_id").alias("x")),
        "labels": asof.labels_at(labels, cut).select((F.col("target_id") * 10 + F.col("source_revision") % 10).alias("x")),
        "memberships": asof.snapshot(spans, cut, ["instrument_id", "start"]).where(asof.contains(1)).select(F.col("instrument_id").alias("x")),
    }
    out = None
    for name, df in parts.items():
        row = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.sum("x").cast("long").alias("total"))
        out = row if out is None else out.unionByName(row)
    return out


@query("label_feature_lookup", """with i as (select user_id, event_id, (row_number() over (partition by user_id order by event_id) - 1)::bigint as position from events)
select user_id, event_id, position from i where event_id % 3 = 0""")  # fmt: skip
def label_feature_lookup(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("at"))
    index = e.withColumn("position", (F.row_number().over(Window.partitionBy("user_id").orderBy("at")) - 1).cast("long"))
    return asof.feature_places(e.where("at % 3 = 0"), index, ["user_id"]).select("user_id", F.col("at").alias("event_id"), "position")


@query("appended_book", f"""with {BOOK}, a as (select record_id, source_revision, value from book union all select record_id, source_revision + 100000, value + 1 from book where source_revision % 4 = 0)
select record_id, count(*)::bigint as revisions, max(source_revision) as latest from a group by 1""")  # fmt: skip
def appended_book(spark, sf):
    b = book(spark, sf).select("record_id", "source_revision", "value")
    more = b.where("source_revision % 4 = 0").select("record_id", (F.col("source_revision") + 100000).alias("source_revision"), (F.col("value") + 1).alias("value"))
    return asof.append_events(b, more, ["record_id"]).groupBy("record_id").agg(F.count("*").alias("revisions"), F.max("source_revision").alias("latest"))


@query("availability_position", f"""with {BOOK}, i as (select record_id, epoch_us(event_time) as at, (row_number() over (partition by record_id order by event_time, ingest_sequence) - 1)::bigint as position from book),
l as (select record_id, (row_number() over (partition by record_id order by event_time, ingest_sequence) - 1)::bigint as position, epoch_us(available_time) as available_at from book),
f as (select l.record_id, l.position, l.available_at, min(i.position) as first from l left join i on i.record_id = l.record_id and i.at >= l.available_at group by all)
select record_id, position, available_at, case when first is not null then greatest(first, position + 1) end as known_at from f""")  # fmt: skip
def availability_position(spark, sf):
    order = Window.partitionBy("record_id").orderBy("event_time", "ingest_sequence")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    b = book(spark, sf).withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    index = b.select("record_id", "position", micros("event_time").alias("at"))
    labels = b.select("record_id", "position", micros("available_time").alias("available_at"))
    return asof.availability_position(labels, index, ["record_id"], 1)
