"""Queries of gates, evidence, calibration and replay, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import steps
from ..operators import calibration, evidence, learning, metrics
from ..operators.folds import fold
from ..operators.windows import cusum
from .inputs import BETS, MADE, PATH, RATE, bets, path, table
from .queries_learning import _L, _regression
from .queries_path import rounded
from .replay import chain, replay, validate_chain

Q: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


_EPOCHS = f"""with {BETS}, b as (select gate, challenger, t, score, t // 2000 as epoch from bets),
slots as (select gate, challenger, row_number() over (partition by gate order by min(t)) as slot from b group by 1, 2), family as (select gate, count(*) as n from slots group by 1),
w as (select b.*, 0.2 * pow(2.0, -slot) * pow(2.0, -(epoch + 1)) as share, product(1 + 0.5 * score) over (partition by gate, epoch, challenger order by t) as wealth from b join slots using (gate, challenger)),
c as (select gate, epoch, min(t) as hit, min_by(challenger, t) as who from w where wealth >= 1 / share group by 1, 2)"""


@query("gate_lifecycle", f"""{_EPOCHS}, j as (select w.*, hit, who, coalesce(max_by(wealth, t) filter (hit is null or t <= hit) over (partition by gate, epoch, challenger), 1) as frozen from w left join c using (gate, epoch))
select j.gate, t, j.epoch::bigint as epoch, round(case when hit is null or t <= hit then wealth else frozen end, 6) as wealth, case when t >= hit then who::varchar end as promoted, coalesce(t <= hit, true) as taken,
 coalesce((select max_by(p.who, p.epoch)::varchar from c p where p.gate = j.gate and p.epoch < j.epoch), 'incumbent') as incumbent,
 round(0.2 * (1 - pow(2.0, -n)) * (1 - pow(2.0, -(j.epoch + 1))), 6) as spent from j join family using (gate)""")  # fmt: skip
def gate_lifecycle(spark, sf):
    """Registration in order of appearance, a seal, observations, and a new epoch after every 2,000 events."""
    b = bets(spark, sf).select("gate", F.col("challenger").cast("string").alias("challenger"), "t", "score")
    at = F.col("at").cast("double").alias("at")
    first = b.groupBy("gate", "challenger").agg(F.min("t").alias("t")).select("gate", "challenger", (F.col("t") / 1e12 - 2).alias("at"), F.lit("register").alias("event"))
    last = b.groupBy("gate").agg(F.max("t").alias("t"))
    seal = last.select("gate", F.lit(-1.0).alias("at"), F.lit("seal").alias("event"))
    resets = last.where("t >= 2000").select("gate", F.explode(F.sequence(F.lit(1), F.expr("int(t div 2000)"))).alias("k")).select("gate", (F.col("k") * 2000 - 0.5).alias("at"), F.lit("reset_epoch").alias("event"))
    seen = b.withColumn("at", F.col("t")).select("gate", "challenger", at, F.lit("observe").alias("event"), "score")
    rows = seen.unionByName(first.select("gate", "challenger", at, "event"), True).unionByName(seal.select("gate", at, "event"), True).unionByName(resets.select("gate", at, "event"), True)
    made = fold(rows, ["gate"], "at", steps.GateLifecycle(0.2, 0.5, skip=True)).where("at >= 0 and at = floor(at)")
    return made.select("gate", F.col("at").cast("long").alias("t"), "epoch", F.round("wealth", 6).alias("wealth"), "promoted", "taken", "incumbent", F.round("spent", 6).alias("spent"))


@query("would_cross", f"""with {BETS}, w as (select *, coalesce(product(1 + 0.5 * score) over (partition by gate, challenger order by t rows between unbounded preceding and 1 preceding), 1) as before from bets)
select gate, challenger, t, before * (1 + 0.5 * score) >= 20 as crosses from w""")  # fmt: skip
def would_cross(spark, sf):
    b = bets(spark, sf)
    after = evidence.wealth(b, ["gate", "challenger"], "t", "score", F.lit(0.5))
    order = Window.partitionBy("gate", "challenger").orderBy("t")
    before = F.coalesce(F.lag("wealth").over(order), F.lit(1.0))
    return after.withColumn("before", before).select("gate", "challenger", "t", evidence.would_cross(F.col("before"), F.col("score"), 0.5, evidence.threshold(0.05)).alias("crosses"))


@query("paired_evidence", f"""with {PATH}, p as (select series, t, series || '-' || t as prediction_id, prediction as c, 0.0::double as i, label, t + 3 + t % 2 as av, case when t % 17 = 0 then 'missing' else 'observed' end as status, max(t) over () - 40 as now from path),
s as (select *, av <= now and t % 23 <> 0 as there from p where t <= now),
e as (select *, case when there then status when t + 30 <= now then 'expired' end as state, case when there then av when t + 30 <= now then t + 30 end as at_ from s),
o as (select *, max((state is null)::int) over u = 1 as held, max(at_) over u as settled, coalesce(sum((state = 'observed')::int) over (partition by series order by t rows between unbounded preceding and 1 preceding), 0) as earlier,
 greatest(-0.01, least(0.01, -least(abs(c - label), 0.01) + least(abs(i - label), 0.01))) / 0.01 as gap from e window u as (partition by series order by t)),
x as (select *, case when not held and state = 'observed' and earlier >= 20 then gap end as score, (row_number() over (partition by series order by t) - 1)::bigint as place from o),
w as (select *, product(1 + 0.5 * coalesce(score, 0)) over (partition by series order by t) as wealth from x),
k as (select *, min(case when score is not null and wealth >= 4 then place end) over (partition by series) as crossing from w)
select series, prediction_id, case when place > crossing then 'closed' when held then 'pending' when state <> 'observed' then state when score is null then 'burn_in' else 'settled' end as status,
 case when not held and coalesce(place <= crossing, true) then settled end as settled_at, place, case when not held and coalesce(place <= crossing, true) then round(wealth, 6) end as wealth, case when place = crossing then settled + 1 end as effective_at from k""")  # fmt: skip
def paired_evidence(spark, sf):
    p = path(spark, sf).withColumn("prediction_id", F.concat_ws("-", "series", "t"))
    now = p.agg(F.max("t")).first()[0] - 40
    predictions = p.select("series", "prediction_id", "t", F.col("prediction").alias("challenger"), F.lit(0.0).alias("incumbent"))
    labels = p.where("t % 23 <> 0").select("prediction_id", (F.col("t") + 3 + F.col("t") % 2).alias("available_time"), F.when(F.col("t") % 17 == 0, "missing").otherwise("observed").alias("status"), F.col("label").alias("value"))
    made = evidence.paired_ledger(predictions, labels, ["series"], "t", now, 0.25, 0.5, cap=0.01, burn_in=20, expiry=30)
    return made.select("series", "prediction_id", "status", "settled_at", "place", F.round("wealth", 6).alias("wealth"), "effective_at")


_UNI = "(('0x' || substr(md5(concat_ws('|', {0})), 1, 8))::bigint::double / 4294967296.0)"
_SIGNS = "n{0} as (select trial, t, case when " + _UNI.format("'{0}', trial, t") + " < 0.5 then -1.0::double else 1.0::double end as score from (select unnest(generate_series(0, 399)) as trial), (select unnest(generate_series(1, 100)) as t))"
_CUSUMS = "s{0} as (select trial, t, sum(abs(score + {2}) - 1.2) over (partition by trial order by t) as s from n{1}), g{0} as (select trial, t, s - least(0, min(s) over (partition by trial order by t)) as g from s{0})"
_WILSON = "((x/m + 1.959963984540054^2/(2*m)) / (1 + 1.959963984540054^2/m) {0} 1.959963984540054 * sqrt(x/m*(1-x/m)/m + 1.959963984540054^2/(4*m*m)) / (1 + 1.959963984540054^2/m))"
LEVELS = [1.05, 2.05, 3.05, 4.05, 5.05, 6.05]


def _scores(spark, seed, shift="0.3"):
    return cusum(calibration.sign_paths(spark, 400, 100, seed).withColumn("x", F.expr(f"abs(score + {shift})")), "trial", "t", "x", 1.2, 1e9)


@query("smallest_threshold", f"""with {_SIGNS.format('cal')}, {_SIGNS.format('ev')}, {_CUSUMS.format('cal', 'cal', '0.3')}, {_CUSUMS.format('ev', 'ev', '0.3')}, l as (select unnest({LEVELS}) as threshold),
pc as (select trial, max(g) as peak from gcal group by 1), pe as (select trial, max(g) as peak from gev group by 1),
c as (select threshold, count(*) filter (peak >= threshold)::double as x, count(*)::double as m from pc, l group by 1), e as (select threshold, count(*) filter (peak >= threshold)::double as x, count(*)::double as m from pe, l group by 1),
f as (select min(threshold) as threshold from c where {_WILSON.format('+')} <= 0.2)
select threshold::double as threshold, (select x from c where c.threshold = f.threshold)::bigint as calibration_alarms, x::bigint as evaluation_alarms, round({_WILSON.format('+')}, 9) as evaluation_high, {_WILSON.format('+')} <= 0.2 as approved from f join e using (threshold)""")  # fmt: skip
def smallest_threshold(spark, sf):
    made = calibration.choose_threshold(_scores(spark, "cal"), _scores(spark, "ev"), LEVELS, 0.2)
    return made.select("threshold", "calibration_alarms", "evaluation_alarms", F.round("evaluation_high", 9).alias("evaluation_high"), "approved")


@query("shift_power", f"""with {_SIGNS.format('pow')}, {_CUSUMS.format('pow', 'pow', '(case when t > 60 then 0.8 else 0.3 end)')},
d as (select trial, coalesce(min(t - 61) filter (t > 60 and g >= 3.05), 40) as delay from gpow group by 1), a as (select count(*)::double as m, (count(*) filter (delay < 40))::double as x, avg(delay) as mean_delay from d)
select m::bigint as trials, x::bigint as detections, round(x / m, 9) as rate, round(mean_delay, 6) as mean_delay, round(1 - x / m, 9) as censored from a""")  # fmt: skip
def shift_power(spark, sf):
    made = calibration.shift_power(_scores(spark, "pow", "case when t > 60 then 0.8 else 0.3 end"), 3.05, 100, 60)
    return made.select("trials", "detections", F.round("rate", 9).alias("rate"), F.round("mean_delay", 6).alias("mean_delay"), F.round("censored", 9).alias("censored"))


_CELLS = "n as (select trial, t, cell, case when " + _UNI.format("'fam', trial, t, cell") + " < 0.5 then -1.0::double else 1.0::double end as score from (select unnest(generate_series(0, 199)) as trial), (select unnest(generate_series(1, 60)) as t), (select unnest(generate_series(0, 3)) as cell)), w as (select *, product(1 + 0.5 * score) over (partition by trial, cell order by t) as w from n)"


def _family(spark):
    grid = spark.range(200).select(F.col("id").alias("trial"), F.explode(F.sequence(F.lit(1), F.lit(60))).alias("t")).select("trial", "t", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cell"))
    return grid.withColumn("score", F.when(calibration.uniform(F.lit("fam"), "trial", "t", "cell") < 0.5, -1.0).otherwise(1.0))


@query("selection_null", f"""with {_CELLS}, f as (select trial, max((w >= 4 / 0.4)::int) as hit from w group by 1), a as (select count(*)::double as m, sum(hit)::double as x from f)
select m::bigint as trials, x::bigint as crossings, round(x / m, 9) as rate, round({_WILSON.format('+')}, 9) as high from a""")  # fmt: skip
def selection_null(spark, sf):
    made = calibration.selection_null(_family(spark), 0.4, 4, 0.5)
    return made.select("trials", "crossings", F.round("rate", 9).alias("rate"), F.round("high", 9).alias("high"))


@query("promotion_null", f"""with {_CELLS}, f as (select trial, max((w >= 1 / (0.6 * pow(2.0, -(cell + 1)) * 0.5))::int) as hit from w group by 1), a as (select count(*)::double as m, sum(hit)::double as x from f)
select m::bigint as trials, x::bigint as crossings, round(x / m, 9) as rate, round({_WILSON.format('+')}, 9) as high from a""")  # fmt: skip
def promotion_null(spark, sf):
    made = calibration.promotion_null(_family(spark), 0.6, 0.5)
    return made.select("trials", "crossings", F.round("rate", 9).alias("rate"), F.round("high", 9).alias("high"))


@query("detector_null", f"""with {_SIGNS.format('null-1')}, {_CUSUMS.format('1', 'null-1', '0.3')}""".replace("nnull-1", "n1").replace("from n1)", "from n1)") + f""",
f as (select trial, min(t) filter (g >= 3.05) as first from g1 group by 1), a as (select count(*)::double as m, count(first)::double as x, avg(coalesce(first, 100)) as mean_run from f)
select m::bigint as trials, x::bigint as alarms, round(mean_run, 6) as mean_run, round({_WILSON.format('-')}, 9) as low, round({_WILSON.format('+')}, 9) as high from a""")  # fmt: skip
def detector_null(spark, sf):
    paths = calibration.sign_paths(spark, 400, 100, "null-1").withColumn("x", F.abs(F.col("score") + 0.3))
    made = calibration.detector_null(paths, steps.Cusum(1.2, 3.05), 100)
    return made.select("trials", "alarms", F.round("mean_run", 6).alias("mean_run"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("block_bootstrap", f"""with g as (select draw, k from (select unnest(generate_series(0, 49)) as draw), (select unnest(generate_series(0, 119)) as k)),
f as (select draw, k, k = 0 or {_UNI.format("'boot', 'restart', draw, k")} < 0.125 as fresh, floor({_UNI.format("'boot', 'start', draw, k")} * 365)::bigint as s from g),
r as (select *, sum(fresh::int) over (partition by draw order by k) as run from f), b as (select *, first_value(k) over (partition by draw, run order by k) as at_, first_value(s) over (partition by draw, run order by k) as from_ from r)
select draw::bigint as draw, k::int as k, ((from_ + k - at_) % 365)::bigint as place from b""")  # fmt: skip
def block_bootstrap(spark, sf):
    return calibration.bootstrap_places(spark, 50, 365, 120, 8.0, "boot").withColumn("place", F.col("place").cast("long"))


@query("rls_two_targets", f"""with {PATH}, r as (select series, t, prediction * 20 as x, ret * 20 as y, ret * 10 + 0.1 as z from path),
s as (select *, sum(x * y * pow({_L}, -t)) over o as sxy, sum(x * z * pow({_L}, -t)) over o as sxz, sum(x * x * pow({_L}, -t)) over o as sxx from r window o as (partition by series order by t))
select series, t, round(sxy / (0.7 + sxx), 6) as theta_y, round(sxz / (0.7 + sxx), 6) as theta_z from s""")  # fmt: skip
def rls_two_targets(spark, sf):
    rows = _regression(spark, sf).withColumn("targets", F.array("target", F.col("target") / 2 + 0.1))
    made = fold(rows, ["series"], "t", steps.MultiRls(1, 2, 0.7, _L))
    return made.select("series", "t", F.round(F.col("theta")[0], 6).alias("theta_y"), F.round(F.col("theta")[1], 6).alias("theta_z"))


@query("ledger_chain", """with recursive o as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as k from events),
h as (select user_id, event_id, k, sha256('genesis|' || event_id || '|' || event_type) as digest from o where k = 1
 union all select o.user_id, o.event_id, o.k, sha256(h.digest || '|' || o.event_id || '|' || o.event_type) from h join o on o.user_id = h.user_id and o.k = h.k + 1)
select user_id, event_id, k::bigint as place, digest from h""")  # fmt: skip
def ledger_chain(spark, sf):
    records = table(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", "event_id", "event_type").alias("payload"))
    return chain(records, ["user_id"], "event_id", "payload").select("user_id", "event_id", "place", "digest")


@query("ledger_chain_breaks", """select user_id, event_id from events where event_id % 101 = 7""")
def ledger_chain_breaks(spark, sf):
    """Records changed after they were chained are found, each by itself."""
    records = table(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", "event_id", "event_type").alias("payload"))
    ledger = chain(records, ["user_id"], "event_id", "payload").withColumn("payload", F.when(F.col("event_id") % 101 == 7, "other").otherwise(F.col("payload")))
    return validate_chain(ledger, ["user_id"], "payload").select("user_id", "event_id")


@query("replay_revisions", f"""with {PATH}, p as (select series, t, series || '-' || t as target_id, prediction, label from path), m as (select series, max(t) as last from path group by 1)
select series, target_id, case when t + 3 <= last then t + 3 end as settled_at,
 case when t + 3 <= last then round(-abs(prediction - case when t % 2 = 0 then label else label * 2 end), 9) + 0 end as score from p join m using (series)""")  # fmt: skip
def replay_revisions(spark, sf):
    """Labels with a revision that arrives at once (even rows) or only after they are settled."""
    p = path(spark, sf).withColumn("target_id", F.concat_ws("-", "series", "t"))
    both = F.array(F.struct(F.lit(0).alias("source_revision"), (F.col("label") * 2).alias("value"), (F.col("t") + 3).alias("available_time")), F.struct(F.lit(1).alias("source_revision"), F.col("label").alias("value"), (F.col("t") + 3 + 4 * (F.col("t") % 2)).alias("available_time")))
    labels = p.select("target_id", F.explode(both).alias("v")).select("target_id", "v.*")
    predictions = p.select("series", "target_id", F.col("t").alias("predicted_at"), "prediction")
    made = replay(predictions, labels, p.select("series", F.col("t").alias("decision_time")), ["series"], "source_revision")
    return made.select("series", "target_id", "settled_at", (F.round("score", 9) + 0.0).alias("score"))


@query("walk_forward_audit", f"""with {PATH}, c as (select series, t, 60 + ((t - 61) // 25) * 25 as fitted from path where t > 60),
k as (select c.series, c.t, c.fitted, count(*)::int as trained_rows, min(q.t) as first_row, max(q.t) as last_row, avg(q.label) as m from c join path q on q.series = c.series and q.t <= fitted - 2 and q.t > fitted - 42 group by 1, 2, 3)
select series, t, trained_rows, (t - 61) % 25 = 0 as trained, first_row, last_row, round(greatest(-1, least(1, m * 300)), 6) + 0 as position from k""")  # fmt: skip
def walk_forward_audit(spark, sf):
    rows = path(spark, sf).select("series", "t", F.array("prediction").alias("features"), "label")
    made = learning.walk_forward(rows, "series", "t", 60, 25, 40, 2, lambda x, y: y.mean(), lambda m, x: m, action=lambda p, y: p * 300, audit=True)
    return made.select("series", "t", "trained_rows", "trained", F.array_min("training").alias("first_row"), F.array_max("training").alias("last_row"), (F.round("position", 6) + 0.0).alias("position"))


@query("walk_forward_baseline", f"""with {MADE}, b as (select series, t, case when t > 20 then 0.25 * (((t - 1) % 3) - 1) else 0 end as position, evaluated, ret from path),
bm as (select *, case when evaluated then abs(position - coalesce(lag(position) over (partition by series, evaluated order by t), 0)) else 0 end as change from b),
bn as (select *, case when evaluated then position * ret else 0 end - change * {RATE} as net from bm),
j as (select made.series, made.t, made.net as c, bn.net as b, row_number() over (partition by made.series order by made.t) as nth from made join bn using (series, t) where made.evaluated),
s as (select series, sum(c) as cr, sum(b) as br, coalesce(sum(c) filter (nth <= 100), 0) as ec, coalesce(sum(b) filter (nth <= 100), 0) as eb, coalesce(sum(c) filter (nth > 100), 0) as lc, coalesce(sum(b) filter (nth > 100), 0) as lb, count(*) filter (nth > 100) as later from j group by 1)
select series, round(cr, 6) as candidate_return, round(br, 6) as baseline_return, round(ec, 6) as early_candidate, round(lb, 6) as later_baseline, cr > br as promoted, cr > br and later > 0 and lc < lb as false_promotion from s""")  # fmt: skip
def walk_forward_baseline(spark, sf):
    """A baseline from a hook, an early stretch of 100 rows, and a promotion rule of one's own."""
    p = path(spark, sf)
    hooked = learning.baseline_path(p.select("series", "t", F.array("prediction").alias("features")), "series", "t", 20, lambda t, x: 0.25 * (t % 3 - 1))
    base = metrics.with_path(p.drop("position", "evaluated").join(hooked, ["series", "t"]), "series", "t", RATE)
    rule = F.col("candidate_return") > F.col("baseline_return")
    made = metrics.against_baseline(metrics.with_path(p, "series", "t", RATE), base, "series", "t", window=100, rule=rule)
    return rounded(made.select("series", "candidate_return", "baseline_return", "early_candidate", "later_baseline", "promoted", "false_promotion"), "candidate_return", "baseline_return", "early_candidate", "later_baseline")


@query("hooked_replay", f"""with {PATH}, p as (select series, t, label, avg(label) over (partition by series order by t rows between unbounded preceding and 3 preceding) as m, lead(t, 3) over (partition by series order by t) as later from path)
select series, t, round(m, 9) + 0 as prediction, coalesce(lag(t, 3) over (partition by series order by t) is not null, false) as settles,
 round(lag(-abs(m - label), 3) over (partition by series order by t), 9) + 0 as score from p""")  # fmt: skip
def hooked_replay(spark, sf):
    """A model that learns the mean of the labels that have arrived, asked and told through hooks."""
    p = path(spark, sf).withColumn("target_id", F.format_string("%06d", "t"))
    decisions = p.select("series", (F.col("t") + 0.5).alias("at"), F.lit("decision").alias("kind"), "target_id", F.array("prediction").alias("features"), F.lit(None).cast("double").alias("value"))
    labels = p.select("series", (F.col("t") + 3.25).alias("at"), F.lit("label").alias("kind"), "target_id", F.lit(None).cast("array<double>").alias("features"), F.col("label").alias("value"))
    made = fold(decisions.unionByName(labels), ["series"], "at", steps.CausalReplay(steps.MeanLabel)).where("status <> 'label'")
    score = F.try_element_at("scores", F.lit(1))
    return made.select("series", F.floor("at").alias("t"), (F.round("prediction", 9) + 0.0).alias("prediction"), (F.size("settled") > 0).alias("settles"), (F.round(score, 9) + 0.0).alias("score"))


@query("study_decisions", f"""with {PATH}, r as (select series, t, prediction * 20 as x, ret * 20 as y from path),
s as (select *, sum(x * y * pow({_L}, -t)) over o as sxy, sum(x * x * pow({_L}, -t)) over o as sxx from r window o as (partition by series order by t)),
q as (select series, t, x * coalesce(lag(sxy / (0.7 + sxx), 3) over (partition by series order by t), 0) as p from s)
select series, series || '|' || t as decision_id, t as decision_time, t >= 6 as evaluated, case when t >= 6 then round(greatest(-1, least(1, p)), 6) + 0 else 0 end as position, case when t < 6 then 'before the start' end as reason from q""")  # fmt: skip
def study_decisions(spark, sf):
    from .study import economic_decisions

    rows = _regression(spark, sf).withColumns({"step": F.col("t"), "available_step": F.col("t") + 3})
    run = fold(rows, ["series"], "t", steps.RecursiveRun(1, ridge=0.7, neutral=_L)).withColumn("target", F.col("t"))
    made = economic_decisions(run, ["series"], "t", "target", 6)
    return made.select("series", "decision_id", "decision_time", "evaluated", (F.round("position", 6) + 0.0).alias("position"), "reason")


@query("rolling_ridge_intercept", f"""with {PATH}, r as (select series, t, prediction * 20 as x, ret * 20 + 0.05 as y from path),
m as (select series, t, sum(x * x) over w + 0.5 as a, sum(x) over w as b, count(*) over w + 0.5 as d, sum(x * y) over w as u, sum(y) over w as v, count(*) over w as n from r window w as (partition by series order by t rows between 32 preceding and 1 preceding))
select series, t, case when n > 0 then round((d * u - b * v) / (a * d - b * b), 6) + 0 end as slope, case when n > 0 then round((a * v - b * u) / (a * d - b * b), 6) + 0 end as intercept from m""")  # fmt: skip
def rolling_ridge_intercept(spark, sf):
    rows = path(spark, sf).select("series", "t", F.array(F.col("prediction") * 20).alias("features"), (F.col("ret") * 20 + 0.05).alias("y"))
    made = learning.rolling_ridge_fit(rows, "series", "t", "features", "y", 1, 32, 0.5)
    return made.select("series", "t", (F.round(F.col("coefficients")[0], 6) + 0.0).alias("slope"), (F.round(F.col("coefficients")[1], 6) + 0.0).alias("intercept"))
