"""Queries of strategies, path metrics and scalar maps, each with its SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..operators import evidence, metrics, strategies, windows
from ..sources import feeds
from .inputs import DAILY, MADE, PATH, RATE, daily, path, table
from .queries_path import rounded

Q: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


#: Prices of all series on the rows that each of them has, counted from 0.
_PANEL = f"{DAILY}, panel as (select series, t - 1 as t, price, (count(*) over (partition by t)) as k from daily), full_panel as (select series, t, price from panel where k = 5)"


def _panel(spark, sf):
    d = daily(spark, sf).select("series", (F.col("t") - 1).alias("t"), "price")
    return d.join(feeds.common_dates(d, 5, "series", "t"), "t")


@query("momentum_portfolio", f"""with {_PANEL}, r as (select *, price / lag(price) over o - 1 as ret, lag(price, 2) over o / lag(price, 20) over o - 1 as mom, lead(t) over o is null as last from full_panel window o as (partition by series order by t)),
v as (select *, stddev_samp(ret) over (partition by series order by t rows between 9 preceding and current row) as vol, t >= 20 and (t - 20) % 7 = 0 and not last as fresh from r),
p as (select *, row_number() over (partition by t order by case when fresh and mom > 0.01 then mom end desc nulls last, series) as place from v),
i as (select *, case when fresh and mom > 0.01 and place <= 2 then 1 / greatest(vol * sqrt(252), 1e-6) end as inv from p), s as (select *, inv / sum(inv) over (partition by t) as share from i),
k as (select *, sqrt(sum(pow(share * vol, 2)) over (partition by t)) * sqrt(252) as risk from s), f as (select *, case when fresh then coalesce(share * least(1, 0.9 / greatest(risk, 1e-8)), 0) end as w from k)
select series, t, round(case when last then 0 else coalesce(last_value(w ignore nulls) over (partition by series order by t), 0) end, 6) as weight from f""")  # fmt: skip
def momentum_portfolio(spark, sf):
    made = strategies.momentum_portfolio(_panel(spark, sf), 2, 20, 2, 10, 0.9, 7, 0.01)
    return rounded(made, "weight")


@query("trend_cost_grid", f"""with {DAILY}, m as (select *, avg(price) over w as mean, count(price) over w as n, lead(price) over (partition by series order by t) / price - 1 as realised from daily window w as (partition by series order by t rows between 30 preceding and 1 preceding)),
p as (select *, case when n = 30 and price > mean then 1.0 else 0.0 end as position from m), c as (select *, abs(position - coalesce(lag(position) over (partition by series order by t), 0)) as moved from p),
g as (select series, t, bps, position * realised - bps / 1e4 * moved as net from c, (select unnest([5.0, 15.0, 25.0]) as bps) where realised is not null)
select series, bps::double as bps, count(*)::bigint as n, round(sum(net), 6) as total, round(avg(net) / stddev_samp(net) * sqrt(252), 6) as sharpe, round(sum(net) filter (t > 100), 6) as holdout from g group by 1, 2""")  # fmt: skip
def trend_cost_grid(spark, sf):
    made = strategies.fixed_trend(daily(spark, sf), 30, [5.0, 15.0, 25.0])
    return made.groupBy("series", "bps").agg(
        F.count("*").alias("n"), F.round(F.sum("net"), 6).alias("total"), F.round(metrics.sharpe(F.col("net"), 252, 1e-15), 6).alias("sharpe"),
        F.round(F.sum(F.when(F.col("t") > 100, F.col("net"))), 6).alias("holdout"),
    )


_TODAY = dt.date(1998, 8, 3)


@query("guarded_signal", f"""with {DAILY}, k as (select *, row_number() over (partition by series order by d desc) as k from daily), h as (select * from k where k <= 101),
s as (select series, max(d) as signal_date, max(price) filter (k = 1) as last_price, avg(price) filter (k > 1) as mean_before, count(*) as n, date_diff('day', max(d), date '{_TODAY}')::int as age from h group by 1),
r as (select *, case when age > 2 then 'stale' when n <= 100 then 'too short' end as reason from s)
select series, signal_date, age, case when reason is null then last_price > mean_before end as risk_on, reason from r""")  # fmt: skip
def guarded_signal(spark, sf):
    return strategies.guarded_signal(daily(spark, sf), 100, _TODAY, 2, strict=False)


@query("signal_settlement", f"""with {DAILY}, n as (select series, d, t, lead(d) over o as realised_on, lead(price) over o / price - 1 as gross from daily window o as (partition by series order by d))
select series, d, realised_on, round(gross, 9) as gross, round(gross - 0.0005, 9) as net from n where t % 10 = 0 and t % 20 <> 0 and gross is not null""")  # fmt: skip
def signal_settlement(spark, sf):
    d = daily(spark, sf)
    made = strategies.settle_signals(d.where("t % 10 = 0").select("series", "d"), d.where("t % 20 = 0").select("series", "d"), d)
    return rounded(made, "gross", "net", n=9)


_DIFF = "select user_id, event_id, value - lag(value, 1, value) over (partition by user_id order by event_id) as x from events"


@query("price_difference", f"select user_id, event_id, round(x, 6) + 0 as x from ({_DIFF})")
def price_difference(spark, sf):
    made = table(spark, sf, "events").select("user_id", "event_id", windows.difference(F.col("value"), windows.along("user_id", "event_id")).alias("x"))
    return made.withColumn("x", F.round("x", 6) + 0.0)


_ONLINE = f"""{PATH}, c as (select *, abs(position - coalesce(lag(position) over (partition by series order by t), 0)) as change, abs(position) >= 0.9 as alarm, regime <> lag(regime) over (partition by series order by t) as shift from path),
cps as (select series, t as cp, lead(t) over (partition by series order by t) as stop from c where shift), ends as (select series, max(t) + 1 as stop from c group by 1),
d as (select cps.series, cp, coalesce(cps.stop, ends.stop) as stop, (select min(t) from c where c.series = cps.series and alarm and t >= cp) as hit from cps join ends on ends.series = cps.series)"""


@query("online_detection", f"""with {_ONLINE}, m as (select series, avg(least(coalesce(hit - cp, stop - cp), stop - cp)) as mean_detection_delay, min(cp) as first from d group by 1),
f as (select c.series, count(*) filter (alarm and t < first)::bigint as false_alarm_count, round(avg(position * ret - change * {RATE}), 9) as mean_net_return from c join m using (series) group by 1)
select series, round(mean_detection_delay, 6) as mean_detection_delay, false_alarm_count, mean_net_return from m join f using (series)""")  # fmt: skip
def online_detection(spark, sf):
    p = path(spark, sf).withColumn("alarm", F.abs("position") >= 0.9)
    made = metrics.online_bundle(p, "series", "t", RATE, alarm="alarm").where("mean_detection_delay is not null")
    return made.select("series", F.round("mean_detection_delay", 6).alias("mean_detection_delay"), "false_alarm_count", F.round("mean_net_return", 9).alias("mean_net_return"))


@query("tail_metrics", f"""with {MADE}, b as (select *, row_number() over (partition by series order by t desc) as back from made where evaluated)
select series, count(*)::bigint as n, round(sum(net), 6) as net_return, round(avg(net) / stddev_samp(net) * sqrt(252), 6) as sharpe, round(exp(sum(ln(1 + net)) * 252.0 / count(*)) - 1, 6) as annualised from b where back <= 60 group by 1""")  # fmt: skip
def tail_metrics(spark, sf):
    made = metrics.tail(metrics.with_path(path(spark, sf), "series", "t", RATE).where("evaluated"), "series", "t", 60)
    return made.groupBy("series").agg(
        F.count("*").alias("n"), F.round(F.sum("net"), 6).alias("net_return"), F.round(metrics.sharpe(F.col("net"), 252, 1e-15), 6).alias("sharpe"),
        F.round(metrics.annualised(F.col("net")), 6).alias("annualised"),
    )


_REGRET = f"""{MADE}, ex as (select *, ret / 2 + 0.0001 as expected from made), ob as (select *, case when evaluated then abs(optimal - coalesce(lag(optimal) over (partition by series, evaluated order by t), 0)) else 0 end * {RATE} as best_cost from ex),
u as (select *, case when evaluated then position * expected - cost else 0 end as own, case when evaluated then optimal * expected - best_cost else 0 end as best, case when evaluated then optimal * expected else 0 end as best_gross from ob)"""


@query("expected_regret", f"""with {_REGRET} select series, round(sum(best_gross - net), 6) as legacy_gap, round(sum(abs(best - own)), 6) as absolute_discrepancy, round(sum(greatest(best - own, 0)), 6) as one_sided_regret from u group by 1""")
def expected_regret(spark, sf):
    made = metrics.comparator(path(spark, sf).withColumn("expected", F.col("ret") / 2 + 0.0001), "series", "t", RATE, expected="expected")
    return rounded(made, "legacy_gap", "absolute_discrepancy", "one_sided_regret")


@query("full_metric_bundle", f"""with {MADE}, k as (select *, max(equity) over (partition by series order by t rows between unbounded preceding and 1 preceding) as before, regime <> lag(regime) over (partition by series order by t) as shift,
  sum((evaluated and position * optimal > 0)::int) over (partition by series order by t rows between current row and 2 following) as run from made),
cps as (select series, t as cp from k where shift), b as (select series, t, evaluated, case when evaluated then 0.5 * ret - case when nth = 1 then 0.5 else 0 end * {RATE} else 0 end as net from (select *, row_number() over (partition by series, evaluated order by t) as nth from path)),
e as (select k.series, k.t, k.net as c, b.net as b, row_number() over (partition by k.series order by k.t) as nth, count(*) over (partition by k.series) as n from k join b using (series, t) where k.evaluated),
f as (select series, (sum(c) filter (nth <= n // 2) > sum(b) filter (nth <= n // 2) and sum(c) filter (nth > n // 2) < sum(b) filter (nth > n // 2))::int::bigint as false_promotions from e group by 1),
dd as (select series, cp, (select min(t) from k where k.series = cps.series and run = 3 and t >= cp) - cp as delay, (select min(t) from k where k.series = cps.series and equity >= before and t >= cp) - cp as back from cps),
l as (select series, list(delay order by cp) as detection_delays, list(back order by cp) as recovery_delays from dd group by 1),
o as (select *, case when evaluated then optimal * ret - abs(optimal - coalesce(lag(optimal) over (partition by series, evaluated order by t), 0)) * {RATE} else 0 end as best from made),
r as (select series, count(*) filter (evaluated)::bigint as n_predictions, round(sum(greatest(best - net, 0)), 6) as one_sided_regret, round(sum(greatest(best - net, 0)) / count(*) filter (evaluated), 9) as mean_step_one_sided_regret from o group by 1)
select series, n_predictions, one_sided_regret, mean_step_one_sided_regret, coalesce(detection_delays, []) as detection_delays, coalesce(recovery_delays, []) as recovery_delays, false_promotions, 1::bigint as baseline_comparisons from r left join l using (series) join f using (series)""")  # fmt: skip
def full_metric_bundle(spark, sf):
    p = path(spark, sf)
    made = metrics.full_bundle(p, "series", "t", RATE, (p.withColumn("position", F.lit(0.5)),))
    return made.select(
        "series", "n_predictions", F.round("one_sided_regret", 6).alias("one_sided_regret"), F.round("mean_step_one_sided_regret", 9).alias("mean_step_one_sided_regret"),
        "detection_delays", "recovery_delays", "false_promotions", "baseline_comparisons",
    )


_X = "x as (select event_id, (value - 40) / 50 as x, abs(value - 40) / 60 as p from events)"


@query("position_modes", f"""with {_X} select event_id, round(greatest(-1, least(1, x)), 9) as position, round(greatest(-1, least(1, case when p > 0 and p < 1 then 2 * p - 1 when p in (0, 1) then 2 * p - 1 else p end)), 9) as chance,
 case when p < 0.5 then -1.0::double else 1.0::double end as label, sign(x)::double as signed, case when x <= -0.5 then -1.0::double else 1.0::double end as pair, round(greatest(0, least(0.4, x)), 9) + 0 as long_only from x""")  # fmt: skip
def position_modes(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("value") - 40) / 50).alias("x"), (F.abs(F.col("value") - 40) / 60).alias("p"))
    to = scalars.mapped_position
    return e.select(
        "event_id", F.round(to(F.col("x"), "position"), 9).alias("position"), F.round(to(F.col("p"), "auto", (0, 1)), 9).alias("chance"), to(F.col("p"), "label", (1, 0)).alias("label"),
        to(F.col("x"), "label", (-1, 1)).alias("signed"), to(F.col("x"), "label", (-0.5, 2)).alias("pair"), (F.round(to(F.col("x"), most=0.4, short=False), 9) + 0.0).alias("long_only"),
    )


@query("forgetting_factors", f"""with {_X} select event_id, round(greatest(0.9, least(1, 0.9 + 0.1 * exp(-0.5 * p / 2))), 9) as scaled, round(greatest(0.9, least(1, 0.9 + 0.1 * exp(-0.5 * greatest(0, p - 0.4)))), 9) as excess,
 round(greatest(0.05, least(1, exp(-p))), 9) as weight, round(greatest(0.01, least(0.5, 0.01 + 0.3 * p)), 9) as radius, round(greatest(-1, least(1, x / 0.25)), 9) as position from x""")  # fmt: skip
def forgetting_factors(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("value") - 40) / 50).alias("x"), (F.abs(F.col("value") - 40) / 60).alias("p"))
    made = e.select(
        "event_id", scalars.forgetting(F.col("p"), 0.9, 1.0, 0.5, 2.0).alias("scaled"), scalars.excess_forgetting(F.col("p"), 0.4, 0.9, 1.0, 0.5).alias("excess"),
        scalars.transport_weight(F.col("p"), 0.05).alias("weight"), scalars.radius(F.col("p"), 0.01, 0.3, 0.5).alias("radius"), scalars.position(F.col("x"), 0.25).alias("position"),
    )
    return rounded(made, "scaled", "excess", "weight", "radius", "position", n=9)


@query("utility_scores", f"""with {_X} select event_id, round(-least(abs(x - p), 0.5), 9) + 0 as utility, round(greatest(-0.4, least(0.4, x)) / 0.4, 9) + 0 as bounded, round(greatest(-0.3, least(0.3, case when x = p then 0 else x - p end)) / 0.3, 9) + 0 as difference,
 round(least(x, x) * 0 + 0.001 + 0.0005 + 3 / 1e4, 9) as rate from x""")  # fmt: skip
def utility_scores(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("value") - 40) / 50).alias("x"), (F.abs(F.col("value") - 40) / 60).alias("p"))
    made = e.select(
        "event_id", evidence.utility(F.col("x"), F.col("p"), 0.5).alias("utility"), evidence.bounded(F.col("x"), 0.4).alias("bounded"),
        scalars.score_difference(F.col("x"), F.col("p"), 0.3).alias("difference"), F.lit(scalars.cost_rate(0.001, 0.0005, 3)).alias("rate"),
    )
    return rounded(made, "utility", "bounded", "difference", "rate", n=9).withColumns({c: F.col(c) + 0.0 for c in ("utility", "bounded", "difference")})


@query("share_entropy", """with g as (select user_id, event_type, sum(abs(value)) as v from events group by 1, 2), s as (select user_id, v / sum(v) over (partition by user_id) as p, count(*) over (partition by user_id) as n from g where v > 1e-15)
select user_id, round(case when max(n) < 2 then 0 else greatest(0, least(1, -sum(p * ln(p)) / ln(max(n)))) end, 6) as entropy from s group by 1""")  # fmt: skip
def share_entropy(spark, sf):
    sums = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sum(F.abs("value")).alias("v"))
    made = sums.groupBy("user_id").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return made.select("user_id", F.round(scalars.spectral_entropy(F.col("v")), 6).alias("entropy"))


@query("epoch_dates", "select event_id, (epoch_us(ts) // 1000000)::bigint as epoch, ts::date as d from events")
def epoch_dates(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("epoch"))
    return e.select("event_id", "epoch", feeds.iso_date(F.col("epoch")).alias("d"))


@query("masked_correlation", f"""with {_X}, m as (select event_id % 7 as g, case when event_id % 11 = 0 then 'nan'::double when event_id % 13 = 0 then 'infinity'::double else x end as a, p as b from x)
select g, round(coalesce(corr(a, b) filter (isfinite(a) and isfinite(b)), 0), 6) as r, (count(*) filter (isfinite(a)))::bigint as n from m group by 1""")  # fmt: skip
def masked_correlation(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("value") - 40) / 50).alias("x"), (F.abs(F.col("value") - 40) / 60).alias("b"))
    odd = F.when(F.col("event_id") % 11 == 0, float("nan")).when(F.col("event_id") % 13 == 0, float("inf")).otherwise(F.col("x"))
    made = e.select((F.col("event_id") % 7).alias("g"), odd.alias("a"), "b").groupBy("g").agg(*[c.alias(n) for c, n in zip(metrics.masked_corr("a", "b"), ("r", "n"), strict=True)])
    return rounded(made, "r")


@query("mad_scale", """with m as (select user_id, median(value) as c from events group by 1), d as (select user_id, abs(value - c) as d from events join m using (user_id))
select user_id, round(greatest(1.4826 * median(d), 1e-6), 6) as scale from d group by 1""")  # fmt: skip
def mad_scale(spark, sf):
    return rounded(windows.mad_scale(table(spark, sf, "events"), "user_id", "value", 1e-6).select("user_id", "scale"), "scale")


@query("recent_history", """with r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id desc) as k from events)
select user_id, count(*)::bigint as n, min(event_id) as first_id, round(sum(value), 6) as total from r where k <= 16 group by 1""")  # fmt: skip
def recent_history(spark, sf):
    kept = metrics.tail(table(spark, sf, "events"), "user_id", "event_id", 16)
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.round(F.sum("value"), 6).alias("total"))


_TREND = """m{0} as (select *, avg(price) over w as mean, count(price) over w as n, lead(price) over (partition by series order by t) / price - 1 as realised from daily window w as (partition by series order by t rows between {0} preceding and 1 preceding)),
p{0} as (select *, case when n = {0} and price > mean then 1.0 else 0.0 end as position from m{0}), c{0} as (select *, abs(position - coalesce(lag(position) over (partition by series order by t), 0)) as moved from p{0}),
n{0} as (select series, t, {0} as lookback, position * realised - 0.0005 * moved as net from c{0} where realised is not null and t <= 150)"""


@query("training_selection", f"""with {DAILY}, {", ".join(_TREND.format(n) for n in (10, 30, 60))}, u as (select * from n10 union all select * from n30 union all select * from n60),
g as (select *, product(1 + net) over (partition by series, lookback order by t) as grown from u), k as (select *, max(grown) over (partition by series, lookback order by t) as peak from g),
s as (select series, lookback, coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt(252), 0) as sharpe, pow(product(1 + net), 252.0 / count(*)) - 1 as growth, max(1 - grown / peak) as drawdown from k group by 1, 2),
r as (select *, row_number() over (partition by series order by sharpe desc, growth desc, drawdown, lookback) as place from s)
select series, lookback::int as lookback, round(sharpe, 6) as sharpe, round(growth, 6) as growth, round(drawdown, 6) as drawdown from r where place = 1""")  # fmt: skip
def training_selection(spark, sf):
    return rounded(strategies.select_on_training(daily(spark, sf), [10, 30, 60], 5.0, 150), "sharpe", "growth", "drawdown")


@query("panel_features", f"""with {_PANEL}, r as (select *, price / lag(price) over o - 1 as ret_1, price / lag(price, 5) over o - 1 as ret_5, lead(price) over o / price - 1 as nxt from full_panel window o as (partition by series order by t)),
v as (select *, case when count(ret_1) over w = 20 then stddev_samp(ret_1) over w end as vol_20 from r window w as (partition by series order by t rows between 19 preceding and current row)),
k as (select * from v where ret_5 is not null and vol_20 is not null and nxt is not null)
select series, t, round(ret_1, 9) as ret_1, round(ret_5, 9) as ret_5, round(vol_20, 9) as vol_20, round(avg(nxt) over (partition by t) / 0.01, 6) as label from k""")  # fmt: skip
def panel_features(spark, sf):
    made = windows.panel_features(_panel(spark, sf), "series", "t", "price", 0.01).select("series", "t", "ret_1", "ret_5", "vol_20", "label")
    return rounded(rounded(made, "ret_1", "ret_5", "vol_20", n=9), "label")
