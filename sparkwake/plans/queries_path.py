"""Metric, window and evidence queries on the star-schema tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import evidence, metrics, windows
from .inputs import BETS, DAILY, MADE, PATH, RATE, bets, daily, path, table

Q: dict = {}
_R = lambda c, n=6: F.round(c, n).alias(c if isinstance(c, str) else None)


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


def rounded(df, *columns, n: int = 6):
    return df.withColumns({c: F.round(c, n) for c in columns})


@query("path_metric_bundle", f"""with {MADE},
m as (select *, max(equity) over (partition by series order by t) as peak from made)
select series, count(*)::bigint as n_observations, count(*) filter (evaluated)::bigint as n_evaluated, count(*) filter (evaluated and prediction is not null)::bigint as n_predictions, round(sum(gross), 6) as gross_return, round(sum(net), 6) as net_return,
 round(sum(cost), 6) as total_cost, round(sum(change), 6) as turnover, round(sum(change) / greatest(1, count(*) filter (evaluated)), 6) as average_turnover,
 round(avg(net) filter (evaluated) / stddev_samp(net) filter (evaluated) * sqrt(252), 6) as sharpe,
 round(max(case when peak > 0 then (peak - equity) / peak else 0 end), 6) as max_drawdown,
 round(corr(prediction, label) filter (evaluated), 6) as information_coefficient,
 round(avg((sign(prediction) = sign(label))::int) filter (evaluated), 6) as hit_rate from m group by series""")  # fmt: skip
def path_metric_bundle(spark, sf):
    made = metrics.bundle(path(spark, sf), "series", "t", RATE)
    return rounded(made, *[c for c in made.columns if c not in ("series", "n_observations", "n_evaluated", "n_predictions")])


@query("online_pnl_path", f"""with {PATH},
c as (select *, abs(position - coalesce(lag(position) over (partition by series order by t), 0)) as change from path),
n as (select *, position * ret - change * {RATE} as net from c),
e as (select *, 1 + sum(net) over (partition by series order by t) as equity from n),
k as (select *, max(equity) over (partition by series order by t) as peak from e)
select series, round(avg((prediction - label) ** 2), 9) as mse, round(corr(prediction, label), 6) as information_coefficient, round(avg(net), 9) as mean_net_return,
 round(avg(net) / stddev_samp(net) * sqrt(252), 6) as net_sharpe, round(avg(change), 6) as turnover,
 round(max(case when peak > 0 then (peak - equity) / peak else 0 end), 6) as max_drawdown from k group by series""")  # fmt: skip
def online_pnl_path(spark, sf):
    made = metrics.online_bundle(path(spark, sf), "series", "t", RATE)
    return rounded(rounded(made, "mse", "mean_net_return", n=9), "information_coefficient", "net_sharpe", "turnover", "max_drawdown")


@query("drawdown_conventions", f"""with {MADE},
e as (select *, exp(sum(ln(1 + net)) over (partition by series order by t)) as grown from made),
k as (select *, max(equity) over (partition by series order by t) as p, max(grown) over (partition by series order by t) as q from e)
select series, round(max((p - equity) / p), 6) as from_first, round(greatest(0, max((greatest(1, p) - equity) / greatest(1, p))), 6) as from_one,
 round(max((q - grown) / q), 6) as compounded from k group by series""")  # fmt: skip
def drawdown_conventions(spark, sf):
    made = metrics.with_path(path(spark, sf), "series", "t", RATE)
    return rounded(metrics.drawdowns(made, "series", "t"), "from_first", "from_one", "compounded")


@query("comparator_regret", f"""with {MADE},
b as (select series, t, case when evaluated then optimal * ret else 0 end as best_gross,
  case when evaluated then optimal * ret - abs(optimal - coalesce(lag(optimal) over (partition by series, evaluated order by t), 0)) * {RATE} else 0 end as best_net from path)
select series, round(sum(case when evaluated then best_gross - net else 0 end), 6) as legacy_gap,
 round(sum(case when evaluated then abs(best_net - net) else 0 end), 6) as absolute_discrepancy,
 round(sum(case when evaluated then greatest(best_net - net, 0) else 0 end), 6) as one_sided_regret from made join b using (series, t) group by series""")  # fmt: skip
def comparator_regret(spark, sf):
    return rounded(metrics.comparator(path(spark, sf), "series", "t", RATE), "legacy_gap", "absolute_discrepancy", "one_sided_regret")


_CHANGES = "cps as (select series, t as cp from (select series, t, regime, lag(regime) over (partition by series order by t) as r from path) where r is not null and regime <> r)"


@query("change_points", f"with {PATH}, {_CHANGES} select * from cps")
def change_points(spark, sf):
    return metrics.change_points(path(spark, sf), "series", "t")


@query("detection_delay", f"""with {PATH}, {_CHANGES},
k as (select series, t, sum((evaluated and coalesce(position * optimal > 0, false))::int) over (partition by series order by t rows between current row and 2 following) as k from path),
f as (select series, cp, min(t) as f from cps left join (select series as s, t from k where k = 3) on s = series and t >= cp group by 1, 2)
select series, cp, f - cp as detection_delay from f""")  # fmt: skip
def detection_delay(spark, sf):
    p = path(spark, sf)
    return metrics.detection_delays(p, metrics.change_points(p, "series", "t"), "series", "t", 3)


@query("recovery_delay", f"""with {MADE}, {_CHANGES},
w as (select c.series, c.cp, max(m.equity) as target from cps c join made m on m.series = c.series and m.t < c.cp group by 1, 2),
f as (select w.series, w.cp, min(m.t) as f from w left join made m on m.series = w.series and m.t >= w.cp and m.equity >= w.target group by 1, 2)
select series, cp, f - cp as recovery_delay from f""")  # fmt: skip
def recovery_delay(spark, sf):
    made = metrics.with_path(path(spark, sf), "series", "t", RATE)
    return metrics.recovery_delays(made, metrics.change_points(made, "series", "t"), "series", "t")


@query("alarm_delay_censored", f"""with {PATH}, {_CHANGES},
s as (select series, cp, coalesce(lead(cp) over (partition by series order by cp), (select max(t) + 1 from path p where p.series = cps.series)) as stop from cps)
select s.series, cp, coalesce(min(p.t) - cp, stop - cp) as delay from s left join path p on p.series = s.series and p.t >= cp and p.t < stop and abs(p.ret) > 0.1 group by s.series, cp, stop""")  # fmt: skip
def alarm_delay_censored(spark, sf):
    p = path(spark, sf)
    order = Window.partitionBy("series").orderBy("t")
    segment = F.sum(F.coalesce(F.col("regime") != F.lag("regime").over(order), F.lit(False)).cast("int")).over(order)
    seen = p.withColumn("segment", segment).where("segment > 0").groupBy("series", "segment").agg(
        F.min("t").alias("cp"), F.max("t").alias("last"), F.min(F.when(F.abs("ret") > 0.1, F.col("t"))).alias("alarm")
    )
    return seen.select("series", "cp", F.coalesce(F.col("alarm") - F.col("cp"), F.col("last") + 1 - F.col("cp")).alias("delay"))


@query("baseline_false_promotion", f"""with {MADE},
b as (select series, t, net as c, case when evaluated then 0.5 * ret - abs(0.5 - coalesce(lag(0.5) over (partition by series, evaluated order by t), 0)) * {RATE} else 0 end as b from made where evaluated),
n as (select *, row_number() over (partition by series order by t) as nth, greatest(1, count(*) over (partition by series) // 2) as half from b),
s as (select series, sum(c) as cr, sum(b) as br, sum(c) filter (nth <= half) as ec, sum(b) filter (nth <= half) as eb, sum(c) filter (nth > half) as lc, sum(b) filter (nth > half) as lb from n group by series)
select series, round(cr, 6) as candidate_return, round(br, 6) as baseline_return, round(ec, 6) as early_candidate, round(eb, 6) as early_baseline,
 round(lc, 6) as later_candidate, round(lb, 6) as later_baseline, ec > eb as promoted, ec > eb and lc < lb as false_promotion from s""")  # fmt: skip
def baseline_false_promotion(spark, sf):
    p = path(spark, sf)
    made = metrics.with_path(p, "series", "t", RATE)
    base = metrics.with_path(p.withColumn("position", F.lit(0.5)), "series", "t", RATE)
    out = metrics.against_baseline(made, base, "series", "t")
    return rounded(out, *[c for c in out.columns if c not in ("series", "promoted", "false_promotion")])


@query("per_year_metrics", f"""with {MADE}
select series, year(d)::int as year, count(*)::bigint as n, round(sum(net), 6) as net_return, round(coalesce(avg(net) / stddev_samp(net) * sqrt(252), 0), 6) as sharpe,
 round(exp(sum(ln(1 + net)) * 252.0 / count(*)) - 1, 6) as annualised from made where evaluated group by 1, 2""")  # fmt: skip
def per_year_metrics(spark, sf):
    made = metrics.with_path(path(spark, sf), "series", "t", RATE).where("evaluated")
    return made.groupBy("series", F.year("d").alias("year")).agg(
        F.count("*").alias("n"), F.round(F.sum("net"), 6).alias("net_return"), F.round(metrics.sharpe(F.col("net"), 252, 1e-15), 6).alias("sharpe"),
        F.round(F.pow(F.product(1 + F.col("net")), F.lit(252.0) / F.count("*")) - 1, 6).alias("annualised"),
    )


@query("wilson_interval", """with g as (select event_type, count(*) filter (value > 100)::double as x, count(*)::double as n from events group by 1),
w as (select *, x / n as p, 1.959963984540054 as z from g)
select event_type, x::bigint as hits, n::bigint as n,
 round(greatest(0, (p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) as low,
 round(least(1, (p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n)), 9) as high from w""")  # fmt: skip
def wilson_interval(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("hits"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("hits").cast("double"), F.col("n").cast("double"))
    return g.select("event_type", "hits", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("censored_run_length", """with r as (select user_id, coalesce(min(k) filter (value > 200), 60) as run, coalesce(min(k) filter (value > 200), 60) = 60 as censored from (
  select user_id, value, row_number() over (partition by user_id order by event_id) as k from events) where k <= 60 group by 1)
select user_id % 5 as grp, round(avg(run), 9) as mean_run_length, round(avg(censored::int), 9) as censored_fraction from r group by 1""")  # fmt: skip
def censored_run_length(spark, sf):
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").withColumn("k", F.row_number().over(order)).where("k <= 60")
    runs = rows.groupBy("user_id").agg(F.coalesce(F.min(F.when(F.col("value") > 200, F.col("k"))), F.lit(60)).alias("run"))
    return runs.groupBy((F.col("user_id") % 5).alias("grp")).agg(
        F.round(F.avg("run"), 9).alias("mean_run_length"), F.round(F.avg((F.col("run") == 60).cast("int")), 9).alias("censored_fraction")
    )


@query("block_mean_shift", f"""with {DAILY}, x as (select series, t, price / 1e6 as x from daily),
s as (select series, t, avg(x) over c - avg(x) over p as gap, stddev_samp(x) over p as sd, count(x) over p as n from x
 window c as (partition by series order by t rows between 7 preceding and current row), p as (partition by series order by t rows between 15 preceding and 8 preceding))
select series, t, round(abs(gap) / greatest(sd, 1e-6), 6) as shift from s where n = 8""")  # fmt: skip
def block_mean_shift(spark, sf):
    x = daily(spark, sf).withColumn("x", F.col("price") / 1e6)
    shift = windows.block_mean_shift(F.col("x"), windows.along("series", "t"), 8)
    return x.withColumn("shift", shift).where("shift is not null").select("series", "t", F.round("shift", 6).alias("shift"))


@query("rolling_robust_scale", """with l as (select event_type, quantile_cont(value, 0.5) as location, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr from events group by 1),
m as (select event_type, any_value(location) as location, any_value(iqr) as iqr, quantile_cont(abs(value - location), 0.5) as mad from events join l using (event_type) group by 1)
select event_type, round(location, 6) as location, round(greatest(1.4826 * mad, iqr / 1.3489795, 1e-12), 6) as scale from m""")  # fmt: skip
def robust_scale(spark, sf):
    return rounded(windows.robust_scale(table(spark, sf, "events"), "event_type", "value"), "location", "scale")


@query("prior_window_zscore", """with x as (select event_type, event_id, value, count(value) over w as n, quantile_cont(value, 0.25) over w as q1, quantile_cont(value, 0.5) over w as q2, quantile_cont(value, 0.75) over w as q3
 from events window w as (partition by event_type order by event_id rows between 24 preceding and 1 preceding))
select event_type, event_id, round((value - q2) / greatest((q3 - q1) / 1.3489795, 1e-12), 6) as z from x where n >= 12""")  # fmt: skip
def prior_window_zscore(spark, sf):
    z = windows.prior_robust_z(F.col("value"), windows.along("event_type", "event_id"), 24, 12)
    return table(spark, sf, "events").withColumn("z", z).where("z is not null").select("event_type", "event_id", F.round("z", 6).alias("z"))


@query("delay_cloud_stats", """with p as (select user_id, event_id, value, lag(value, 1) over w as v1, lag(value, 2) over w as v2 from events window w as (partition by user_id order by event_id)),
c as (select user_id, event_id, count(v2) over f as points, avg(case when v2 is not null then v2 end) over f as m0, avg(case when v2 is not null then value end) over f as m2
 from p window f as (partition by user_id order by event_id rows between 7 preceding and current row))
select user_id, event_id, points::bigint as points, round(m0, 6) as mean_oldest, round(m2, 6) as mean_newest from c where points > 0""")  # fmt: skip
def delay_cloud_stats(spark, sf):
    order = windows.along("user_id", "event_id")
    made = table(spark, sf, "events").withColumn("point", windows.delay_embedding(F.col("value"), order, 3))
    cloud = made.withColumn("cloud", windows.rolling_cloud(F.col("point"), order, 8)).where("size(cloud) > 0")
    mean = lambda i: F.round(F.aggregate("cloud", F.lit(0.0), lambda a, p: a + p[i]) / F.size("cloud"), 6)
    return cloud.select("user_id", "event_id", F.size("cloud").cast("long").alias("points"), mean(0).alias("mean_oldest"), mean(2).alias("mean_newest"))


_CUSUM_SQL = f"""with {PATH}, o as (select series, t, ret, t % 50 <> 0 as ok, sum((t % 50 = 0)::int) over (partition by series order by t) as island from path),
s as (select *, sum(case when ok then ret - 0.01 else 0 end) over (partition by series, island order by t) as s from o),
g as (select series, t, case when ok then s - least(0, min(s) over (partition by series, island order by t)) else 0 end as g, ok from s)
select series, t, round(g, 6) as g, ok and g >= 0.15 as alarm from g"""


@query("cusum", _CUSUM_SQL)
def cusum(spark, sf):
    made = windows.cusum(path(spark, sf), "series", "t", "ret", 0.01, 0.15, F.col("t") % 50 != 0)
    return made.select("series", "t", F.round("g", 6).alias("g"), "alarm")


@query("cusum_decay", f"""with recursive {PATH}, g as (
 select series, t, greatest(0, ret - 0.01)::double as g from path where t = 1
 union all select p.series, p.t, greatest(0, g.g * 0.9 + p.ret - 0.01)::double from g join path p on p.series = g.series and p.t = g.t + 1)
select series, t, round(g, 6) as g, g >= 0.15 as alarm from g""")  # fmt: skip
def cusum_decay(spark, sf):
    made = windows.decaying_cusum(path(spark, sf).select("series", "t", "ret"), "series", "t", "ret", 0.01, 0.15, 0.9)
    return made.select("series", "t", F.round("g", 6).alias("g"), "alarm")


@query("trend_signal", f"""with {DAILY}, m as (select series, t, price, case when count(price) over w = 20 then avg(price) over w end as mean, lead(price) over (partition by series order by t) as nxt
 from daily window w as (partition by series order by t rows between 20 preceding and 1 preceding))
select series, t, (price > mean)::int as long, round(nxt / price - 1, 6) as next_return from m where mean is not null and nxt is not null""")  # fmt: skip
def trend_signal(spark, sf):
    order = windows.along("series", "t")
    d = daily(spark, sf).withColumns({"mean": windows.prior_mean(F.col("price"), order, 20), "nxt": F.lead("price").over(order)})
    return d.where("mean is not null and nxt is not null").select(
        "series", "t", (F.col("price") > F.col("mean")).cast("int").alias("long"), F.round(F.col("nxt") / F.col("price") - 1, 6).alias("next_return")
    )


@query("momentum_topk", f"""with {DAILY}, m as (select series, d, lag(price, 1) over w / lag(price, 11) over w - 1 as mom from daily window w as (partition by series order by t)),
r as (select *, row_number() over (partition by d order by mom desc, series) as k from m where mom > 0)
select d, series, round(mom, 6) as momentum, k::int as place from r where k <= 2""")  # fmt: skip
def momentum_topk(spark, sf):
    d = daily(spark, sf).withColumn("momentum", windows.momentum(F.col("price"), windows.along("series", "t"), 11, 1)).where("momentum > 0")
    best = Window.partitionBy("d").orderBy(F.desc("momentum"), "series")
    return d.withColumn("place", F.row_number().over(best)).where("place <= 2").select("d", "series", F.round("momentum", 6).alias("momentum"), "place")


@query("vol_target", f"""with {PATH}, v as (select series, t, case when count(ret) over w = 20 then stddev_samp(ret) over w end as vol from path window w as (partition by series order by t rows between 20 preceding and 1 preceding))
select series, t, round(least(1, 0.02 / greatest(vol, 1e-9)), 6) as scale from v where vol is not null""")  # fmt: skip
def vol_target(spark, sf):
    vol = windows.prior_volatility(F.col("ret"), windows.along("series", "t"), 20)
    made = path(spark, sf).withColumn("vol", vol).where("vol is not null")
    return made.select("series", "t", F.round(F.least(F.lit(1.0), 0.02 / F.greatest("vol", F.lit(1e-9))), 6).alias("scale"))


_WALK = [10, 20, 40]


@query("annual_walkforward", f"""with {PATH}, g(lookback) as (values (10), (20), (40)),
x as (select p.series, p.d, p.t, g.lookback, p.ret, (select case when count(*) = g.lookback then avg(q.price) end from path q where q.series = p.series and q.t between p.t - g.lookback - 1 and p.t - 2) as mean,
  lag(p.price) over (partition by p.series, g.lookback order by p.t) as prev from path p, g),
y as (select series, year(d) as year, lookback, sum(case when prev > mean then ret else 0 end) as pnl from x group by all),
s as (select series, year, lookback, pnl, sum(pnl) over (partition by series, lookback order by year rows between unbounded preceding and 1 preceding) as past from y),
b as (select *, row_number() over (partition by series, year order by past desc, lookback) as k from s where past is not null)
select series, year::int as year, lookback::int as lookback, round(pnl, 6) as pnl from b where k = 1""")  # fmt: skip
def annual_walkforward(spark, sf):
    from ..operators.strategies import annual_refit

    return annual_refit(path(spark, sf), _WALK).select("series", "year", "lookback", F.round("pnl", 6).alias("pnl"))


_W = "product(1 + 0.5 * score) over (partition by gate, challenger order by t)"


@query("eprocess_wealth", f"with {BETS} select gate, challenger, t, round({_W}, 6) as wealth from bets")
def eprocess_wealth(spark, sf):
    return rounded(evidence.wealth(bets(spark, sf), ["gate", "challenger"], "t", "score", F.lit(0.5)), "wealth").drop("score")


@query("first_crossing", f"""with {BETS}, w as (select *, {_W} as wealth from bets)
select gate, challenger, min(t) filter (wealth >= 20) as crossed_at, round(max(wealth), 6) as peak_wealth, count(*)::bigint as n from w group by 1, 2""")  # fmt: skip
def first_crossing(spark, sf):
    w = evidence.wealth(bets(spark, sf), ["gate", "challenger"], "t", "score", F.lit(0.5))
    return rounded(evidence.first_crossing(w, ["gate", "challenger"], "t", evidence.threshold(0.05)), "peak_wealth")


@query("gate_first_promotion", f"""with {BETS}, w as (select *, {_W} as wealth from bets),
c as (select gate, min(struct_pack(at := t, who := challenger)) as f from w where wealth >= 5 group by 1)
select gate, any_value(f.who) as promoted, any_value(f.at) as promoted_at, count(*)::bigint as observations from w left join c using (gate) where f is null or t <= f.at group by 1""")  # fmt: skip
def gate_first_promotion(spark, sf):
    w = evidence.wealth(bets(spark, sf), ["gate", "challenger"], "t", "score", F.lit(0.5))
    return evidence.gate(w, ["gate"], "challenger", "t", 5.0)


@query("betting_fraction", f"""with {BETS} select gate, challenger, t, round(greatest(0, least(0.5, coalesce(avg(score) over (partition by gate, challenger order by t rows between unbounded preceding and 1 preceding), 0))), 6) as eta from bets""")
def betting_fraction(spark, sf):
    b = bets(spark, sf)
    return b.select("gate", "challenger", "t", F.round(evidence.betting_fraction("score", ["gate", "challenger"], "t"), 6).alias("eta"))


@query("alpha_allocation", """select event_type, user_id, slot, 0.05 * pow(2, -slot) * pow(2, -(user_id % 3 + 1)) as alpha from (
 select event_type, user_id, row_number() over (partition by event_type order by user_id)::bigint as slot from (select distinct event_type, user_id from events))""")  # fmt: skip
def alpha_allocation(spark, sf):
    d = table(spark, sf, "events").select("event_type", "user_id").distinct()
    d = d.withColumn("slot", F.row_number().over(Window.partitionBy("event_type").orderBy("user_id")).cast("long"))
    return d.withColumn("alpha", evidence.slot_alpha(0.05, F.col("slot"), F.col("user_id") % 3))


@query("selection_budget", """select m as model, f as feature, e as epoch, 0.05 / 48 as cell_alpha, 48::bigint as cells from
 (select unnest(['a', 'b', 'c', 'd']) as m), (select unnest(['x', 'y', 'z']) as f), (select unnest([1, 2, 3, 4]) as e)""")  # fmt: skip
def selection_budget(spark, sf):
    return evidence.selection_budget({"model": list("abcd"), "feature": list("xyz"), "epoch": [1, 2, 3, 4]}, 0.05, spark)


@query("ready_prefix", """with e as (select user_id, event_id, event_type <> 'error' as ready from events),
o as (select *, sum((not ready)::int) over (partition by user_id order by event_id) as open from e)
select user_id, event_id from o where open = 0""")  # fmt: skip
def ready_prefix(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_type") != "error").alias("ready"))
    return evidence.ready_prefix(e, ["user_id"], "event_id", "ready").drop("ready")


@query("price_features", f"""with {DAILY}, r as (select *, price / lag(price) over (partition by series order by t) - 1 as r1 from daily),
f as (select series, t, r1, price / lag(price, 5) over o - 1 as r5, case when count(r1) over w = 20 then stddev_samp(r1) over w end as v, lead(price) over o / price - 1 as y from r
 window o as (partition by series order by t), w as (partition by series order by t rows between 19 preceding and current row))
select series, t, round(r1, 6) as ret_1, round(r5, 6) as ret_5, round(v, 6) as vol_20, round(y, 6) as label from f where r5 is not null and v is not null and y is not null""")  # fmt: skip
def price_features(spark, sf):
    made = windows.price_features(daily(spark, sf), "series", "t", "price")
    return rounded(made.select("series", "t", "ret_1", "ret_5", "vol_20", "label"), "ret_1", "ret_5", "vol_20", "label")


@query("calibration_zscore", """with n as (select event_type, event_id, value, row_number() over (partition by event_type order by event_id) as k from events),
f as (select event_type, avg(value) as m, greatest(stddev_samp(value), 1e-12) as s from n where k <= 100 group by 1)
select event_type, event_id, round((value - m) / s, 6) as z from n join f using (event_type)""")  # fmt: skip
def calibration_zscore(spark, sf):
    return windows.split_zscore(table(spark, sf, "events"), "event_type", "event_id", "value", 100).select("event_type", "event_id", F.round("z", 6).alias("z"))


@query("held_positions", f"""with {PATH}, f as (select series, t, case when (t - 1) % 5 = 0 then position end as fresh from path)
select series, t, round(last_value(fresh ignore nulls) over (partition by series order by t rows unbounded preceding), 6) as position from f""")  # fmt: skip
def held_positions(spark, sf):
    from ..operators.strategies import hold_between

    return hold_between(path(spark, sf).select("series", "t", "position"), ["series"], "t", 5, "position").select("series", "t", F.round("position", 6).alias("position"))


@query("inverse_vol_weights", f"""with {PATH}, v as (select series, d, case when count(ret) over w = 20 then stddev_samp(ret) over w end as vol, lag(price, 1) over o / lag(price, 11) over o - 1 as mom from path
 window o as (partition by series order by t), w as (partition by series order by t rows between 20 preceding and 1 preceding)),
k as (select *, row_number() over (partition by d order by mom desc, series) as place from v where vol is not null and mom > 0),
s as (select d, series, vol, (1 / greatest(vol, 1e-9)) / sum(1 / greatest(vol, 1e-9)) over (partition by d) as share from k where place <= 2),
r as (select *, sqrt(sum((share * vol) ** 2) over (partition by d)) as risk from s)
select d, series, round(share * least(1, 0.02 / greatest(risk, 1e-9)), 6) as weight from r""")  # fmt: skip
def inverse_vol_weights(spark, sf):
    from ..operators.strategies import inverse_vol_weights as weigh

    order = windows.along("series", "t")
    made = path(spark, sf).withColumns({"vol": windows.prior_volatility(F.col("ret"), order, 20), "mom": windows.momentum(F.col("price"), order, 11, 1)})
    ranked = made.where("vol is not null and mom > 0").withColumn("place", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("mom"), "series")))
    return weigh(ranked, "d", "vol", 2, 0.02).select("d", "series", F.round("weight", 6).alias("weight"))


@query("parameter_grid_argmax", f"""with {PATH}, g(lookback) as (values (10), (20), (40)),
x as (select p.series, p.t, g.lookback, p.ret, (select case when count(*) = g.lookback then avg(q.price) end from path q where q.series = p.series and q.t between p.t - g.lookback - 1 and p.t - 2) as mean,
  lag(p.price) over (partition by p.series, g.lookback order by p.t) as prev from path p, g),
y as (select series, lookback, sum(case when prev > mean then ret else 0 end) as pnl from x group by all),
k as (select *, row_number() over (partition by series order by pnl desc, lookback) as k from y)
select series, lookback::int as lookback, round(pnl, 6) as pnl from k where k = 1""")  # fmt: skip
def parameter_grid_argmax(spark, sf):
    from ..operators.strategies import grid_best, trend_pnl

    sums = trend_pnl(path(spark, sf), _WALK).groupBy("series", "lookback").agg(F.sum("pnl").alias("pnl"))
    return rounded(grid_best(sums, ["lookback"], "pnl", ["lookback"], ["series"]), "pnl")


@query("evidence_ledger", f"""with {PATH}, p as (select series, t, series || '-' || t as target_id, case when t % 11 = 0 then 'missing' else 'observed' end as status, t + 2 + (t % 7) * 3 as available from path),
s as (select series, t, target_id, case when t % 13 <> 0 and available <= 1200 then status when t + 10 <= 1200 then 'expired' else 'open' end as state from p where t <= 1200),
o as (select *, sum((state = 'open')::int) over (partition by series order by t) as open from s),
k as (select *, coalesce(sum((state = 'observed')::int) over (partition by series order by t rows between unbounded preceding and 1 preceding), 0) as before, row_number() over (partition by series order by t)::bigint as position from o where open = 0)
select series, target_id, t, state, position, state = 'observed' and before >= 30 as is_evidence from k""")  # fmt: skip
def evidence_ledger(spark, sf):
    p = path(spark, sf).withColumn("target_id", F.concat_ws("-", "series", "t"))
    status = F.when(F.col("t") % 11 == 0, "missing").otherwise("observed")
    # every thirteenth label never arrives
    arrives = F.when(F.col("t") % 13 != 0, F.col("t") + 2 + (F.col("t") % 7) * 3)
    labels = p.select("target_id", arrives.alias("available_time"), status.alias("status"))
    return evidence.evidence_ledger(p.select("series", "t", "target_id"), labels, ["series"], "t", F.lit(1200), 10, 30)
