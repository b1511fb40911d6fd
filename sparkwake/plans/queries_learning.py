"""Learning, detection, calibration and replay queries on the star-schema tables, with their SQL where there is one."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import steps, topology
from ..operators import calibration, detect, economic, learning
from ..operators.folds import fold
from .inputs import PATH, lagged, path, table
from .queries_path import rounded

Q: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = (f, sql)
        return f

    return put


_L = 0.97
_SUMS = f"""{PATH}, r as (select series, t, prediction * 20 as x, ret * 20 as y from path),
s as (select *, sum(x * y * pow({_L}, -t)) over o as sxy, sum(x * x * pow({_L}, -t)) over o as sxx from r window o as (partition by series order by t))"""


def _regression(spark, sf):
    return path(spark, sf).select("series", "t", F.array(F.col("prediction") * 20).alias("features"), (F.col("ret") * 20).alias("target"))


@query("rls_const_lambda", f"with {_SUMS} select series, t, round(sxy / (0.7 + sxx), 6) as theta from s")
def rls_const_lambda(spark, sf):
    made = fold(_regression(spark, sf), ["series"], "t", steps.Rls(1, ridge=0.7, factor=_L))
    return made.select("series", "t", F.round(F.col("theta")[0], 6).alias("theta"))


@query("rls_prediction", f"with {_SUMS} select series, t, round(x * coalesce(lag(sxy / (0.7 + sxx)) over (partition by series order by t), 0), 6) + 0 as prediction from s")
def rls_prediction(spark, sf):
    made = fold(_regression(spark, sf), ["series"], "t", steps.Rls(1, ridge=0.7, factor=_L))
    return made.select("series", "t", (F.round("prediction", 6) + 0.0).alias("prediction"))


@query("rls_delayed_labels", f"""with {_SUMS}, p as (select series, t, x * coalesce(lag(sxy / (0.7 + sxx), 3) over (partition by series order by t), 0) as prediction from s),
q as (select *, greatest(-1, least(1, prediction)) as position from p)
select series, t, round(prediction, 6) + 0 as prediction, round(position, 6) + 0 as position, round(abs(position - coalesce(lag(position) over (partition by series order by t), 0)) * 0.001, 9) as cost from q""")  # fmt: skip
def rls_delayed_labels(spark, sf):
    rows = _regression(spark, sf).withColumns({"step": F.col("t"), "available_step": F.col("t") + 3})
    made = fold(rows, ["series"], "t", steps.RecursiveRun(1, ridge=0.7, neutral=_L, cost_rate=0.001))
    return made.select("series", "t", (F.round("prediction", 6) + 0.0).alias("prediction"), (F.round("position", 6) + 0.0).alias("position"), F.round("cost", 9).alias("cost"))


@query("rolling_ridge", f"""with {PATH}, r as (select series, t, prediction * 20 as x, ret * 20 as y from path)
select series, t, round(sum(x * y) over w / (0.5 + sum(x * x) over w), 6) as slope from r window w as (partition by series order by t rows between 32 preceding and 1 preceding)""")  # fmt: skip
def rolling_ridge(spark, sf):
    rows = path(spark, sf).select("series", "t", (F.col("prediction") * 20).alias("x"), (F.col("ret") * 20).alias("y"))
    return learning.rolling_ridge(rows, "series", "t", "x", "y", 32, 0.5).select("series", "t", F.round("slope", 6).alias("slope"))


@query("mean_label_model", f"""with {PATH} select series, t, round(avg(label) over (partition by series order by t rows between unbounded preceding and 3 preceding), 9) as prediction from path""")
def mean_label_model(spark, sf):
    p = path(spark, sf)
    return p.select("series", "t", F.round(learning.mean_label(p, "series", "t", "label", 2), 9).alias("prediction"))


@query("walk_forward_backtest", f"""with {PATH}, c as (select series, t, label, count(*) over (partition by series) as n from path),
e as (select series, t, 60 + ((t - 61) // 25) * 25 as fitted from c where t > 60)
select e.series, e.t, round((select avg(q.label) from path q where q.series = e.series and q.t <= fitted - 2 and q.t > fitted - 42), 9) as prediction from e""")  # fmt: skip
def walk_forward_backtest(spark, sf):
    rows = path(spark, sf).select("series", "t", F.array("prediction").alias("features"), "label")
    made = learning.walk_forward(rows, "series", "t", 60, 25, 40, 2, lambda x, y: y.mean(), lambda m, x: m)
    return made.select("series", "t", F.round("prediction", 9).alias("prediction"))


_TS = "s1 as (select user_id, event_id, (value - lag(value) over (partition by user_id order by event_id)) / 100 as a, 0.1::double as b from events)"


@query("signature_depth2", f"""with {_TS}, r as (select user_id, a, b, coalesce(sum(a) over w, 0) as pa, coalesce(sum(b) over w, 0) as pb from s1 where a is not null
 window w as (partition by user_id order by event_id rows between unbounded preceding and 1 preceding))
select user_id, round(sum(a), 6) as s1, round(sum(b), 6) as s2, round(sum(pa * a + a * a / 2), 6) as s11, round(sum(pa * b + a * b / 2), 6) as s12,
 round(sum(pb * a + a * b / 2), 6) as s21, round(sum(pb * b + b * b / 2), 6) as s22 from r group by 1""")  # fmt: skip
def signature_depth2(spark, sf):
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").select("user_id", "event_id", ((F.col("value") - F.lag("value").over(order)) / 100).alias("a"), F.lit(0.1).alias("b"))
    made = learning.signature_depth2(rows.where("a is not null"), "user_id", "event_id", "a", "b")
    return rounded(made, "s1", "s2", "s11", "s12", "s21", "s22")


@query("transport_batch", """with s as (select user_id, event_id as step, value / 107 as th, value / 209 as lo from events),
now as (select user_id, max_by(th, step) as th, max_by(lo, step) as lo from s where step <= 6000 group by 1),
rec as (select user_id, event_id as src, event_id + 30 as av, value / 53 as f, value / 83 as y from events where event_id < 6000 and event_id + 30 < 6000),
own as (select rec.*, (select max_by(th, step) from s where s.user_id = rec.user_id and step <= src) as th0, (select max_by(lo, step) from s where s.user_id = rec.user_id and step <= src) as lo0 from rec),
m as (select user_id, src, f + (now.lo - lo0) as f, y, now.th - th0 as dt, now.lo - lo0 as dl from own join now using (user_id) where th0 is not null)
select user_id, src as source_step, round(f, 6) as feature, round(y + f * dt, 6) as label, round(greatest(0.05, least(1, exp(-(0.5 * abs(dt) + 0.25 * abs(dl))))), 6) as weight from m""")  # fmt: skip
def transport_batch(spark, sf):
    e = table(spark, sf, "events")
    states = e.select("user_id", F.col("event_id").alias("step"), F.array(F.col("value") / 107).alias("theta"), F.array(F.col("value") / 209).alias("location"))
    records = e.select("user_id", F.col("event_id").alias("source_step"), (F.col("event_id") + 30).alias("available_step"), F.array(F.col("value") / 53).alias("features"), (F.col("value") / 83).alias("label"))
    made = learning.transport(records, states, ["user_id"], 6000, 0.5, 0.25, 0.05).where("weight is not null")
    return made.select("user_id", "source_step", F.round(F.col("features")[0], 6).alias("feature"), F.round("label", 6).alias("label"), F.round("weight", 6).alias("weight"))


_ECON = f"""{PATH}, dec as (select series, t, series || '-' || t as target_id, t > 5 as evaluated, case when t > 5 then position * 0.5 else 0 end as position, ret from path),
mv as (select *, case when evaluated then abs(position - coalesce(lag(position) over (partition by series order by t), 0)) else 0 end as turnover from dec),
ec as (select *, turnover * 0.001 as fee, turnover * 0.0005 as spread, turnover * (0.0001 * (t % 3)) as slippage, turnover * 0.0002 as impact, 0 as other, turnover / 1.5 as util,
  case when evaluated then position * ret else 0 end as gross from mv),
en as (select *, gross - fee - spread - slippage - impact - other as net from ec)"""


def _economic(spark, sf):
    p = path(spark, sf).withColumns({"target_id": F.concat_ws("-", "series", "t"), "decision_time": F.col("t"), "evaluated": F.col("t") > 5})
    decisions = p.select("series", "target_id", "decision_time", "evaluated", F.when(F.col("evaluated"), F.col("position") * 0.5).otherwise(0.0).alias("position"))
    # two revisions of each return, of which the first is superseded
    returns = p.select("target_id", "decision_time", F.explode(F.array(F.struct(F.lit(0).alias("source_revision"), (F.col("ret") * 2).alias("value")), F.struct(F.lit(1).alias("source_revision"), F.col("ret").alias("value")))).alias("v"))
    returns = returns.select("target_id", "decision_time", "v.*", F.lit("observed").alias("status"), (F.col("decision_time") + F.col("v.source_revision")).alias("available_time"))
    costs = p.select(
        "target_id", "decision_time", F.lit(0.001).alias("fee_rate"), F.lit(0.0005).alias("spread_rate"), (F.lit(0.0001) * (F.col("t") % 3)).alias("slippage_rate"),
        F.lit(0.0002).alias("impact_rate"), F.lit(0.0).alias("other_rate"), F.lit(1.5).alias("capacity_limit"),
    )
    return economic.economic_path(decisions, economic.evidence_at(returns, F.lit(10**9)), costs, ["series"])


@query("economic_path_costs", f"""with {_ECON} select series, t as decision_time, round(turnover, 6) as turnover, round(fee, 9) as fee_cost, round(slippage, 9) as slippage_cost, round(gross, 9) as gross, round(net, 9) as net from en""")
def economic_path_costs(spark, sf):
    made = _economic(spark, sf).select("series", "decision_time", F.round("turnover", 6).alias("turnover"), "fee_cost", "slippage_cost", "gross", "net")
    return rounded(made, "fee_cost", "slippage_cost", "gross", "net", n=9)


@query("economic_metrics", f"""with {_ECON}, ee as (select *, 1 + sum(net) over (partition by series order by t) as e from en),
ep as (select *, greatest(1, max(e) over (partition by series order by t)) as p from ee)
select series, count(*) filter (evaluated)::bigint as evaluated_count, count(*) filter (not evaluated)::bigint as abstained_count, round(avg(net) filter (evaluated), 9) as mean_net_return,
 round(avg(net) filter (evaluated) / stddev_samp(net) filter (evaluated) * sqrt(252), 6) as net_sharpe, round(max((p - e) / p), 6) as max_drawdown, round(sum(turnover), 6) as turnover,
 round(sum(fee), 6) as fee_cost, round(sum(spread), 6) as spread_cost, round(sum(slippage), 6) as slippage_cost, round(sum(impact), 6) as impact_cost, 0::double as other_cost,
 round(sum(net), 6) as total_net_return from ep group by 1""")  # fmt: skip
def economic_metrics(spark, sf):
    made = economic.economic_metrics(_economic(spark, sf), ["series"]).drop("capacity_utilization_max")
    made = made.withColumn("mean_net_return", F.round("mean_net_return", 9))
    return rounded(made, *[c for c in made.columns if c not in ("series", "evaluated_count", "abstained_count", "mean_net_return")])


@query("capacity_utilisation", f"with {_ECON} select series, round(max(util), 6) as capacity_utilization_max, count(*)::bigint as n from en group by 1")
def capacity_utilisation(spark, sf):
    made = economic.economic_metrics(_economic(spark, sf), ["series"])
    return made.select("series", F.round("capacity_utilization_max", 6).alias("capacity_utilization_max"), (F.col("evaluated_count") + F.col("abstained_count")).alias("n"))


_U = "(('0x' || substr(md5(concat_ws('|', 'null-1', trial, t)), 1, 8))::bigint::double / 4294967296.0)"
_NULL = f"""g as (select trial, t from (select unnest(generate_series(0, 399)) as trial), (select unnest(generate_series(1, 100)) as t)),
n as (select trial, t, case when {_U} < 0.5 then -1.0::double else 1.0::double end as score from g)"""


@query("eprocess_null_calibration", f"""with {_NULL}, w as (select trial, product(1 + 0.5 * score) over (partition by trial order by t) as w from n),
k as (select trial, max(w) as peak from w group by 1), c as (select count(*) filter (peak >= 20) as x, count(*) as m from k)
select x::bigint as crossings, m::bigint as trials, round(x / m, 9) as rate from c""")  # fmt: skip
def eprocess_null_calibration(spark, sf):
    made = calibration.crossing_rate(calibration.sign_paths(spark, 400, 100, "null-1"), 0.05, 0.5)
    return made.select("crossings", "trials", F.round("rate", 9).alias("rate"))


@query("threshold_calibration", f"""with {_NULL}, s as (select trial, t, sum(abs(score + 0.3) - 1.2) over (partition by trial order by t) as s from n),
c as (select trial, t, s - least(0, min(s) over (partition by trial order by t)) as g from s), p as (select trial, max(g) as peak from c group by 1),
h as (select threshold, count(*) filter (peak >= threshold)::double as x, count(*)::double as m from p, (select unnest([0.55, 1.05, 2.05, 3.05, 4.05]) as threshold) group by 1)
select threshold::double as threshold, x::bigint as alarms, m::bigint as trials, round((x/m + 1.959963984540054^2/(2*m)) / (1 + 1.959963984540054^2/m) + 1.959963984540054 * sqrt(x/m*(1-x/m)/m + 1.959963984540054^2/(4*m*m)) / (1 + 1.959963984540054^2/m), 9) as high from h""")  # fmt: skip
def threshold_calibration(spark, sf):
    from ..operators.windows import cusum

    paths = calibration.sign_paths(spark, 400, 100, "null-1").withColumn("x", F.abs(F.col("score") + 0.3))
    made = calibration.smallest_passing(cusum(paths, "trial", "t", "x", 1.2, 1e9), [0.55, 1.05, 2.05, 3.05, 4.05], 0.2)
    return made.select("threshold", "alarms", "trials", F.round("high", 9).alias("high"))


@query("run_length_null", f"""with {_NULL}, s as (select trial, t, sum(abs(score + 0.3) - 1.2) over (partition by trial order by t) as s from n),
c as (select trial, t, s - least(0, min(s) over (partition by trial order by t)) as g from s),
f as (select trial, min(t) filter (g >= 1.05) as first from c group by 1)
select trial, coalesce(first, 100)::int as run, first is null as censored from f""")  # fmt: skip
def run_length_null(spark, sf):
    from ..operators.windows import cusum

    paths = calibration.sign_paths(spark, 400, 100, "null-1").withColumn("x", F.abs(F.col("score") + 0.3))
    return calibration.run_lengths(cusum(paths, "trial", "t", "x", 1.2, 1e9), 1.05, 100)


@query("ledger_hash_chain", """with recursive o as (select user_id, event_id, event_type, row_number() over (partition by user_id order by event_id) as k from events),
h as (select user_id, event_id, k, sha256('genesis|' || event_id || '|' || event_type) as digest from o where k = 1
 union all select o.user_id, o.event_id, o.k, sha256(h.digest || '|' || o.event_id || '|' || o.event_type) from h join o on o.user_id = h.user_id and o.k = h.k + 1)
select user_id, max(k)::bigint as records, max_by(digest, k) as head from h group by 1""")  # fmt: skip
def ledger_hash_chain(spark, sf):
    from ..plans.replay import chain_heads

    records = table(spark, sf, "events").select("user_id", "event_id", F.concat_ws("|", "event_id", "event_type").alias("payload"))
    return chain_heads(records, ["user_id"], "event_id", "payload")


@query("causal_replay", f"""with {PATH}, p as (select series, t, series || '-' || t as target_id, prediction, label from path), m as (select series, max(t) as last from path group by 1)
select series, target_id, case when t + 3 <= last then 'observed' else 'unresolved' end as status,
 case when t + 3 <= last then t + 3 end as settled_at, case when t + 3 <= last then round(-abs(prediction - label), 9) + 0 end as score from p join m using (series)""")  # fmt: skip
def causal_replay(spark, sf):
    from ..plans.replay import replay

    p = path(spark, sf).withColumn("target_id", F.concat_ws("-", "series", "t"))
    predictions = p.select("series", "target_id", F.col("t").alias("predicted_at"), "prediction")
    labels = p.select("target_id", (F.col("t") + 3).alias("available_time"), F.col("label").alias("value"))
    made = replay(predictions, labels, p.select("series", F.col("t").alias("decision_time")), ["series"])
    return made.select("series", "target_id", "status", "settled_at", (F.round("score", 9) + 0.0).alias("score"))


@query("knn_distance", """with a as (select vec_id, label || '|' || (vec_id // 500) as label, embedding as e from embeddings), d as (select a.label, a.vec_id, b.vec_id as other, list_distance(a.e::double[], b.e::double[]) as d from a join a b on a.label = b.label and a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by vec_id order by d, other) as place from d)
select vec_id, other, place::int as place, round(d, 6) as distance from k where place <= 3""")  # fmt: skip
def knn_distance(spark, sf):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values("vec_id")
        ids, points, tile = group["vec_id"].to_numpy(), np.stack(group["embedding"].to_numpy()).astype(float), group["tile"].to_numpy()
        sides, out = [np.flatnonzero(tile == t) for t in key[1:]], []
        for asking, asked in [sides] if key[1] == key[2] else [sides, sides[::-1]]:
            for i in asking:
                others = asked[ids[asked] != ids[i]]
                d = np.sqrt(((points[others] - points[i]) ** 2).sum(axis=1))
                out += [(ids[i], ids[others[j]], d[j]) for j in np.argsort(d, kind="stable")[:3]]
        return pd.DataFrame(out, columns=["vec_id", "other", "distance"])

    made = _tile_pairs(spark, sf).groupBy("cloud", "a", "b").applyInPandas(run, "vec_id long, other long, distance double")
    made = made.withColumn("place", F.row_number().over(Window.partitionBy("vec_id").orderBy("distance", "other")))
    return made.where("place <= 3").select("vec_id", "other", "place", F.round("distance", 6).alias("distance"))


#: Points that one tile of a cloud should hold; a task sees two tiles.
TILE = 1024
#: Forests of a cloud that one task merges.
MERGED = 8


def _tile_pairs(spark, sf):
    """Embeddings, one cloud per label, dealt to tiles and sent to every pair (a, b) of their cloud's: any two points meet in one.

    Clouds are named as in the SQL, whose clouds are whole labels up to 500 ids.
    """
    points = table(spark, sf, "embeddings").select(F.concat_ws("|", "label", F.lit(0)).alias("cloud"), "vec_id", "embedding", F.monotonically_increasing_id().alias("row"))
    tiles = points.groupBy("cloud").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = points.join(tiles, "cloud").withColumn("tile", F.expr("pmod(xxhash64(row), tiles)"))
    paired = dealt.withColumn("with", F.explode(F.expr("sequence(0L, tiles - 1)")))
    return paired.select("cloud", "tiles", "vec_id", "row", "embedding", "tile", F.least("tile", "with").alias("a"), F.greatest("tile", "with").alias("b"))


@query("topology_detector")
def topology_detector(spark, sf):
    return detect.topology_path(lagged(spark, sf, 1), ["event_type"], "t", topology.TopologyDetector())


@query("persistent_cusum")
def persistent_cusum(spark, sf):
    return detect.persistent_path(lagged(spark, sf, 2), ["event_type"], "t", topology.PersistentCusum(cloud=8, least=6))


_SQUARE = "m{0} as (select x.cloud, x.i, y.j, min(greatest(x.d, y.d)) as d from m{1} x join m{1} y on x.cloud = y.cloud and x.j = y.i group by all)"


@query("persistence_h0", f"""with p as (select vec_id, label || '|' || (vec_id // 500) as cloud, row_number() over (partition by label, vec_id // 500 order by vec_id) as k, embedding::double[] as e from embeddings),
m0 as (select x.cloud, x.k as i, y.k as j, list_distance(x.e, y.e) as d from p x join p y on x.cloud = y.cloud),
{", ".join(_SQUARE.format(n, n - 1) for n in range(1, 8))},
u as (select cloud, j, min(d) as death from m7 where i < j group by all)
select cloud, (row_number() over (partition by cloud order by death))::int as place, round(death, 6) as death from u""")  # fmt: skip
def persistence_h0(spark, sf):
    """A cloud's spanning tree has no edge that is not in the tree of some pair of tiles: these are merged, a few at a time."""
    edges = "cloud string, part long, i long, j long, d double"

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = group["row"].to_numpy()
        i, j, d = topology.spanning_tree(np.stack(group["embedding"].to_numpy()))
        part = key[1] * group["tiles"].iloc[0] + key[2]
        return pd.DataFrame({"cloud": key[0], "part": part, "i": rows[i], "j": rows[j], "d": d})

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kept = group.iloc[topology.spanning_forest(group["i"].to_numpy(), group["j"].to_numpy(), group["d"].to_numpy())]
        return kept.assign(part=key[1])[["cloud", "part", "i", "j", "d"]]

    pairs = _tile_pairs(spark, sf)
    parts = (pairs.agg(F.max("tiles")).first()[0] or 1) ** 2
    made = pairs.where("a < b or tiles = 1").groupBy("cloud", "a", "b").applyInPandas(run, edges)
    while parts > 1:
        made = made.groupBy("cloud", F.expr(f"part div {MERGED}").alias("part")).applyInPandas(merge, edges)
        parts = -(-parts // MERGED)
    place = F.row_number().over(Window.partitionBy("cloud").orderBy("d"))
    return made.select("cloud", place.alias("place"), F.round("d", 6).alias("death"))


@query("persistent_laplacian")
def persistent_laplacian(spark, sf):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        complex_ = topology.rips(np.stack(group.sort_values("vec_id")["embedding"].to_numpy()).astype(float), 1)
        values = topology.q_laplacian(complex_, 1, complex_.radius * 0.9)
        return pd.DataFrame({"block": group["block"].iloc[0], "place": range(len(values)), "eigenvalue": values})

    blocks = table(spark, sf, "embeddings").withColumn("block", F.expr("vec_id div 10"))
    return blocks.groupBy("block").applyInPandas(run, "block long, place int, eigenvalue double")


@query("signature_memory")
def signature_memory(spark, sf):
    rows = lagged(spark, sf, 2).withColumnRenamed("features", "increment")
    return fold(rows, ["event_type"], "t", steps.SignatureMemory(2, (1, 2)))
