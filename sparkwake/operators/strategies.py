"""Trend and momentum strategies over price panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import checked, finite
from ..sources.feeds import not_in_ledger
from .metrics import annualised, sharpe

def trend_pnl(prices: DataFrame, lookbacks: list[int], series: str = "series", time: str = "t") -> DataFrame:
    """Return of each row under each lookback: long if yesterday's price stood above the mean of the days before it.

    All lookbacks are columns of one pass over the series; the grid is unpivoted afterwards.
    """
    order = Window.partitionBy(series).orderBy(time)
    previous = F.lag("price").over(order)
    made = {}
    for n in lookbacks:
        frame = order.rowsBetween(-n - 1, -2)
        mean = F.when(F.count("price").over(frame) == n, F.avg("price").over(frame))
        made[f"pnl_{n}"] = F.when(previous > mean, F.col("ret")).otherwise(0.0)
    wide = prices.withColumns(made)
    entries = F.array(*[F.struct(F.lit(n).alias("lookback"), F.col(f"pnl_{n}").alias("pnl")) for n in lookbacks])
    return wide.select(series, time, "d", F.explode(entries).alias("g")).select(series, time, "d", "g.lookback", "g.pnl")


def annual_refit(prices: DataFrame, lookbacks: list[int], series: str = "series", time: str = "t") -> DataFrame:
    """Each year trades the lookback that did best in the years before it; ties to the shorter."""
    yearly = trend_pnl(prices, lookbacks, series, time).groupBy(series, F.year("d").alias("year"), "lookback").agg(F.sum("pnl").alias("pnl"))
    past = F.sum("pnl").over(Window.partitionBy(series, "lookback").orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    best = Window.partitionBy(series, "year").orderBy(F.desc("past"), "lookback")
    ranked = yearly.withColumn("past", past).where("past is not null").withColumn("k", F.row_number().over(best))
    return ranked.where("k = 1").select(series, "year", "lookback", "pnl")


def inverse_vol_weights(ranked: DataFrame, date: str, vol: str, k: int, target: float) -> DataFrame:
    """Weights of a date's k best names by inverse volatility, scaled to a volatility target of at most full investment."""
    held = ranked.where(F.col("place") <= k).withColumn("inv", 1 / F.greatest(F.col(vol), F.lit(1e-9)))
    whole = Window.partitionBy(date)
    share = F.col("inv") / F.sum("inv").over(whole)
    weighed = held.withColumn("share", share).withColumn("risk", F.sqrt(F.sum(F.pow(F.col("share") * F.col(vol), 2)).over(whole)))
    return weighed.withColumn("weight", F.col("share") * F.least(F.lit(1.0), target / F.greatest("risk", F.lit(1e-9)))).drop("inv", "share", "risk")


def hold_between(weights: DataFrame, keys: list[str], time: str, every: int, weight: str = "weight") -> DataFrame:
    """Weights move on every ``every``-th row only and are held in between; before the first they are 0."""
    order = Window.partitionBy(*keys).orderBy(time)
    fresh = F.when((F.row_number().over(order) - 1) % every == 0, F.coalesce(F.col(weight), F.lit(0.0)))
    made = weights.withColumn("__fresh", fresh)
    held = F.last("__fresh", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return made.withColumn(weight, held).drop("__fresh")


def grid_best(scores: DataFrame, params: list[str], score: str, tie: list, keys: list[str] | None = None) -> DataFrame:
    """The parameters with the highest score, per key if any; ties by the given columns."""
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc(score), *tie)
    return scores.withColumn("__k", F.row_number().over(order)).where("__k = 1").select(*(keys or []), *params, score)


def momentum_portfolio(
    panel: DataFrame, k: int, lookback: int, skip: int, window: int, target: float, every: int, least: float = 0.0,
    series: str = "series", time: str = "t", price: str = "price", annual: float = 252.0,
) -> DataFrame:
    """Weights of a momentum portfolio over names that share all rows (time counts from 0).

    On every ``every``-th row, from the first on which all is known, the k names with the highest momentum above ``least`` are held by inverse
    volatility, scaled down to a volatility target and never up; in between nothing moves. Ties go to the smaller name; the last row has no
    position, as nothing follows it.
    """
    order = Window.partitionBy(series).orderBy(time)
    ret = F.col(price) / F.lag(price).over(order) - 1
    start = max(lookback, window + 1, skip + 1)
    made = panel.select(series, time, price).withColumns({
        "ret": ret, "momentum": F.lag(price, skip).over(order) / F.lag(price, lookback).over(order) - 1, "last": F.lead(time).over(order).isNull(),
    })
    made = made.withColumn("vol", F.stddev_samp("ret").over(order.rowsBetween(-window + 1, 0)))
    fresh = (F.col(time) >= start) & ((F.col(time) - start) % every == 0) & ~F.col("last")
    at, eligible = Window.partitionBy(time), fresh & (F.col("momentum") > least)
    made = made.withColumn("place", F.row_number().over(at.orderBy(F.when(eligible, F.col("momentum")).desc_nulls_last(), series)))
    made = made.withColumn("inverse", F.when(eligible & (F.col("place") <= k), 1 / F.greatest(F.col("vol") * F.sqrt(F.lit(annual)), F.lit(1e-6))))
    made = made.withColumn("share", F.col("inverse") / F.sum("inverse").over(at))
    made = made.withColumn("risk", F.sqrt(F.sum((F.col("share") * F.col("vol")) ** 2).over(at)) * F.sqrt(F.lit(annual)))
    scaled = F.coalesce(F.col("share") * F.least(F.lit(1.0), target / F.greatest("risk", F.lit(1e-8))), F.lit(0.0))
    made = made.withColumn("fresh", F.when(fresh, scaled))
    held = F.coalesce(F.last("fresh", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return made.withColumn("weight", F.when(F.col("last"), 0.0).otherwise(held)).select(series, time, "weight")


def fixed_trend(prices: DataFrame, lookback: int, costs: list[float], series: str = "series", time: str = "t", price: str = "price") -> DataFrame:
    """Net return of each row under each cost (basis points of turnover): long over the next row while the price stands above its trailing mean.

    All costs come from one pass over the series. The last row has no next one and is left out.
    """
    order = Window.partitionBy(series).orderBy(time)
    frame = order.rowsBetween(-lookback, -1)
    mean = F.when(F.count(price).over(frame) == lookback, F.avg(price).over(frame))
    made = prices.withColumns({"position": F.coalesce((F.col(price) > mean).cast("double"), F.lit(0.0)), "realised": F.lead(price).over(order) / F.col(price) - 1})
    made = made.withColumn("moved", F.abs(F.col("position") - F.coalesce(F.lag("position").over(order), F.lit(0.0)))).where("realised is not null")
    grid = F.explode(F.array(*[F.lit(float(c)) for c in costs])).alias("bps")
    return made.select(series, time, "position", "realised", "moved", grid).withColumn("net", F.col("position") * F.col("realised") - F.col("bps") / 1e4 * F.col("moved"))


def select_on_training(
    prices: DataFrame, lookbacks: list[int], cost: float, until, series: str = "series", time: str = "t", price: str = "price", annual: float = 252.0
) -> DataFrame:
    """The lookback of fixed_trend that does best on the rows up to ``until`` alone: by Sharpe ratio, then growth, then the smaller drawdown, then the shorter."""
    each = None
    for n in lookbacks:
        one = fixed_trend(prices, n, [cost], series, time, price).where(F.col(time) <= until).withColumn("lookback", F.lit(n))
        each = one if each is None else each.unionByName(one)
    run = Window.partitionBy(series, "lookback").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    grown = each.withColumn("__g", F.product(1 + F.col("net")).over(run)).withColumn("__p", F.max("__g").over(run))
    scored = grown.groupBy(series, "lookback").agg(
        sharpe(F.col("net"), annual, 1e-15).alias("sharpe"), annualised(F.col("net"), annual).alias("growth"), F.max(1 - F.col("__g") / F.col("__p")).alias("drawdown")
    )
    best = Window.partitionBy(series).orderBy(F.desc("sharpe"), F.desc("growth"), "drawdown", "lookback")
    return scored.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")


def guarded_signal(prices: DataFrame, lookback: int, today, stale_days: int, series: str = "series", date: str = "d", price: str = "price", strict: bool = True) -> DataFrame:
    """The signal after each series' last row: risk on while its price stands above the mean of the rows before.

    A series whose last row is too old, or whose last prices are not all positive numbers, gets none: an error if strict, else a reason.
    """
    back = Window.partitionBy(series).orderBy(F.col(date).desc())
    held = prices.withColumn("__k", F.row_number().over(back)).where(F.col("__k") <= lookback + 1)
    bad = F.coalesce(~finite(F.col(price)) | (F.col(price) <= 0), F.lit(True))
    made = held.groupBy(series).agg(
        F.max(date).alias("signal_date"), F.max(F.when(F.col("__k") == 1, F.col(price))).alias("last_price"), F.avg(F.when(F.col("__k") > 1, F.col(price))).alias("trailing"),
        F.count("*").alias("__n"), F.max(bad.cast("int")).alias("__bad"),
    )
    made = made.withColumn("age", F.datediff(F.lit(today), F.col("signal_date")))
    reason = F.when(F.col("age") > stale_days, "stale").when(F.col("__n") <= lookback, "too short").when(F.col("__bad") == 1, "invalid price")
    made = made.withColumn("reason", reason)
    if strict:
        made = checked(made, {"signal rejected": F.col("reason").isNull()})
    return made.select(series, "signal_date", "age", F.when(F.col("reason").isNull(), F.col("last_price") > F.col("trailing")).alias("risk_on"), "reason")


def settle_signals(signals: DataFrame, settled: DataFrame, prices: DataFrame, series: str = "series", date: str = "d", price: str = "price", cost: float = 0.0005) -> DataFrame:
    """Settlements of the signals (series, date) that have none yet and whose next price is known; each is charged the cost, whatever it moved."""
    order = Window.partitionBy(series).orderBy(date)
    nexts = prices.select(series, date, F.lead(date).over(order).alias("realised_on"), (F.lead(price).over(order) / F.col(price) - 1).alias("gross"))
    open_ = not_in_ledger(signals, settled, [series, date])
    return open_.join(nexts, [series, date]).where("gross is not null").select(series, date, "realised_on", "gross", (F.col("gross") - cost).alias("net"))
