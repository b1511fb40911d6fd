"""Path metrics with their exact conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import checked, finite

EPS = 2.220446049250313e-16
WILSON_Z = 1.959963984540054


def wilson(successes: Column, trials: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """95 % interval of a rate."""
    p = successes / trials
    middle = (p + z * z / (2 * trials)) / (1 + z * z / trials)
    half = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials)) / (1 + z * z / trials)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def guarded_corr(x: str, y: str, floor: float = 1e-15) -> Column:
    flat = (F.stddev_pop(x) <= floor) | (F.stddev_pop(y) <= floor) | (F.count("*") < 2)
    return F.when(flat, 0.0).otherwise(F.corr(x, y))


def masked_corr(x: str, y: str, floor: float = EPS) -> tuple[Column, Column]:
    """Correlation over the pairs of finite numbers, 0 where one of them doesn't vary; and how many finite x there are."""
    both = finite(F.col(x)) & finite(F.col(y))
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    flat = (F.count(a) < 2) | (F.stddev_pop(a) <= floor) | (F.stddev_pop(b) <= floor)
    return F.when(flat, 0.0).otherwise(F.corr(a, b)), F.count_if(finite(F.col(x)))


def sharpe(x: Column, annual: float, floor: float) -> Column:
    vol = F.stddev_samp(x)
    return F.when((F.count(x) < 2) | (vol <= floor), 0.0).otherwise(F.avg(x) / vol * F.sqrt(F.lit(annual)))


def with_path(path: DataFrame, series: str, time: str, rate: float) -> DataFrame:
    """Adds change (of position, between evaluated rows, from 0), cost, gross, net and equity (1 + running net).

    Rows that are not evaluated have no return and no cost, and leave the last live position as it is.
    """
    live = Window.partitionBy(series, "evaluated").orderBy(time)
    before = F.coalesce(F.lag("position").over(live), F.lit(0.0))
    run = Window.partitionBy(series).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    made = path.withColumn("change", F.when(F.col("evaluated"), F.abs(F.col("position") - before)).otherwise(0.0))
    made = made.withColumns({"cost": F.col("change") * rate, "gross": F.when(F.col("evaluated"), F.col("position") * F.col("ret")).otherwise(0.0)})
    made = made.withColumn("net", F.col("gross") - F.col("cost"))
    return made.withColumn("equity", 1 + F.sum("net").over(run))


def drawdowns(path: DataFrame, series: str, time: str, net: str = "net") -> DataFrame:
    """The three conventions: peak from the first equity value, peak from 1, and compounded."""
    run = Window.partitionBy(series).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    eq = path.withColumns({"__e": 1 + F.sum(net).over(run), "__c": F.product(1 + F.col(net)).over(run)})
    eq = eq.withColumns({"__p": F.max("__e").over(run), "__q": F.max("__c").over(run)})
    fall = lambda peak, e: F.when(peak > 0, (peak - e) / peak).otherwise(0.0)
    from_one = F.greatest(F.lit(1.0), F.col("__p"))
    return eq.groupBy(series).agg(
        F.max(fall(F.col("__p"), F.col("__e"))).alias("from_first"),
        F.greatest(F.lit(0.0), F.max(fall(from_one, F.col("__e")))).alias("from_one"),
        F.max(fall(F.col("__q"), F.col("__c"))).alias("compounded"),
    )


def bundle(path: DataFrame, series: str, time: str, rate: float, annual: float = 252.0) -> DataFrame:
    """The metrics of a backtest's path, one aggregation per series."""
    made = with_path(path, series, time, rate)
    run = Window.partitionBy(series).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    made = made.withColumn("peak", F.max("equity").over(run))
    seen = F.when(F.col("evaluated"), F.col("net"))
    hit = (F.signum("prediction") == F.signum("label")).cast("double")
    predicted = F.col("evaluated") & finite(F.col("prediction"))
    ok = predicted & finite(F.col("label"))
    p, y = F.when(ok, F.col("prediction")), F.when(ok, F.col("label"))
    flat = (F.stddev_pop(p) <= EPS) | (F.stddev_pop(y) <= EPS) | (F.count(p) < 2)
    return made.groupBy(series).agg(
        F.count("*").alias("n_observations"),
        F.count_if("evaluated").alias("n_evaluated"),
        F.count_if(predicted).alias("n_predictions"),
        F.sum("gross").alias("gross_return"),
        F.sum("net").alias("net_return"),
        F.sum("cost").alias("total_cost"),
        F.sum("change").alias("turnover"),
        (F.sum("change") / F.greatest(F.lit(1), F.count_if("evaluated"))).alias("average_turnover"),
        sharpe(seen, annual, EPS).alias("sharpe"),
        F.max(F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(0.0)).alias("max_drawdown"),
        F.when(flat, 0.0).otherwise(F.corr(p, y)).alias("information_coefficient"),
        F.coalesce(F.avg(F.when(ok, hit)), F.lit(0.0)).alias("hit_rate"),
    )


def annualised(net: Column, annual: float = 252.0) -> Column:
    """Yearly growth of compounded returns."""
    return F.pow(F.product(1 + net), F.lit(annual) / F.count(net)) - 1


def tail(path: DataFrame, series: str, time: str, rows: int) -> DataFrame:
    """The last rows of each series, for metrics of its end."""
    back = Window.partitionBy(series).orderBy(F.col(time).desc())
    return path.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= rows).drop("__back")


def online_bundle(path: DataFrame, series: str, time: str, rate: float, annual: float = 252.0, alarm: str | None = None) -> DataFrame:
    """The metrics of a recursive run: every row counts, turnover is the mean change with the entry from 0.

    With an alarm column and a regime also the mean delay of alarms after the changes of regime, censored where the next
    one or the path's end comes first, and the alarms before the first change (null without one).
    """
    made = with_path(path.withColumn("evaluated", F.lit(True)), series, time, rate)
    falls = drawdowns(made, series, time).select(series, F.col("from_first").alias("max_drawdown"))
    out = made.groupBy(series).agg(
        F.avg((F.col("prediction") - F.col("label")) ** 2).alias("mse"),
        guarded_corr("prediction", "label").alias("information_coefficient"),
        F.avg("net").alias("mean_net_return"),
        sharpe(F.col("net"), annual, 1e-15).alias("net_sharpe"),
        F.avg("change").alias("turnover"),
    ).join(falls, series)
    if alarm is None:
        return out
    changes = change_points(path, series, time)
    delays = alarm_delays(path, changes, series, time, alarm).groupBy(series).agg(F.avg("alarm_delay").alias("mean_detection_delay"))
    return out.join(delays, series, "left").join(false_alarms(path, changes, series, time, alarm), series, "left")


def alarm_delays(path: DataFrame, changes: DataFrame, series: str, time: str, alarm: str) -> DataFrame:
    """Rows from each change to the first alarm before the next change; the length of that stretch if there is none."""
    order = Window.partitionBy(series).orderBy("cp")
    ends = path.groupBy(series).agg((F.max(time) + 1).alias("__end"))
    stops = changes.join(ends, series).withColumn("__stop", F.coalesce(F.lead("cp").over(order), "__end")).select(series, "cp", "__stop")
    first = _first_after(changes, path.where(F.col(alarm)).select(series, time), series, time, "alarm_delay")
    length = F.col("__stop") - F.col("cp")
    return stops.join(first, [series, "cp"]).select(series, "cp", F.least(F.coalesce("alarm_delay", length), length).alias("alarm_delay"))


def false_alarms(path: DataFrame, changes: DataFrame, series: str, time: str, alarm: str) -> DataFrame:
    """Alarms before the first change of each series that has one."""
    first = changes.groupBy(series).agg(F.min("cp").alias("__first"))
    return path.join(first, series).groupBy(series).agg(F.count_if(F.col(alarm) & (F.col(time) < F.col("__first"))).alias("false_alarm_count"))


def comparator(path: DataFrame, series: str, time: str, rate: float, expected: str | None = None) -> DataFrame:
    """Gaps to an optimal position that pays for its own turnover: legacy, absolute, one-sided regret.

    Both sides are valued at the expected returns if there is such a column, else at the realised ones; the legacy gap always sets the
    comparator's gross against the realised net.
    """
    basis = expected or "ret"
    made = with_path(path, series, time, rate)
    valued = made if expected is None else with_path(path.withColumn("ret", F.col(basis)), series, time, rate)
    best = with_path(path.withColumns({"position": F.col("optimal"), "ret": F.col(basis)}), series, time, rate)
    both = made.select(series, time, "evaluated", F.col("net").alias("realised_net")).join(
        valued.select(series, time, "net"), [series, time]
    ).join(best.select(series, time, F.col("gross").alias("best_gross"), F.col("net").alias("best_net")), [series, time])
    gap = F.col("best_net") - F.col("net")
    return both.groupBy(series).agg(
        F.sum(F.when(F.col("evaluated"), F.col("best_gross") - F.col("realised_net")).otherwise(0.0)).alias("legacy_gap"),
        F.sum(F.when(F.col("evaluated"), F.abs(gap)).otherwise(0.0)).alias("absolute_discrepancy"),
        F.sum(F.when(F.col("evaluated"), F.greatest(gap, F.lit(0.0))).otherwise(0.0)).alias("one_sided_regret"),
    )


def full_bundle(
    path: DataFrame, series: str, time: str, rate: float, baselines: tuple[DataFrame, ...] = (), persistence: int = 3, annual: float = 252.0, expected: str | None = None
) -> DataFrame:
    """All metrics of a path: the bundle, regrets in total and a row, delays by change point in order, and how often a baseline was beaten too early.

    baselines: the same rows with other positions.
    """
    made, changes = with_path(path, series, time, rate), change_points(path, series, time)
    listed = lambda df, c: df.groupBy(series).agg(F.transform(F.array_sort(F.collect_list(F.struct("cp", c))), lambda r: r[c]).alias(f"{c}s"))
    regrets = comparator(path, series, time, rate, expected)
    out = bundle(path, series, time, rate, annual).join(regrets, series)
    live = F.greatest(F.lit(1), F.col("n_evaluated"))
    out = out.withColumns({f"mean_step_{c}": F.col(c) / live for c in ("legacy_gap", "absolute_discrepancy", "one_sided_regret")})
    out = out.join(listed(detection_delays(path, changes, series, time, persistence), "detection_delay"), series, "left")
    out = out.join(listed(recovery_delays(made, changes, series, time), "recovery_delay"), series, "left")
    none = F.array().cast("array<bigint>")
    out = out.withColumns({c: F.coalesce(F.col(c).cast("array<bigint>"), none) for c in ("detection_delays", "recovery_delays")})
    beaten = [against_baseline(made, with_path(b, series, time, rate), series, time).select(series, F.col("false_promotion").cast("long").alias("__f")) for b in baselines]
    if not beaten:
        return out.withColumns({"false_promotions": F.lit(0).cast("long"), "baseline_comparisons": F.lit(0).cast("long")})
    every = beaten[0]
    for b in beaten[1:]:
        every = every.unionByName(b)
    return out.join(every.groupBy(series).agg(F.sum("__f").alias("false_promotions"), F.count("*").alias("baseline_comparisons")), series)


def change_points(path: DataFrame, series: str, time: str, regime: str = "regime") -> DataFrame:
    order = Window.partitionBy(series).orderBy(time)
    return path.withColumn("__r", F.lag(regime).over(order)).where(F.col("__r").isNotNull() & (F.col(regime) != F.col("__r"))).select(series, F.col(time).alias("cp"))


def detection_delays(path: DataFrame, changes: DataFrame, series: str, time: str, persistence: int, threshold: float = 0.0) -> DataFrame:
    """Rows from each change to the first of ``persistence`` evaluated rows that stand on the right side; null if none."""
    ahead = Window.partitionBy(series).orderBy(time).rowsBetween(0, persistence - 1)
    right = F.col("evaluated") & F.coalesce(F.col("position") * F.col("optimal") > threshold, F.lit(False))
    starts = path.withColumn("__k", F.sum(right.cast("int")).over(ahead)).where(F.col("__k") == persistence).select(series, time)
    return _first_after(changes, starts, series, time, "detection_delay")


def _first_after(changes: DataFrame, hits: DataFrame, series: str, time: str, name: str) -> DataFrame:
    """For each change the delay to the first hit at or after it: one sort of both together instead of a range join."""
    both = changes.select(series, F.col("cp").alias(time), F.lit(True).alias("is_cp")).unionByName(hits.select(series, time, F.lit(False).alias("is_cp")))
    after = Window.partitionBy(series).orderBy(time).rangeBetween(0, Window.unboundedFollowing)
    first = F.min(F.when(~F.col("is_cp"), F.col(time))).over(after)
    return both.withColumn("first", first).where("is_cp").select(series, F.col(time).alias("cp"), (F.col("first") - F.col(time)).alias(name))


def recovery_delays(made: DataFrame, changes: DataFrame, series: str, time: str) -> DataFrame:
    """Rows from each change until equity is back at the peak before it; null if never.

    Until it is back, that peak is the running maximum of all rows before, so a recovery is the first row from the change on that
    reaches the maximum before itself: a flag and a look ahead, no join of changes with rows.
    """
    before = Window.partitionBy(series).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    back = made.withColumn("__peak", F.max("equity").over(before)).where("equity >= __peak").select(series, time)
    return _first_after(changes, back, series, time, "recovery_delay")


def against_baseline(candidate: DataFrame, baseline: DataFrame, series: str, time: str, least: float = 0.0, window: int | None = None, rule=None) -> DataFrame:
    """Sums of both over the first ``window`` common evaluated rows (half of them unless given) and over the rest; promotion and false promotion.

    Both must have the same rows. rule: what promotes instead of an early excess of more than ``least``, a condition on the returned columns.
    """
    side = lambda df, c: df.select(series, time, F.col("evaluated").alias(f"__{c}"), F.col("net").alias(c))
    both = side(candidate, "c").join(side(baseline, "b"), [series, time], "full")
    both = checked(both, {"candidate and baseline have different rows": F.col("__c").isNotNull() & F.col("__b").isNotNull()}).where("__c and __b")
    whole = Window.partitionBy(series)
    rows = F.count("*").over(whole)
    early_rows = F.greatest(F.lit(1), F.floor(rows / 2) if window is None else F.least(F.lit(window), rows))
    both = both.withColumns({"nth": F.row_number().over(whole.orderBy(time)), "half": early_rows})
    part = lambda x, early: F.coalesce(F.sum(F.when((F.col("nth") <= F.col("half")) == early, F.col(x))), F.lit(0.0))
    sums = both.groupBy(series).agg(
        F.sum("c").alias("candidate_return"), F.sum("b").alias("baseline_return"),
        part("c", True).alias("early_candidate"), part("b", True).alias("early_baseline"),
        part("c", False).alias("later_candidate"), part("b", False).alias("later_baseline"),
        F.count_if(F.col("nth") > F.col("half")).alias("later"),
    )
    promoted = rule if rule is not None else F.col("early_candidate") > F.col("early_baseline") + least
    false = F.col("promoted") & (F.col("later") > 0) & (F.col("later_candidate") < F.col("later_baseline") - least)
    return sums.withColumn("promoted", promoted).withColumn("false_promotion", false).drop("later")
