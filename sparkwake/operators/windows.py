"""Rolling features over strictly-prior frames, all as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def along(series: str, time: str) -> WindowSpec:
    return Window.partitionBy(series).orderBy(time)


def difference(x: Column, order: WindowSpec) -> Column:
    """First row 0, then x minus its predecessor."""
    return F.coalesce(x - F.lag(x).over(order), F.lit(0.0))


def delay_embedding(x: Column, order: WindowSpec, dimension: int, lag: int = 1) -> Column:
    """Point of the last ``dimension`` values, oldest first; null until they exist."""
    parts = [F.lag(x, k * lag).over(order) if k else x for k in range(dimension - 1, -1, -1)]
    return F.when(parts[0].isNotNull(), F.array(*parts))


def rolling_cloud(points: Column, order: WindowSpec, size: int, stride: int = 1) -> Column:
    """The last ``size`` points, every ``stride``-th row back from the current one, oldest first."""
    held = F.collect_list(points).over(order.rowsBetween(-(size - 1) * stride, 0))
    return F.filter(held, lambda p, i: (F.size(held) - 1 - i) % stride == 0)


def prior_mean(x: Column, order: WindowSpec, length: int) -> Column:
    """Mean of the ``length`` rows before the current one, null while there are fewer."""
    frame = order.rowsBetween(-length, -1)
    return F.when(F.count(x).over(frame) == length, F.avg(x).over(frame))


def momentum(price: Column, order: WindowSpec, lookback: int, skip: int) -> Column:
    return F.lag(price, skip).over(order) / F.lag(price, lookback).over(order) - 1


def prior_volatility(ret: Column, order: WindowSpec, length: int) -> Column:
    frame = order.rowsBetween(-length, -1)
    return F.when(F.count(ret).over(frame) == length, F.stddev_samp(ret).over(frame))


def robust_scale(df: DataFrame, series: str, value: str, floor: float = 1e-12) -> DataFrame:
    """Median and scale max(1.4826 MAD, IQR / 1.3489795, floor) of each series; exact percentiles, two passes."""
    centre = df.groupBy(series).agg(F.percentile(value, F.lit(0.5)).alias("location"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"))
    spread = df.join(centre, series).groupBy(series).agg(
        F.first("location").alias("location"), F.first("iqr").alias("iqr"), F.percentile(F.abs(F.col(value) - F.col("location")), F.lit(0.5)).alias("mad")
    )
    return spread.select(series, "location", F.greatest(1.4826 * F.col("mad"), F.col("iqr") / 1.3489795, F.lit(floor)).alias("scale"))


def mad_scale(df: DataFrame, series: str, value: str, floor: float) -> DataFrame:
    """Median and scale max(1.4826 MAD, floor) of each series."""
    centre = df.groupBy(series).agg(F.percentile(value, F.lit(0.5)).alias("location"))
    off = df.join(centre, series).groupBy(series).agg(F.first("location").alias("location"), F.percentile(F.abs(F.col(value) - F.col("location")), F.lit(0.5)).alias("mad"))
    return off.select(series, "location", F.greatest(1.4826 * F.col("mad"), F.lit(floor)).alias("scale"))


def prior_robust_z(x: Column, order: WindowSpec, length: int, least: int, floor: float = 1e-12) -> Column:
    """Distance from the prior median in prior IQR scales; null before ``least`` prior rows."""
    frame = order.rowsBetween(-length, -1)
    low, mid, high = (F.percentile(x, F.lit(p)).over(frame) for p in (0.25, 0.5, 0.75))
    return F.when(F.count(x).over(frame) >= least, (x - mid) / F.greatest((high - low) / 1.3489795, F.lit(floor)))


def block_mean_shift(x: Column, order: WindowSpec, width: int, floor: float = 1e-6) -> Column:
    """|mean of the last block - mean of the one before| in standard deviations of the one before; null until both are full."""
    current, before = order.rowsBetween(-width + 1, 0), order.rowsBetween(-2 * width + 1, -width)
    gap = F.abs(F.avg(x).over(current) - F.avg(x).over(before))
    return F.when(F.count(x).over(before) == width, gap / F.greatest(F.stddev_samp(x).over(before), F.lit(floor)))


def cusum(df: DataFrame, series: str, time: str, x: str, drift: float, threshold: float, valid: Column | None = None) -> DataFrame:
    """g = max(0, g + x - drift), reset to 0 on invalid rows, in closed form: the running sum less its running minimum.

    Each run of valid rows is an island of its own, so no row-by-row fold is needed.
    """
    order = along(series, time)
    ok = F.coalesce(valid, F.lit(False)) if valid is not None else F.lit(True)
    marked = df.withColumn("__ok", ok).withColumn("__island", F.sum((~F.col("__ok")).cast("long")).over(order))
    inside = Window.partitionBy(series, "__island").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    summed = marked.withColumn("__s", F.sum(F.when(F.col("__ok"), F.col(x) - drift).otherwise(0.0)).over(inside))
    g = F.when(F.col("__ok"), F.col("__s") - F.least(F.lit(0.0), F.min("__s").over(inside))).otherwise(0.0)
    return summed.withColumn("g", g).withColumn("alarm", F.col("__ok") & (F.col("g") >= threshold)).drop("__ok", "__island", "__s")


def decaying_cusum(df: DataFrame, series: str, time: str, x: str, drift: float, threshold: float, decay: float) -> DataFrame:
    """g = max(0, decay * g + x - drift), folded row by row: with decay there is no closed form."""
    from ..functions.steps import Cusum
    from .folds import fold

    rows = df.select(series, time, F.col(x).alias("x"))
    return rows.withColumnRenamed("x", x).join(fold(rows, [series], time, Cusum(drift, threshold, decay)), [series, time])


def price_features(prices: DataFrame, series: str, time: str, price: str, scale: float = 1.0) -> DataFrame:
    """One- and five-row returns, volatility of the last 20 one-row returns, and the next return over ``scale`` as the label; rows where any is unknown go."""
    order = along(series, time)
    made = prices.withColumn("ret_1", F.col(price) / F.lag(price).over(order) - 1)
    frame = order.rowsBetween(-19, 0)
    made = made.withColumns({
        "ret_5": F.col(price) / F.lag(price, 5).over(order) - 1,
        "vol_20": F.when(F.count("ret_1").over(frame) == 20, F.stddev_samp("ret_1").over(frame)),
        "label": (F.lead(price).over(order) / F.col(price) - 1) / scale,
    })
    return made.where("ret_5 is not null and vol_20 is not null and label is not null")


def panel_features(prices: DataFrame, series: str, time: str, price: str, scale: float = 1.0) -> DataFrame:
    """price_features of names that share their rows, with one label for all: the mean of their next returns over ``scale``."""
    made = price_features(prices, series, time, price, 1.0)
    return made.withColumn("label", F.avg("label").over(Window.partitionBy(time)) / scale)


def split_zscore(df: DataFrame, series: str, time: str, value: str, rows: int, floor: float = 1e-12) -> DataFrame:
    """z of all rows by the mean and deviation of each series' first ``rows`` rows alone, so nothing later reaches the fit."""
    first = df.withColumn("__n", F.row_number().over(along(series, time))).where(F.col("__n") <= rows)
    fitted = first.groupBy(series).agg(F.avg(value).alias("__m"), F.greatest(F.stddev_samp(value), F.lit(floor)).alias("__s"))
    return df.join(fitted, series).withColumn("z", (F.col(value) - F.col("__m")) / F.col("__s")).drop("__m", "__s")
