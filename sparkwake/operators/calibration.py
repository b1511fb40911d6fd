"""Monte-Carlo calibration: trials are rows, each with its own seed, so they run anywhere in any order."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import checked
from .evidence import slot_alpha
from .folds import fold
from .metrics import wilson


def uniform(*parts) -> F.Column:
    """A number in [0, 1) from a hash of the parts, the same in any engine with md5: reproducible trials without a generator's state."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / 4294967296.0


def sign_paths(spark: SparkSession, trials: int, horizon: int, seed: str) -> DataFrame:
    """trial, t, score: fair signs, the null of a bounded score."""
    grid = spark.range(trials).withColumnRenamed("id", "trial").select("trial", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("t"))
    return grid.withColumn("score", F.when(uniform(F.lit(seed), "trial", "t") < 0.5, -1.0).otherwise(1.0))


def crossing_rate(paths: DataFrame, alpha: float, eta: float) -> DataFrame:
    """How many null wealth processes ever reach 1 / alpha, with its interval."""
    run = Window.partitionBy("trial").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    peaks = paths.withColumn("w", F.product(1 + eta * F.col("score")).over(run)).groupBy("trial").agg(F.max("w").alias("peak"))
    counted = peaks.agg(F.count_if(F.col("peak") >= 1 / alpha).alias("crossings"), F.count("*").alias("trials"))
    low, high = wilson(F.col("crossings").cast("double"), F.col("trials").cast("double"))
    return counted.select("crossings", "trials", (F.col("crossings") / F.col("trials")).alias("rate"), low.alias("low"), high.alias("high"))


def run_lengths(scored: DataFrame, threshold: float, horizon: int) -> DataFrame:
    """Per trial the first alarm, censored at the horizon."""
    first = scored.groupBy("trial").agg(F.min(F.when(F.col("g") >= threshold, F.col("t"))).alias("first"))
    return first.select("trial", F.coalesce("first", F.lit(horizon)).alias("run"), F.col("first").isNull().alias("censored"))


def smallest_passing(scored: DataFrame, thresholds: list[float], most: float) -> DataFrame:
    """False-alarm rate and interval of each threshold, from each trial's highest score; passed if the interval's end stays below ``most``."""
    peaks = scored.groupBy("trial").agg(F.max("g").alias("peak"))
    each = peaks.select("peak", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    counted = each.groupBy("threshold").agg(F.count_if(F.col("peak") >= F.col("threshold")).alias("alarms"), F.count("*").alias("trials"))
    low, high = wilson(F.col("alarms").cast("double"), F.col("trials").cast("double"))
    return counted.withColumns({"rate": F.col("alarms") / F.col("trials"), "low": low, "high": high}).withColumn("passed", F.col("high") <= most)


def choose_threshold(calibration: DataFrame, evaluation: DataFrame, thresholds: list[float], most: float) -> DataFrame:
    """The smallest threshold that passes on one split, and how it does on another: only the other split can approve it.

    Both: trial, t, g. None passing is an error. Returns threshold, calibration_alarms, evaluation_alarms, evaluation_rate, evaluation_high, approved.
    """
    tried, tested = smallest_passing(calibration, thresholds, most), smallest_passing(evaluation, thresholds, most)
    first = tried.where("passed").agg(F.min_by(F.struct("threshold", "alarms"), "threshold").alias("c"))
    first = checked(first, {"no threshold keeps within the rate allowed": F.col("c").isNotNull()}).select("c.threshold", F.col("c.alarms").alias("calibration_alarms"))
    found = tested.select("threshold", F.col("alarms").alias("evaluation_alarms"), F.col("rate").alias("evaluation_rate"), F.col("high").alias("evaluation_high"), F.col("passed").alias("approved"))
    return first.join(found, "threshold")


def shift_power(scored: DataFrame, threshold: float, horizon: int, shift: int) -> DataFrame:
    """How often, and how soon, a shift at step ``shift`` (from 0) is found; a delay that reaches the horizon counts as none.

    scored: trial, t (from 1), g. Returns trials, detections, rate and its interval, mean delay with the censored ones at their limit, censored share.
    """
    limit = horizon - shift
    hit = F.min(F.when((F.col("t") > shift) & (F.col("g") >= threshold), F.col("t") - 1 - shift))
    delays = scored.groupBy("trial").agg(F.coalesce(hit, F.lit(limit)).alias("delay"))
    counted = delays.agg(F.count("*").alias("trials"), F.count_if(F.col("delay") < limit).alias("detections"), F.avg("delay").alias("mean_delay"))
    low, high = wilson(F.col("detections").cast("double"), F.col("trials").cast("double"))
    rate = F.col("detections") / F.col("trials")
    return counted.select("trials", "detections", rate.alias("rate"), low.alias("low"), high.alias("high"), "mean_delay", (1 - rate).alias("censored"))


def family_null(paths: DataFrame, share: Column, eta: float) -> DataFrame:
    """Optional stopping over a family of processes: each trial ends at the first crossing of any of them, ties to the smaller cell.

    paths: trial, t, cell, score; share: each cell's part of the level, an expression on cell. Returns trials, crossings, rate, low, high.
    """
    run = Window.partitionBy("trial", "cell").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    wealthy = paths.withColumn("w", F.product(1 + eta * F.col("score")).over(run))
    first = wealthy.groupBy("trial").agg(F.min(F.when(F.col("w") >= 1 / share, F.struct("t", "cell"))).alias("first"))
    counted = first.agg(F.count("*").alias("trials"), F.count("first").alias("crossings"))
    low, high = wilson(F.col("crossings").cast("double"), F.col("trials").cast("double"))
    return counted.select("trials", "crossings", (F.col("crossings") / F.col("trials")).alias("rate"), low.alias("low"), high.alias("high"))


def selection_null(paths: DataFrame, alpha: float, cells: int, eta: float) -> DataFrame:
    """family_null with equal shares."""
    return family_null(paths, F.lit(alpha / cells), eta)


def promotion_null(paths: DataFrame, alpha: float, eta: float) -> DataFrame:
    """family_null with the halving shares of a gate's first epoch; cells count from 0 in the order of registration."""
    return family_null(paths, slot_alpha(alpha, F.col("cell") + 1, F.lit(0)), eta)


def detector_null(paths: DataFrame, detector, horizon: int) -> DataFrame:
    """A detector's false alarms on null paths (trial, t and what it reads): mean run to the first alarm, and its rate with an interval."""
    first = fold(paths, ["trial"], "t", detector).groupBy("trial").agg(F.min(F.when(F.col("alarm"), F.col("t"))).alias("first"))
    counted = first.agg(F.count("*").alias("trials"), F.count("first").alias("alarms"), F.avg(F.coalesce("first", F.lit(horizon))).alias("mean_run"))
    low, high = wilson(F.col("alarms").cast("double"), F.col("trials").cast("double"))
    return counted.select("trials", "alarms", "mean_run", low.alias("low"), high.alias("high"))


def bootstrap_places(spark: SparkSession, draws: int, n: int, length: int, mean_block: float, seed: str) -> DataFrame:
    """draw, k, place: circular stationary bootstraps of n rows, runs of geometric length; every draw and step has its own hash."""
    grid = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("k"))
    fresh = (F.col("k") == 0) | (uniform(F.lit(seed), F.lit("restart"), "draw", "k") < 1 / mean_block)
    start = F.floor(uniform(F.lit(seed), F.lit("start"), "draw", "k") * n)
    run = Window.partitionBy("draw").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(fresh, F.struct(F.col("k").alias("at"), start.alias("from"))), ignorenulls=True).over(run)
    return grid.withColumn("b", begun).select("draw", "k", ((F.col("b.from") + F.col("k") - F.col("b.at")) % n).alias("place"))


def monte_carlo(spark: SparkSession, trials: int, simulate, schema: str, seed: int = 0, at_once: int = 64) -> DataFrame:
    """simulate(rng, trial) -> list of rows, with a generator of its own for each trial: the same rows however they are dealt."""

    def run(batches):
        for batch in batches:
            rows = [row for trial in batch["id"] for row in simulate(np.random.default_rng([seed, int(trial)]), int(trial))]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in schema.split(", ")])

    return spark.range(0, trials, 1, max(1, trials // at_once)).mapInPandas(run, schema)


def block_bootstrap(rng: np.random.Generator, n: int, length: int, mean_block: float) -> np.ndarray:
    """Indices of a circular stationary bootstrap: runs of geometric length from uniform starts."""
    fresh = rng.random(length) < 1 / mean_block
    fresh[0] = True
    starts = rng.integers(0, n, length)
    last = np.maximum.accumulate(np.where(fresh, np.arange(length), 0))
    return (starts[last] + np.arange(length) - last) % n
