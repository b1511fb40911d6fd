"""Detectors whose state is bounded by a few rows: stretches of a series run side by side, only the running score needs all of it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.topology import PersistentCusum, TopologyDetector
from .folds import fold
from .windows import cusum

#: Rows of a series that one task takes at a time.
STRETCH = 1024


def in_stretches(df: DataFrame, keys: list[str], time: str, values: str, reach: int, run: Callable[[np.ndarray, int], dict], fields: str, stretch: int = STRETCH) -> DataFrame:
    """Keys, time and what run(rows, start) makes of the rows from ``start`` on, for each stretch of a series.

    rows: the array column ``values`` of the stretch in time order, with the ``reach`` rows before it in front, as far as there are any.
    """
    if reach > stretch:
        raise ValueError("a stretch must be longer than what a row depends on")
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in [*keys, time])
    names = [f.split()[0] for f in fields.split(", ")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1
    placed = df.select(*keys, time, values, place.alias("__place")).withColumn("__own", F.expr(f"__place div {stretch}"))
    # the last rows of a stretch are also the lead of the next
    both = F.when(F.col("__place") % stretch >= stretch - reach, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    dealt = placed.withColumn("__stretch", F.explode(both))

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__place")
        start = int((group["__own"] < key[-1]).sum())
        if start == len(group):  # a lead without a stretch
            return pd.DataFrame(columns=[*keys, time, *names])
        return group.iloc[start:][[*keys, time]].assign(**run(np.stack(group[values].to_numpy()).astype(float), start))

    return dealt.groupBy(*keys, "__stretch").applyInPandas(one, f"{kinds}, {fields}")


def _scored(found: DataFrame, keys: list[str], time: str, detector) -> DataFrame:
    """With g and alarm, the CUSUM of the innovations."""
    if detector.decay == 1.0:
        return cusum(found.withColumn("__series", F.struct(*keys)), "__series", time, "innovation", detector.drift, detector.threshold, F.col("ready")).drop("__series")
    from ..functions.steps import Cusum

    scored = fold(found.withColumnsRenamed({"innovation": "x", "ready": "valid"}), keys, time, Cusum(detector.drift, detector.threshold, detector.decay))
    return found.join(scored, [*keys, time])


def persistent_path(df: DataFrame, keys: list[str], time: str, detector: PersistentCusum, stretch: int = STRETCH) -> DataFrame:
    """What the persistent CUSUM makes of each series, as folding it row by row would; in stretches as topology_path.

    Only a series' first rows are not ready, so that their score is 0 either way.

    Returns keys, time, state, innovation, score, alarm, ready, factor.
    """

    def run(rows: np.ndarray, start: int) -> dict:
        innovation, ready, states, there = detector.innovations(rows, start)
        return {"state": [state if ok else None for state, ok in zip(states.tolist(), there, strict=True)], "innovation": innovation, "ready": ready}

    made = _scored(in_stretches(df, keys, time, "features", detector.reach, run, "state array<double>, innovation double, ready boolean", stretch), keys, time, detector)
    factor = detector.factor_least + (1 - detector.factor_least) * F.exp(-detector.sensitivity * F.col("g") / detector.score_scale)
    return made.select(*keys, time, "state", "innovation", F.col("g").alias("score"), "alarm", "ready", F.when(F.col("ready"), factor).otherwise(1.0).alias("factor"))


def topology_path(df: DataFrame, keys: list[str], time: str, detector: TopologyDetector, stretch: int = STRETCH) -> DataFrame:
    """What the rolling topology detector makes of each series, as folding it row by row would.

    A row's innovation depends on the ``reach`` rows before it, so a series is cut into stretches, each with that many rows of the one
    before. The score is a CUSUM of the innovations, reset where they are not calibrated: windows, if nothing decays.

    Returns keys, time, innovation, score, alarm, ready, factor.
    """

    def run(rows: np.ndarray, start: int) -> dict:
        innovation, ready = detector.innovations(rows, start)
        return {"innovation": innovation, "ready": ready}

    found = in_stretches(df, keys, time, "features", detector.reach, run, "innovation double, ready boolean", stretch)
    made = _scored(found, keys, time, detector)
    span = detector.factor_most - detector.factor_least
    factor = detector.factor_least + span * F.exp(-detector.sensitivity * F.col("g"))
    return made.select(*keys, time, "innovation", F.col("g").alias("score"), "alarm", "ready", factor.alias("factor"))
