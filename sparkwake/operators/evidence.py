"""Anytime-valid evidence: bounded scores, e-processes, level spending, promotion gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import score_difference
from ..schema import empty_or_fail
from .asof import duplicates

def bounded(x: Column, bound: float) -> Column:
    """Clipped to [-bound, bound] and scaled to [-1, 1]; infinities go to the bound of their sign."""
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x)) / bound


def utility(prediction: Column, label: Column, cap: float) -> Column:
    """Negative absolute error, capped."""
    return -F.least(F.abs(prediction - label), F.lit(cap))


def betting_fraction(score: str, keys: list[str], time: str, most: float = 0.5) -> Column:
    """Mean of the scores before the current one, between 0 and ``most``; 0 at the start."""
    prior = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, -1)
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.coalesce(F.avg(score).over(prior), F.lit(0.0))))


def threshold(alpha: float, wealth: float = 1.0) -> float:
    return wealth / alpha


def slot_alpha(alpha: float, slot: Column, epoch: Column) -> Column:
    """Level of a challenger's slot (from 1) in an epoch (from 0): halves with each, so all together stay below alpha."""
    return alpha * F.pow(F.lit(2.0), -slot) * F.pow(F.lit(2.0), -(epoch + 1))


def share_alpha(alpha: float, models: int, features: int, epochs: int) -> float:
    return alpha / (models * features * epochs)


def would_cross(wealth: Column, score: Column, eta, level) -> Column:
    """Whether the next score would take a process over its threshold, without taking it in."""
    return wealth * (1 + eta * score) >= level


def wealth(df: DataFrame, keys: list[str], time: str, score: str, eta, start: float = 1.0) -> DataFrame:
    """Adds the running wealth start * product(1 + eta * score): a product window, no fold."""
    run = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("wealth", F.product(1 + eta * F.col(score)).over(run) * start)


def first_crossing(wealthy: DataFrame, keys: list[str], time: str, level) -> DataFrame:
    """When each process first reaches its threshold, and its highest wealth; null if it never does."""
    return wealthy.groupBy(*keys).agg(
        F.min(F.when(F.col("wealth") >= level, F.col(time))).alias("crossed_at"), F.max("wealth").alias("peak_wealth"), F.count("*").alias("n")
    )


def gate(wealthy: DataFrame, gates: list[str], challenger: str, time: str, level) -> DataFrame:
    """The one promotion of each gate: the first crossing closes it; challengers crossing together go by name.

    Returns the gate, the promoted challenger, when, and how many observations each gate took in until it closed.
    """
    crossings = wealthy.where(F.col("wealth") >= level).groupBy(*gates).agg(F.min(F.struct(F.col(time).alias("at"), F.col(challenger).alias("who"))).alias("first"))
    seen = wealthy.join(crossings, gates, "left").where(F.col("first").isNull() | (F.col(time) <= F.col("first.at")))
    return seen.groupBy(*gates).agg(F.first("first.who").alias("promoted"), F.first("first.at").alias("promoted_at"), F.count("*").alias("observations"))


def selection_budget(dimensions: dict[str, list], alpha: float, spark) -> DataFrame:
    """All cells of a sealed family with equal shares of alpha. The grid is the operator's result, its size a product of the arguments' lengths."""
    grid = spark.range(1).select(*[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in dimensions.items()])
    size = 1
    for name, values in dimensions.items():
        grid = grid.withColumn(name, F.explode(name))
        size *= len(values)
    return grid.withColumns({"cell_alpha": F.lit(alpha / size), "cells": F.lit(size).cast("long")})


def ready_prefix(pending: DataFrame, keys: list[str], time: str, ready: str) -> DataFrame:
    """Settlement in prediction order: rows up to the first that is not ready."""
    run = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return pending.withColumn("__open", F.sum((~F.col(ready)).cast("int")).over(run)).where(F.col("__open") == 0).drop("__open")


def evidence_ledger(predictions: DataFrame, labels: DataFrame, keys: list[str], time: str, now, expiry: int, burn_in: int) -> DataFrame:
    """Which predictions are settled at ``now``, in the order they were made, and which of those are evidence.

    predictions: keys, target_id, time; labels: target_id, available_time, status. A prediction without a visible label is open until ``expiry``
    after it was made, then expired; the first open one stops the settlement of all after it. Observed labels are evidence once
    ``burn_in`` of them have been settled before. Returns keys, target_id, time, state, position and is_evidence.
    """
    seen = labels.where(F.col("available_time") <= now).select("target_id", "status")
    state = F.when(F.col("status").isNotNull(), F.col("status")).when(F.col(time) + expiry <= now, "expired").otherwise("open")
    marked = predictions.where(F.col(time) <= now).join(seen, "target_id", "left").withColumn("state", state)
    settled = ready_prefix(marked.withColumn("ready", F.col("state") != "open"), keys, time, "ready")
    order = Window.partitionBy(*keys).orderBy(time)
    observed = (F.col("state") == "observed").cast("long")
    before = F.coalesce(F.sum(observed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return settled.select(
        *keys, "target_id", time, "state", F.row_number().over(order).cast("long").alias("position"), ((F.col("state") == "observed") & (before >= burn_in)).alias("is_evidence")
    )


def paired_ledger(predictions: DataFrame, labels: DataFrame, keys: list[str], time: str, now, alpha: float, eta: float, cap: float = 1.0, burn_in: int = 0, expiry: int | None = None) -> DataFrame:
    """Frozen paired predictions, settled in the order they were made, as evidence for the challenger.

    predictions: keys, prediction_id, time, challenger, incumbent; labels: prediction_id, available_time, status (observed or
    missing), value. A prediction is settled once its label and those of all before it are there; without a label it expires ``expiry`` after it was made, if
    given, and holds up all after it until then. The first ``burn_in`` observed labels are no evidence. Each further one has a score, the bounded
    difference of the capped utilities, and the wealth is the product of 1 + eta * score; the first to reach 1 / alpha promotes from the next
    step on, and what was predicted later is closed. A label before its decision, a prediction or a label that comes twice, and two
    predictions of a key at one time are errors.

    Returns keys, prediction_id, time, status (settled, burn_in, missing, expired, pending, closed), settled_at, place, score, wealth, effective_at.
    """
    empty_or_fail(duplicates(predictions, ["prediction_id"]), "a prediction was recorded twice")
    empty_or_fail(duplicates(predictions, [*keys, time]), "decision times must rise")
    empty_or_fail(duplicates(labels, ["prediction_id"]), "a prediction has two labels")
    known = labels.select("prediction_id", "available_time", "status", "value")
    empty_or_fail(predictions.join(known, "prediction_id").where(F.col("available_time") <= F.col(time)).select("prediction_id"), "a label before its decision")
    seen = predictions.where(F.col(time) <= now).join(known.where(F.col("available_time") <= now), "prediction_id", "left")
    if expiry is not None:
        over = F.col("status").isNull() & (F.col(time) + expiry <= now)
        seen = seen.withColumns({"status": F.when(over, "expired").otherwise(F.col("status")), "available_time": F.when(over, F.col(time) + expiry).otherwise(F.col("available_time"))})
    order = Window.partitionBy(*keys).orderBy(time)
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    observed = F.col("status") == "observed"
    made = seen.withColumns({
        "place": (F.row_number().over(order) - 1).cast("long"),
        "held_up": F.max(F.col("status").isNull().cast("int")).over(upto) == 1,
        "settled_at": F.max("available_time").over(upto),
        "earlier": F.coalesce(F.sum(observed.cast("long")).over(before), F.lit(0)),
        "gap": score_difference(utility(F.col("challenger"), F.col("value"), cap), utility(F.col("incumbent"), F.col("value"), cap), cap),
    })
    counts = ~F.col("held_up") & observed & (F.col("earlier") >= burn_in)
    made = made.withColumn("score", F.when(counts, F.col("gap"))).withColumn("wealth", F.product(1 + eta * F.coalesce("score", F.lit(0.0))).over(upto))
    crossed = F.min(F.when(F.col("score").isNotNull() & (F.col("wealth") >= threshold(alpha)), F.col("place"))).over(Window.partitionBy(*keys))
    made = made.withColumn("crossing", crossed)
    closed = F.coalesce(F.col("place") > F.col("crossing"), F.lit(False))
    status = F.when(closed, "closed").when(F.col("held_up"), "pending").when(~observed, F.col("status")).when(F.col("score").isNull(), "burn_in").otherwise("settled")
    open_ = ~closed & ~F.col("held_up")
    return made.select(
        *keys, "prediction_id", time, status.alias("status"), F.when(open_, F.col("settled_at")).alias("settled_at"), "place", F.when(open_, F.col("score")).alias("score"),
        F.when(open_, F.col("wealth")).alias("wealth"), F.when(F.col("place") == F.col("crossing"), F.col("settled_at") + 1).alias("effective_at"),
    )
