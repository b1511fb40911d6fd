"""A causal study: detector first, learner second, gate third, economics last, each a pass over what the one before made."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import steps
from ..operators import evidence, metrics
from ..operators.folds import fold


@dataclass(frozen=True)
class StudyConfig:
    features: int
    ridge: float = 1.0
    neutral: float = 1.0
    scale: float = 1.0
    limit: float = 1.0
    cost_rate: float = 0.0005
    calibrated: bool = True
    cap: float = 1.0
    alpha: float = 0.05
    eta: float = 0.5
    burn_in: int = 20


def recursive_study(data: DataFrame, keys: list[str], time: str, config: StudyConfig, detector=None) -> DataFrame:
    """Predictions of a recursive learner whose memory follows a detector.

    data: keys, time (step), features, target, available_step. A detector reads features only, never labels, so its whole
    pass comes first and the learner reads its factors as a column; both are folds over the same partitioning.
    """
    rows = data.withColumn("step", F.col(time))
    if detector is not None:
        seen = fold(data.select(*keys, time, "features"), keys, time, detector).select(*keys, time, "factor", "ready", "alarm", "score")
        rows = rows.join(seen, [*keys, time])
    learner = steps.RecursiveRun(config.features, config.ridge, config.neutral, config.calibrated, config.scale, config.limit, config.cost_rate)
    made = fold(rows.drop("alarm", "score"), keys, time, learner)
    out = made.join(data.select(*keys, time, "target", "available_step"), [*keys, time])
    return out.join(seen.select(*keys, time, "alarm", "score"), [*keys, time]) if detector is not None else out


def economic_decisions(run: DataFrame, keys: list[str], time: str, target: str, start: int = 0) -> DataFrame:
    """A run's positions as decisions of their own: what has no prediction, or lies before ``start``, is an abstention with its reason and no position."""
    reason = F.when(F.col(time) < start, "before the start").when(F.col("prediction").isNull(), "no prediction")
    made = run.withColumn("reason", reason).withColumn("evaluated", F.col("reason").isNull())
    position = F.when(F.col("evaluated"), F.col("position")).otherwise(0.0)
    return made.select(*keys, F.concat_ws("|", *keys, target).alias("decision_id"), F.col(target).alias("target_id"), F.col(time).alias("decision_time"), position.alias("position"), "evaluated", "reason")


def promotion_study(challenger: DataFrame, incumbent: DataFrame, keys: list[str], time: str, config: StudyConfig) -> DataFrame:
    """Paired evidence of two studies on the same rows, in order of settlement: when, if ever, the challenger is promoted.

    Labels of the burn-in train the learners but are no evidence. After the crossing nothing more is counted: the gate is closed.
    """
    both = challenger.select(*keys, time, "available_step", F.col("prediction").alias("c"), "target").join(
        incumbent.select(*keys, time, F.col("prediction").alias("i")), [*keys, time]
    )
    gap = evidence.utility(F.col("c"), F.col("target"), config.cap) - evidence.utility(F.col("i"), F.col("target"), config.cap)
    scored = both.where(F.col(time) >= config.burn_in).withColumn("score", evidence.bounded(gap, config.cap))
    wealthy = evidence.wealth(scored, keys, time, "score", F.lit(config.eta))
    level = evidence.threshold(config.alpha)
    crossed = wealthy.where(F.col("wealth") >= level).groupBy(*keys).agg(F.min(time).alias("promoted_at"))
    seen = wealthy.join(crossed, keys, "left").where(F.col("promoted_at").isNull() | (F.col(time) <= F.col("promoted_at")))
    return seen.groupBy(*keys).agg(F.max("promoted_at").alias("promoted_at"), F.max("wealth").alias("peak_wealth"), F.count("*").alias("evidence"))


def study_metrics(run: DataFrame, keys: list[str], time: str, config: StudyConfig, annual: float = 252.0) -> DataFrame:
    """Path metrics of a study's run on its targets as returns."""
    named = run.withColumn("__k", F.concat_ws("|", *keys)).withColumns({"label": F.col("target"), "ret": F.col("target")})
    return metrics.online_bundle(named, "__k", time, config.cost_rate, annual)
