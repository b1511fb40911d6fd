"""Decisions, realized returns and execution costs from separate tables, and the path they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import empty_or_fail
from .asof import visible

RATES = ("fee", "spread", "slippage", "impact", "other")


def evidence_at(evidence: DataFrame, cutoff, revision: str = "source_revision") -> DataFrame:
    """The latest revision of each target visible at the cutoff; revisions that disagree on the decision time are an error."""
    seen = visible(evidence, cutoff)
    empty_or_fail(seen.groupBy("target_id").agg(F.count_distinct("decision_time").alias("n")).where("n > 1"), "revisions disagree on the decision time")
    rest = [c for c in seen.columns if c != "target_id"]
    return seen.groupBy("target_id").agg(F.max_by(F.struct(*rest), revision).alias("r")).select("target_id", "r.*")


def economic_path(decisions: DataFrame, returns: DataFrame, costs: DataFrame, keys: list[str], time: str = "decision_time") -> DataFrame:
    """Turnover, five cost components, gross and net of each decision.

    Every evaluated decision must have an observed return and a cost of the same decision time; abstentions have neither and
    must be flat before and after. Nothing missing is ever taken for zero.
    """
    live = decisions.where("evaluated")
    match = ["target_id", time]
    for other, what in ((returns.where("status = 'observed' and value is not null"), "an observed return"), (costs, "a cost")):
        empty_or_fail(live.join(other, match, "left_anti").select("target_id"), f"evaluated decision without {what}")
    order = Window.partitionBy(*keys).orderBy(time)
    before = F.coalesce(F.lag("position").over(order), F.lit(0.0))
    moved = decisions.withColumns({"__before": before, "turnover": F.when(F.col("evaluated"), F.abs(F.col("position") - before)).otherwise(0.0)})
    empty_or_fail(moved.where("not evaluated and (abs(position) > 1e-15 or abs(__before) > 1e-15)").select("target_id"), "abstention from an open position")
    both = moved.join(returns.select(*match, "value"), match, "left").join(costs.select(*match, *[f"{r}_rate" for r in RATES], "capacity_limit"), match, "left")
    both = both.withColumns({f"{r}_cost": F.when(F.col("evaluated"), F.col("turnover") * F.col(f"{r}_rate")).otherwise(0.0) for r in RATES})
    both = both.withColumn("gross", F.when(F.col("evaluated"), F.col("position") * F.col("value")).otherwise(0.0))
    total = sum((F.col(f"{r}_cost") for r in RATES[1:]), F.col("fee_cost"))
    both = both.withColumns({"net": F.col("gross") - total, "utilisation": F.col("turnover") / F.col("capacity_limit")})
    empty_or_fail(both.where("utilisation > 1 + 1e-12").select("target_id"), "turnover exceeds the supplied capacity")
    return both.drop("__before")


def economic_metrics(path: DataFrame, keys: list[str], time: str = "decision_time", annual: float = 252.0) -> DataFrame:
    """Mean and Sharpe ratio over evaluated decisions; totals and drawdown (peak from 1) over all."""
    run = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    made = path.withColumn("__e", 1 + F.sum("net").over(run))
    made = made.withColumn("__p", F.greatest(F.lit(1.0), F.max("__e").over(run)))
    live = F.when(F.col("evaluated"), F.col("net"))
    return made.groupBy(*keys).agg(
        F.count_if("evaluated").alias("evaluated_count"),
        F.count_if(~F.col("evaluated")).alias("abstained_count"),
        F.avg(live).alias("mean_net_return"),
        F.when((F.count(live) < 2) | (F.stddev_samp(live) <= 1e-15), 0.0).otherwise(F.avg(live) / F.stddev_samp(live) * F.sqrt(F.lit(annual))).alias("net_sharpe"),
        F.max((F.col("__p") - F.col("__e")) / F.col("__p")).alias("max_drawdown"),
        F.sum("turnover").alias("turnover"),
        *[F.sum(f"{r}_cost").alias(f"{r}_cost") for r in RATES],
        F.max("utilisation").alias("capacity_utilization_max"),
        F.sum("net").alias("total_net_return"),
    )
