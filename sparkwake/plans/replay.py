"""Causal replay: predictions frozen when made, settled at the first decision that sees their label, in a hash-chained ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.steps import Chain
from ..operators.asof import leaks, validity
from ..operators.folds import fold
from ..schema import empty_or_fail


def replay(predictions: DataFrame, labels: DataFrame, clock: DataFrame, keys: list[str], revision: str | None = None) -> DataFrame:
    """Each prediction with its settlement and score (minus absolute error); what the clock never reaches is unresolved.

    predictions: keys, target_id, predicted_at, prediction; labels: target_id, available_time, value and, if they have several, a revision;
    clock: keys, decision_time. The first decision at or after the availability is found by sorting both together, so decisions and
    predictions are never paired. Of a label's revisions the first says when it is settled, and the latest visible by then what it says.
    """
    empty_or_fail(leaks(predictions, labels), "label visible when its target is predicted")
    first = labels if revision is None else labels.groupBy("target_id").agg(F.min("available_time").alias("available_time"))
    joined = predictions.join(first, "target_id", "left")
    due = joined.select(*keys, F.greatest("available_time", F.col("predicted_at") + 1).alias("at"), F.struct(*[c for c in joined.columns if c not in keys]).alias("p"))
    both = due.unionByName(clock.select(*keys, F.col("decision_time").alias("at"), F.col("decision_time").alias("now")), allowMissingColumns=True)
    ahead = Window.partitionBy(*keys).orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    settled = both.withColumn("settled_at", F.min("now").over(ahead)).where("p is not null").select(*keys, "p.*", "settled_at")
    settled = settled.withColumn("settled_at", F.when(F.col("available_time").isNotNull(), F.col("settled_at")))
    if revision is not None:
        known = validity(labels, ["target_id"], revision=revision).select(F.col("target_id").alias("__t"), "value", "valid_from", "valid_to")
        inside = (F.col("valid_from") <= F.col("settled_at")) & (F.col("valid_to").isNull() | (F.col("settled_at") < F.col("valid_to")))
        settled = settled.join(known, (F.col("target_id") == F.col("__t")) & inside, "left")
    done = F.col("settled_at").isNotNull()
    return settled.select(
        *keys, "target_id", "predicted_at", "prediction",
        F.when(done, F.when(F.col("value").isNotNull(), "observed").otherwise("missing")).otherwise("unresolved").alias("status"),
        "settled_at",
        F.when(done, -F.abs(F.col("prediction") - F.col("value"))).alias("score"),
    )


def chain(records: DataFrame, keys: list[str], time: str, payload: str, genesis: str = "genesis") -> DataFrame:
    """Each key's records as a stored chain: keys, time, payload, place, before, digest; a digest covers its record and the digest before it."""
    placed = records.select(*keys, time, payload)
    made = fold(placed.withColumnRenamed(payload, "payload"), keys, time, Chain(genesis))
    return placed.join(made, [*keys, time])


def validate_chain(ledger: DataFrame, keys: list[str], payload: str, genesis: str = "genesis") -> DataFrame:
    """Records of a stored chain that break it: every record can be checked beside its neighbour, so no fold is needed."""
    order = Window.partitionBy(*keys).orderBy("place")
    wanted = F.coalesce(F.lag("digest").over(order), F.lit(genesis))
    marked = ledger.withColumns({"__before": wanted, "__place": F.row_number().over(order).cast("long")})
    sound = (F.col("before") == F.col("__before")) & (F.col("place") == F.col("__place")) & (F.col("digest") == F.sha2(F.concat_ws("|", "before", payload), 256))
    return marked.where(~F.coalesce(sound, F.lit(False))).drop("__before", "__place")


def chain_heads(records: DataFrame, keys: list[str], time: str, payload: str, genesis: str = "genesis") -> DataFrame:
    """Length and last digest of each key's chain."""
    return chain(records, keys, time, payload, genesis).groupBy(*keys).agg(F.max("place").alias("records"), F.max_by("digest", "place").alias("head"))
