"""Hand-checkable values of path metrics, windows and strategies."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwake.operators import asof, evidence, metrics, strategies, windows

PATH = "s string, t long, position double, ret double, optimal double, evaluated boolean, prediction double, label double"


def path(spark, rows):
    return spark.createDataFrame([("a", i, *r) for i, r in enumerate(rows)], PATH)


def test_regret_is_one_sided(spark):
    r = metrics.comparator(path(spark, [(-1.0, -0.2, 1.0, True, 0.0, 0.0)]), "s", "t", 0.0).first()
    assert (round(r["absolute_discrepancy"], 12), r["one_sided_regret"]) == (0.4, 0.0)


def test_comparator_pays_its_own_costs(spark):
    r = metrics.comparator(path(spark, [(0.0, 0.10, 1.0, True, 0.0, 0.0)]), "s", "t", 0.05).first()
    assert [round(r[c], 12) for c in ("absolute_discrepancy", "one_sided_regret")] == [0.05, 0.05]


def test_rows_that_are_not_evaluated_count_for_nothing(spark):
    rows = [(1.0, 100.0, 1.0, False, 1.0, 1.0), (1.0, 1.0, 1.0, True, 1.0, 1.0)]
    r = metrics.bundle(path(spark, rows), "s", "t", 0.0).first()
    assert (r["net_return"], r["total_cost"], r["max_drawdown"], r["n_evaluated"]) == (1.0, 0.0, 0.0, 1)


def test_three_drawdowns_differ_on_a_first_loss(spark):
    made = spark.createDataFrame([("a", 0, -0.5), ("a", 1, -0.1)], "s string, t long, net double")
    r = metrics.drawdowns(made, "s", "t").first()
    assert [round(r[c], 12) for c in ("from_first", "from_one", "compounded")] == [0.2, 0.6, 0.1]


def test_delays(spark):
    rows = [(1.0, 0.1, 1.0, True, 0.0, 0.0)] * 3 + [(p, r, -1.0, True, 0.0, 0.0) for p, r in ((1.0, -0.2), (-1.0, -0.1), (-1.0, -0.1), (-1.0, -0.1))]
    p = path(spark, rows).withColumn("regime", (F.col("t") >= 3).cast("long"))
    cps = metrics.change_points(p, "s", "t")
    assert [tuple(r) for r in metrics.detection_delays(p, cps, "s", "t", 2).collect()] == [("a", 3, 1)]
    assert metrics.detection_delays(p, cps, "s", "t", 5).first()["detection_delay"] is None
    made = metrics.with_path(p, "s", "t", 0.0)
    assert metrics.recovery_delays(made, cps, "s", "t").first()["recovery_delay"] == 2


def test_future_rows_never_reach_prior_windows(spark):
    base = spark.range(60).select(F.lit("a").alias("s"), F.col("id").alias("t"), F.sin("id").alias("x"))
    later = base.withColumn("x", F.when(F.col("t") >= 40, 99.0).otherwise(F.col("x")))
    order = windows.along("s", "t")
    for made in (windows.prior_mean(F.col("x"), order, 5), windows.prior_robust_z(F.col("x"), order, 10, 5), windows.block_mean_shift(F.col("x"), order, 4)):
        rows = [[r["m"] for r in df.select("t", made.alias("m")).where("t < 40").orderBy("t").collect()] for df in (base, later)]
        assert rows[0] == rows[1]


def test_bounded_scores_and_levels(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(evidence.bounded(F.lit(0.25), 0.5)) == 0.5 and one(evidence.bounded(F.lit(float("-inf")), 0.5)) == -1.0
    assert one(evidence.slot_alpha(0.2, F.lit(1), F.lit(0))) == 0.05
    assert evidence.threshold(0.05) == 20 and evidence.share_alpha(0.06, 2, 3, 1) == 0.01


def test_gate_closes_for_all_at_the_first_crossing(spark):
    rows = [("g", c, t, s) for t, (c, s) in enumerate([("a", 1.0), ("b", 1.0), ("b", 1.0), ("a", 1.0), ("b", 1.0)])]
    w = evidence.wealth(spark.createDataFrame(rows, "g string, c string, t long, score double"), ["g", "c"], "t", "score", F.lit(1.0))
    assert tuple(evidence.gate(w, ["g"], "c", "t", 4.0).first()) == ("g", "b", 2, 3)


def test_held_weights_and_grid(spark):
    w = spark.createDataFrame([("a", t, float(t)) for t in range(7)], "s string, t long, weight double")
    assert [r["weight"] for r in strategies.hold_between(w, ["s"], "t", 3).orderBy("t").collect()] == [0, 0, 0, 3, 3, 3, 6]
    grid = spark.createDataFrame([(10, 1.0), (20, 2.0), (5, 2.0)], "p int, score double")
    assert tuple(strategies.grid_best(grid, ["p"], "score", ["p"]).first()) == (5, 2.0)


def test_whole_book_and_lookup(spark):
    obs = spark.createDataFrame([("m", 1, 0, 2.0)], "record_id string, available_time long, source_revision long, value double")
    labels = spark.createDataFrame([("l1", "t", 1, 0, 1.0), ("l2", "t", 2, 1, 3.0)], "label_id string, target_id string, available_time long, source_revision long, value double")
    members = spark.createDataFrame([("i", 0, None, 0, 0)], "instrument_id string, start long, end long, available_time long, source_revision long")
    book = asof.as_of(obs, labels, members, F.lit(2))
    assert asof.lookup(book["labels"], "target_id", "t")["value"] == 3.0
    assert asof.lookup(asof.as_of(obs, labels, members, F.lit(1))["labels"], "target_id", "t")["value"] == 1.0
    with pytest.raises(LookupError):
        asof.lookup(book["observations"], "record_id", "other")
