"""Economic paths: exact values and what must fail."""

from __future__ import annotations

import pytest

from sparkwake.operators import economic

D = "series string, target_id string, decision_time long, evaluated boolean, position double"


def tables(spark, positions, evaluated=(True, True)):
    decisions = spark.createDataFrame([("s", f"t{i}", i, e, p) for i, (p, e) in enumerate(zip(positions, evaluated, strict=True))], D)
    returns = spark.createDataFrame([("t0", 0, 0.10, "observed"), ("t1", 1, -0.20, "observed")], "target_id string, decision_time long, value double, status string")
    costs = spark.createDataFrame([(f"t{i}", i, 0.05, 0.04, 0.03, 0.02, 0.01, 9.0) for i in (0, 1)], "target_id string, decision_time long, fee_rate double, spread_rate double, slippage_rate double, impact_rate double, other_rate double, capacity_limit double")
    return decisions, returns, costs


def test_net_of_each_decision(spark):
    path = economic.economic_path(*tables(spark, (0.5, -0.5)), ["series"]).orderBy("decision_time").collect()
    assert [round(r["net"], 12) for r in path] == [-0.025, -0.05]


def test_abstention_from_an_open_position_fails(spark):
    with pytest.raises(ValueError, match="abstention"):
        economic.economic_path(*tables(spark, (0.5, 0.0), (True, False)), ["series"])


def test_missing_return_fails(spark):
    d, r, c = tables(spark, (0.5, -0.5))
    with pytest.raises(ValueError, match="observed return"):
        economic.economic_path(d, r.where("target_id = 't0'"), c, ["series"])


def test_capacity_fails(spark):
    d, r, c = tables(spark, (0.5, -0.5))
    with pytest.raises(ValueError, match="capacity"):
        economic.economic_path(d, r, c.replace(9.0, 0.4, "capacity_limit"), ["series"])
