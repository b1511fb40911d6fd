"""Studies as compositions, and the scalar maps."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sparkwake.functions import scalars, steps
from sparkwake.plans import study
from sparkwake.sources.synthetic import regimes


def test_study_prefers_the_adaptive_learner_after_a_shift(spark):
    data = regimes(spark, 2, 160, 2, (60,), noise=0.1, seed=3, delay=1).select("series", "t", "features", F.col("label").alias("target"), F.col("available_at").alias("available_step"))
    config = study.StudyConfig(2, ridge=0.1, burn_in=10, cap=1.0)
    static = study.recursive_study(data, ["series"], "t", config)
    fading = study.recursive_study(data, ["series"], "t", study.StudyConfig(2, ridge=0.1, neutral=0.9))
    promoted = study.promotion_study(fading, static, ["series"], "t", config).collect()
    assert all(r["promoted_at"] is None or r["promoted_at"] > 60 for r in promoted) and any(r["promoted_at"] for r in promoted)
    reverse = study.promotion_study(static, fading, ["series"], "t", config).collect()
    assert not any(r["promoted_at"] for r in reverse)
    mse = lambda run: study.study_metrics(run, ["series"], "t", config).agg(F.avg("mse")).first()[0]
    assert mse(fading) < mse(static)


def test_detector_factors_reach_the_learner_only_when_ready(spark):
    data = regimes(spark, 1, 60, 2, (30,), seed=1).select("series", "t", "features", F.col("label").alias("target"), F.col("available_at").alias("available_step"))
    run = study.recursive_study(data, ["series"], "t", study.StudyConfig(2, neutral=0.99), steps.BlockShift(6, 1.0)).orderBy("t").collect()
    assert all(r["factor"] == 0.99 and not r["accelerated"] for r in run[:11]) and all(r["accelerated"] for r in run[11:])
    off = study.recursive_study(data, ["series"], "t", study.StudyConfig(2, neutral=0.99, calibrated=False), steps.BlockShift(6, 1.0))
    assert off.where("accelerated").count() == 0


@pytest.mark.parametrize(
    "mode,classes,raw,want",
    [("auto", (0.0, 1.0), 0.75, 0.5), ("label", (0.0, 1.0), 0.2, -1.0), ("auto", (-1.0, 1.0), 0.3, 1.0), ("label", None, -3.0, -1.0), ("raw", None, 7.0, 1.0), ("auto", None, math.nan, 0.0), ("label", (2.0, 5.0), 2.0, -1.0)],
)
def test_position_modes(spark, mode, classes, raw, want):
    assert spark.range(1).select(scalars.mapped_position(F.lit(raw), mode, classes)).first()[0] == want


def test_scalar_maps(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalars.forgetting(F.lit(0.0), 0.9, 1.0, 0.5)) == 1.0
    assert one(scalars.spectral_entropy(F.array(F.lit(1.0), F.lit(1.0), F.lit(0.0)))) == pytest.approx(1.0)
    assert one(scalars.score_difference(F.lit(float("inf")), F.lit(0.0), 0.5)) == 1.0
    assert one(scalars.score_difference(F.lit(-math.inf), F.lit(-math.inf), 0.5)) == 0.0
    assert scalars.signature_dimension(2, 3) == 15
