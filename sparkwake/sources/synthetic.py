"""Synthetic regimes: seeded per block of rows, so that any number of tasks makes the same table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def regimes(spark: SparkSession, series: int, rows: int, features: int, shifts: tuple[int, ...], noise: float = 0.25, seed: int = 0, delay: int = 0) -> DataFrame:
    """series, t, features, label, available_at, realized_return, expected_return, optimal_position, regime_id, change_point.

    Linear labels whose coefficients change at each shift. Coefficients depend on (seed, series, regime) only and the rest on (seed,
    series), each series being one row of a seed table: the unit that tasks share out.
    """
    if any(not 0 < s < rows for s in shifts) or list(shifts) != sorted(set(shifts)):
        raise ValueError("shifts must rise inside the table")

    def run(batches):
        for batch in batches:
            for s in batch["id"]:
                rng = np.random.default_rng([seed, int(s)])
                x = rng.normal(size=(rows, features))
                regime = np.searchsorted(np.array(shifts), np.arange(rows), side="right")
                beta = np.stack([np.random.default_rng([seed, int(s), k + 1]).normal(size=features) for k in range(len(shifts) + 1)])
                expected = (x * beta[regime]).sum(axis=1) / np.sqrt(features)
                label = expected + noise * rng.normal(size=rows)
                yield pd.DataFrame({
                    "series": int(s), "t": np.arange(rows), "features": list(x), "label": label, "available_at": np.arange(rows) + delay,
                    "realized_return": label, "expected_return": expected, "optimal_position": np.sign(expected),
                    "regime_id": regime, "change_point": np.isin(np.arange(rows), shifts),
                })

    schema = "series long, t long, features array<double>, label double, available_at long, realized_return double, expected_return double, optimal_position double, regime_id long, change_point boolean"
    return spark.range(0, series, 1, min(series, 200)).mapInPandas(run, schema)


def covariance_shift(spark: SparkSession, series: int, rows: int, shift: int, calm: float = 0.2, wild: float = 0.9, seed: int = 0) -> DataFrame:
    """series, t, x, y: two unit-variance values whose correlation changes at ``shift``, from a hash of the row: no state, any split."""
    grid = spark.range(series).withColumnRenamed("id", "series").select("series", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("t"))
    unit = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(k), "series", "t")), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    normal = lambda k: F.sqrt(-2 * F.log(unit(f"{k}r"))) * F.cos(2 * np.pi * unit(f"{k}a"))
    made = grid.withColumns({"x": normal("x"), "e": normal("y"), "rho": F.when(F.col("t") < shift, calm).otherwise(wild)})
    return made.select("series", "t", "x", (F.col("rho") * F.col("x") + F.sqrt(1 - F.col("rho") ** 2) * F.col("e")).alias("y"))
